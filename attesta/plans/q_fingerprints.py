"""Registered queries: fingerprints of tables and checksum lists of files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators import fingerprints as fp
from attesta.plans.registry import query
from attesta.session import scratch_path

# how the columns of the given tables are told apart in the SQL: fractions, times, arrays of fractions, all others
FRACTIONS = {"c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "value"}
TIMES = {"o_orderdate", "l_shipdate", "ts"}
TABLES = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props", "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label", "pages": "page_id url html", "benchmark": "item_id text",
    "labels": "doc_id quality toxic", "conversations": "conv_id turn role text"}


def _sized_sql(text: str) -> str:
    return f"coalesce(length({text}) || ':' || {text}, '-')"


def _value_sql(column: str) -> str:
    steps = "CAST(CAST(floor(CAST({0} AS DOUBLE) * power(2, 40)) AS BIGINT) AS VARCHAR)"
    if column in FRACTIONS:
        return steps.format(column)
    if column in TIMES:
        return f"CAST(epoch_us({column}) AS VARCHAR)"
    if column == "embedding":
        return f"array_to_string([{_sized_sql(steps.format('x'))} for x in embedding], '')"
    return f"CAST({column} AS VARCHAR)"


def _digest_sql(table: str, columns: str) -> str:
    row = " || ".join(_sized_sql(_value_sql(c)) for c in columns.split())
    sums = " || '-' || ".join(f"CAST(coalesce(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS HUGEINT)), 0) AS VARCHAR)" for i in range(4))
    return f"count(*) AS row_count, {sums} AS digest FROM (SELECT sha256({row}) AS h FROM {table})"


@query("A18_logical_fingerprint", sql=" UNION ALL ".join(f"SELECT '{n}' AS table_name, {_digest_sql(n, c)}" for n, c in TABLES.items()))
def logical_fingerprint(lake):
    """Count and order-free digest of every table over all its columns."""
    parts = [fp.digest(fp.table_sums(lake.table(n))).select(F.lit(n).alias("table_name"), "row_count", "digest") for n in TABLES]
    return reduce(DataFrame.unionByName, parts)


CHANGED_SQL = """(SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 1000 = 7 THEN o_totalprice + CAST(0.01 AS DOUBLE) ELSE o_totalprice END AS o_totalprice,
   o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 1000 <> 9
 UNION ALL SELECT o_orderkey + 1000000000, o_custkey, NULL, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey % 1000 = 11)"""


@query("A18_fingerprint_update", sql=f"""
SELECT 'before' AS state, {_digest_sql('orders', TABLES['orders'])} UNION ALL SELECT 'after' AS state, {_digest_sql(CHANGED_SQL, TABLES['orders'])}""")
def fingerprint_update(lake):
    """Prices changed by a cent, rows removed and rows added: the stored sums take the difference, the SQL counts anew."""
    orders, key = lake.table("orders"), F.col("o_orderkey")
    stored = fp.table_sums(orders)
    repriced = orders.where(key % 1000 == 7)
    new = orders.where(key % 1000 == 11).withColumn("o_orderkey", key + 1000000000).withColumn("o_orderstatus", F.lit(None).cast("string"))
    added = repriced.withColumn("o_totalprice", F.col("o_totalprice") + F.lit(0.01)).unionByName(new)
    removed = repriced.unionByName(orders.where(key % 1000 == 9))
    after = fp.updated_sums(stored, added, removed, orders.columns)
    return fp.digest(stored).withColumn("state", F.lit("before")).unionByName(fp.digest(after).withColumn("state", F.lit("after")))


FILES_SQL = """
WITH l AS (SELECT doc_id // 64 AS block, doc_id, doc_id || ' ' || sha256(text) AS line,
    doc_id || ' ' || CASE WHEN (doc_id // 64) % 7 = 3 AND doc_id % 64 = 0 THEN 'damaged' ELSE sha256(text) END AS kept FROM documents),
b AS (SELECT block, sha256(string_agg(line || chr(10), '' ORDER BY doc_id)) AS expected, sha256(string_agg(kept || chr(10), '' ORDER BY doc_id)) AS actual FROM l GROUP BY 1),
c AS (SELECT 'block=' || block AS name, CASE WHEN block % 13 = 4 THEN NULL ELSE expected END AS expected, CASE WHEN block % 11 = 5 THEN NULL ELSE actual END AS actual FROM b),
r AS (SELECT name, expected, actual, CASE WHEN actual IS NULL THEN 'NOT_RECOVERED' WHEN expected IS NULL THEN 'NOT_LISTED'
   WHEN actual = expected THEN 'MATCH' ELSE 'MISMATCH' END AS status FROM c WHERE expected IS NOT NULL OR actual IS NOT NULL)
"""


def _checked_files(lake):
    """Files of 64 documents, some damaged and some lost, against the list that was made from the rows beforehand."""
    docs = lake.table("documents").select("doc_id", F.floor(F.col("doc_id") / 64).alias("block"), F.sha2("text", 256).alias("h"))
    block = F.col("block")
    damaged = (block % 7 == 3) & (F.col("doc_id") % 64 == 0)
    line = F.concat_ws(" ", F.col("doc_id").cast("string"), "h")
    kept = F.concat_ws(" ", F.col("doc_id").cast("string"), F.when(damaged, "damaged").otherwise(F.col("h")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("line")))), lambda x: x["line"])
    listed = docs.where(block % 13 != 4).groupBy("block").agg(
        F.sha2(F.concat(F.array_join(ordered, "\n"), F.lit("\n")), 256).alias("expected"))
    root = scratch_path(lake.spark, "files")
    fp.write_checksums(listed.select(F.concat(F.lit("block="), block).alias("name"), "expected"), f"{root}/sums")
    fp.write_blocks(docs.where(block % 11 != 5).select("block", "doc_id", kept.alias("value")), "block", ["doc_id"], f"{root}/files")
    return fp.verified(fp.read_checksums(lake.spark, f"{root}/sums"), fp.block_digests(lake.spark, f"{root}/files"))


@query("S8_checksum_manifest", sql=FILES_SQL + "SELECT name, expected, actual, status FROM r")
def checksum_manifest(lake):
    """Every entry of the list and every file, with the digest of its bytes."""
    return _checked_files(lake).select("name", "expected", "actual", "status")


@query("J19_checksum_verification", sql=FILES_SQL + "SELECT status, count(*) AS files FROM r GROUP BY 1")
def checksum_verification(lake):
    return _checked_files(lake).groupBy("status").agg(F.count("*").alias("files"))
