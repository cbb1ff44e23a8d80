"""Fingerprints that are kept up to date, and lists of file digests."""

import random

from pyspark.sql import functions as F

from attesta.operators import fingerprints as fp
from attesta.session import scratch_path

SCHEMA = "id long, price double, at timestamp, tags array<string>, note string"


def table(spark, rows):
    df = spark.createDataFrame(rows, "id long, price double, at string, tags array<string>, note string")
    return df.withColumn("at", F.col("at").cast("timestamp"))


def rows_of(n):
    rng = random.Random(5)
    return [(i, rng.random() * 100, f"2024-01-{i % 28 + 1:02d} 00:00:00", [str(i), None] if i % 3 else None, None if i % 4 else "") for i in range(n)]


def digest_of(df):
    return tuple(fp.digest(fp.table_sums(df)).first())


def test_order_and_partitions_do_not_matter(spark):
    rows = rows_of(60)
    df = table(spark, rows)
    assert digest_of(df) == digest_of(table(spark, rows[::-1]).repartition(5))
    assert digest_of(df.where("id < 0"))[0] == 0


def test_each_column_counts(spark):
    df = table(spark, rows_of(20))
    first = F.col("id") == 3
    changed = {"price": F.col("price") + F.lit(1e-9), "at": F.col("at") + F.expr("INTERVAL 1 SECOND"),
               "tags": F.array(F.lit("x")), "note": F.lit("n")}
    seen = {digest_of(df)}
    for name, value in changed.items():
        seen.add(digest_of(df.withColumn(name, F.when(first, value).otherwise(F.col(name)))))
    assert len(seen) == len(changed) + 1


def test_neighbours_do_not_run_together_and_missing_is_not_empty(spark):
    pairs = [("ab", "c"), ("a", "bc"), ("abc", None), ("abc", ""), (None, "abc")]
    seen = {digest_of(spark.createDataFrame([p], "a string, b string")) for p in pairs}
    arrays = [["ab"], ["a", "b"], ["", "ab"], [None, "ab"], [], None]
    seen |= {digest_of(spark.createDataFrame([(a,)], "a array<string>")) for a in arrays}
    assert len(seen) == len(pairs) + len(arrays)


def test_update_equals_recount(spark):
    rows = rows_of(50)
    gone, new = rows[:7] + rows[20:21], [(1000 + i, 1.0 * i, None, [], "new") for i in range(5)] + rows[30:31]
    stored = fp.table_sums(table(spark, rows))
    updated = fp.updated_sums(stored, table(spark, new), table(spark, gone))
    left = [r for r in rows if r not in gone] + new
    assert tuple(fp.digest(updated).first()) == digest_of(table(spark, left))
    back = fp.updated_sums(updated, table(spark, gone), table(spark, new))
    assert tuple(fp.digest(back).first()) == digest_of(table(spark, rows))


def test_checksums_of_files(spark):
    import hashlib
    root = scratch_path(spark, "sums")
    lines = spark.range(30).select((F.col("id") % 3).alias("b"), "id", F.concat(F.lit("line "), "id").alias("value"))
    fp.write_blocks(lines, "b", ["id"], f"{root}/files")
    want = {f"b={b}": hashlib.sha256("".join(f"line {i}\n" for i in range(b, 30, 3)).encode()).hexdigest() for b in range(3)}
    found = fp.block_digests(spark, f"{root}/files")
    assert {r.name: r.actual for r in found.collect()} == want
    listed = [("b=0", want["b=0"]), ("b=1", "0" * 64), ("b=9", "1" * 64)]
    fp.write_checksums(spark.createDataFrame(listed, "name string, expected string"), f"{root}/list")
    spark.createDataFrame([("a comment",), ("",)], "value string").write.mode("append").text(f"{root}/list")
    status = {r.name: r.status for r in fp.verified(fp.read_checksums(spark, f"{root}/list"), found).collect()}
    assert status == {"b=0": "MATCH", "b=1": "MISMATCH", "b=2": "NOT_LISTED", "b=9": "NOT_RECOVERED"}
