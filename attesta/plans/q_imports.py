"""Registered queries: whole imports of bundles made of the documents, and the lossless way out and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import vocabulary as v
from attesta.operators import imports
from attesta.plans.registry import query
from attesta.session import scratch_path, written
from attesta.sources import bundles

KIND_AUTHORITY = {"HUMAN_REFERENCE": "HUMAN_REFERENCE_ONLY", "BOOK_DONOR": "RESEARCH_DONOR"}
FIRST, SECOND = "doc_id % 4 <> 3", "doc_id % 4 <> 0"


def _sources(raw: DataFrame) -> DataFrame:
    """Sources whose authority suits their kind; a small table, stored so that the documents meet it where they are."""
    authority = F.lit("RESEARCH_SYNTHESIS")
    for kind, only in KIND_AUTHORITY.items():
        authority = F.when(F.col("source_kind") == kind, only).otherwise(authority)
    return written(raw.withColumn("authority_class", authority), "raw-sources")


def _items(lake, sources: DataFrame, where: str) -> DataFrame:
    rows = lake.raw_items().withColumn("doc_id", F.col("line")).where(where)
    human = rows.join(sources.select("source_id", "source_kind"), "source_id").withColumn(
        "item_type", F.when(F.col("source_kind") == "HUMAN_REFERENCE", "HUMAN_LENS")
        .when(F.col("item_type").isin("MYSTERY", "HUMAN_LENS"), "UNKNOWN").otherwise(F.col("item_type")))
    return human.select("doc_id", "item_id", *v.ITEM_CONTENT)


def _lines(lake, items: DataFrame, sources: DataFrame) -> DataFrame:
    """A bundle of at least four part files, read back as one."""
    support = items.where("doc_id % 5 = 1 and doc_id % 4 <> 0").select(
        F.lit("").alias("relation_id"), F.lit("SUPPORTS").alias("relation_type"), F.col("item_id").alias("from_item_id"),
        F.concat(F.lit("d"), F.col("doc_id") - F.col("doc_id") % 4).alias("to_item_id"))
    lines = bundles.bundle_export(items.drop("doc_id"), sources, support, {"format": "ref-jsonl/1", "seed_id": "documents"})
    path = scratch_path(lake.spark, "bundle")
    parts = max(4, int(lake.spark.conf.get("spark.sql.shuffle.partitions")))
    lines.repartitionByRange(parts, "part", "k1", "k2").sortWithinPartitions("part", "k1", "k2").select("value").write.option("compression", "gzip").text(path)
    return bundles.bundle_lines(lake.spark, path, by_folder=True)


def _first_lines(lake):
    sources = _sources(lake.raw_sources())
    return _lines(lake, _items(lake, sources, FIRST), sources)


def _second_lines(lake):
    """Three quarters of the documents, every sixth with another claim, and sources as they are now."""
    sources = _sources(lake.current_sources())
    claim = F.when(F.col("doc_id") % 6 == 0, F.concat("claim", F.lit(" (revised)"))).otherwise(F.col("claim"))
    return _lines(lake, _items(lake, sources, SECOND).withColumn("claim", claim), sources)


def _first(lake) -> imports.Imported:
    return imports.import_bundle(imports.empty_memory(lake.spark), _first_lines(lake), "documents", "v1")


def _second(lake) -> imports.Imported:
    return imports.import_bundle(_first(lake).after, _second_lines(lake), "documents", "v2")


IMPORT_SQL = """
WITH d AS (SELECT d.doc_id, 'd' || d.doc_id AS item_id, d.text, d.doc_id % 4 AS q, s.n AS n, s.source_id, s.revision, c.revision AS new_revision
  FROM documents d JOIN src s ON s.source_id = d.source JOIN cur c ON c.source_id = d.source),
m AS (SELECT *, q <> 3 AS was, q <> 0 AS comes, q IN (1, 2) AND (doc_id % 6 = 0 OR (doc_id % 5 <> 0 AND n % 3 = 0)) AS revised FROM d)
"""


@query("M1_import_counters", needs=("src", "cur"), sql=IMPORT_SQL + """,
c AS (SELECT count(*) AS all_docs, count(*) FILTER (was) AS first_items, count(*) FILTER (comes) AS second_items,
    count(*) FILTER (revised) AS revised, count(*) FILTER (q = 3) AS fresh, count(*) FILTER (q = 0) AS absent,
    count(*) FILTER (q IN (1, 2) AND doc_id % 25 = 0) AS marks1, count(*) FILTER (q = 3 AND doc_id % 25 = 0) AS marks2,
    count(*) FILTER (q IN (1, 2) AND doc_id % 5 = 1) AS edges1, count(*) FILTER (q = 3 AND doc_id % 5 = 1) AS edges2 FROM m),
s AS (SELECT count(*) AS n_sources, count(*) FILTER (n % 3 = 0) AS moved FROM src),
x AS (SELECT * FROM c CROSS JOIN s)
SELECT 'first' AS import, n_sources AS sources_inserted, 0::BIGINT AS sources_updated, 0::BIGINT AS sources_unchanged,
  first_items AS items_inserted, 0::BIGINT AS items_unchanged, 0::BIGINT AS items_revised, marks1 AS items_superseded,
  edges1 AS relations_inserted, 0::BIGINT AS relations_unchanged, 0::BIGINT AS not_in_this_seed FROM x
UNION ALL SELECT 'again', 0, 0, n_sources, 0, first_items, 0, 0, 0, edges1, 0 FROM x
UNION ALL SELECT 'second', 0, moved, n_sources - moved, fresh, second_items - fresh - revised, revised, marks2, edges2, edges1, absent FROM x""")
def import_counters(lake):
    """One bundle into an empty memory, the same again, and a later one with revisions."""
    first = _first(lake)
    runs = {"first": first, "again": imports.import_bundle(first.after, _first_lines(lake), "documents", "v1"),
            "second": imports.import_bundle(first.after, _second_lines(lake), "documents", "v2")}
    return reduce(DataFrame.unionByName, [run.counters.withColumn("import", F.lit(name)) for name, run in runs.items()])


@query("M1_import_state", needs=("src", "cur"), sql=IMPORT_SQL + """,
marked AS (SELECT m.*, CASE WHEN EXISTS (SELECT 1 FROM d AS later WHERE later.doc_id = m.doc_id + 1) AND (m.doc_id + 1) % 25 = 0
    AND (m.doc_id + 1) % 4 <> 0 THEN 'd' || (m.doc_id + 1) END AS by_id FROM m)
SELECT item_id AS logical_item_id, FALSE AS archived, sha256(text || CASE WHEN comes AND doc_id % 6 = 0 THEN ' (revised)' ELSE '' END) AS claim_hash,
  CASE WHEN by_id IS NULL THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS lifecycle, by_id AS superseded_by,
  CASE WHEN revised OR NOT was THEN new_revision ELSE revision END AS captured_revision,
  CASE WHEN was THEN 'v1' ELSE 'v2' END AS first_seed_version, CASE WHEN comes THEN 'v2' ELSE 'v1' END AS last_seed_version FROM marked
UNION ALL SELECT item_id, TRUE, sha256(text), 'SUPERSEDED', item_id, revision, 'v1', 'v1' FROM marked WHERE revised""")
def import_state(lake):
    """All items after both imports: current ones, and the archived versions of revised ones."""
    return imports.items_with_digests(_second(lake).after).select(
        "logical_item_id", (F.col("item_id") == F.col("version_id")).alias("archived"), F.col("claim").alias("claim_hash"),
        "lifecycle", "superseded_by", F.col("source_revision_at_capture").alias("captured_revision"), "first_seed_version",
        "last_seed_version")


@query("M1_import_refused", needs=("raw_items", "src"), sql="""
WITH r AS (SELECT r.item_type, s.source_kind, s.authority_class FROM raw_items r JOIN src s ON s.source_id = r.source_id),
bad AS (SELECT 'UNKNOWN_ITEM_TYPE' AS rule FROM r WHERE item_type = 'MYSTERY'
  UNION ALL SELECT 'LENS_REQUIRED' FROM r WHERE authority_class = 'HUMAN_REFERENCE_ONLY' AND item_type <> 'HUMAN_LENS'
  UNION ALL SELECT 'LENS_FORBIDDEN' FROM r WHERE authority_class IS DISTINCT FROM 'HUMAN_REFERENCE_ONLY' AND item_type = 'HUMAN_LENS'
  UNION ALL SELECT 'HUMAN_REFERENCE_PAIR' FROM r WHERE source_kind = 'HUMAN_REFERENCE' AND authority_class IS DISTINCT FROM 'HUMAN_REFERENCE_ONLY'
  UNION ALL SELECT 'BOOK_DONOR_PAIR' FROM r WHERE source_kind = 'BOOK_DONOR' AND authority_class IS DISTINCT FROM 'RESEARCH_DONOR')
SELECT rule, count(*) AS lines, (SELECT count(*) FROM documents WHERE doc_id % 4 <> 3) AS items_after FROM bad GROUP BY 1""")
def import_refused(lake):
    """A bundle with errors over a filled memory: all errors by rule, and as many items as before."""
    first = _first(lake)
    raw = lake.raw_items().withColumn("doc_id", F.col("line")).select("doc_id", "item_id", *v.ITEM_CONTENT)
    refused = imports.import_bundle(first.after, _lines(lake, raw, lake.raw_sources()), "documents", "v3")
    return (refused.errors.groupBy("rule").agg(F.count("*").alias("lines"))
            .withColumn("items_after", F.lit(refused.after.items.count()).cast("long")))


@query("S10_round_trip", needs=("src", "cur"), sql=IMPORT_SQL + """
SELECT 'items' AS table_name, count(*) + count(*) FILTER (revised) AS rows_before, 0::BIGINT AS only_before, 0::BIGINT AS only_after FROM m
UNION ALL SELECT 'sources', count(*), 0, 0 FROM src
UNION ALL SELECT 'relations', count(*) FILTER (doc_id % 5 = 1 AND q <> 0) + count(*) FILTER (doc_id % 25 = 0 AND q <> 0), 0, 0 FROM m""")
def round_trip(lake):
    """The memory after both imports, exported to several files and imported into an empty one: the same rows."""
    before = _second(lake).after
    path = scratch_path(lake.spark, "export")
    lines = imports.export_lines(before, {"format": "ref-jsonl/1", "kind": "export"})
    parts = max(5, int(lake.spark.conf.get("spark.sql.shuffle.partitions")))
    lines.repartitionByRange(parts, "part", "k1", "k2").sortWithinPartitions("part", "k1", "k2").select("value").write.option("compression", "gzip").text(path)
    back = imports.import_bundle(imports.empty_memory(lake.spark), bundles.bundle_lines(lake.spark, path, by_folder=True),
                                 "export", "x", restore=True).after
    # claims are compared by their SHA-256
    sides = {"items": (imports.items_with_digests(before), imports.items_with_digests(back)),
             "sources": (before.sources, back.sources), "relations": (before.relations, back.relations)}
    return reduce(DataFrame.unionByName, [
        bundles.compare_exports(was, now.select(*was.columns)).withColumn("table_name", F.lit(name)) for name, (was, now) in sides.items()])
