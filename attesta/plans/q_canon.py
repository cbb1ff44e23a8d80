"""Registered queries: record sets, packages, exports, gates and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import vocabulary as v
from attesta.functions.identity import content_hash
from attesta.functions.rules import Rule, violations
from attesta.functions.text import json_value
from attesta.operators import canon
from attesta.operators import reference as ref
from attesta.plans.registry import query
from attesta.plans.scale import lookup_join
from attesta.session import scratch_path
from attesta.sources import bundles
from attesta.sources.lake import pick

TYPES_SQL = ", ".join(f"'{t}'" for t in v.SEED_TYPES)
SECTION_SQL = "CASE type " + " ".join(f"WHEN '{t}' THEN '{s}'" for t, s in v.SECTION_OF_TYPE.items()) + " END"
ITEM_TYPE_SQL = "CASE type " + " ".join(f"WHEN '{t}' THEN '{s}'" for t, s in v.SEED_ITEM_TYPE.items()) + " END"
RECORDS_SQL = f"""
WITH rec AS (SELECT 'R' || o_orderkey AS id, list_extract([{TYPES_SQL}], CAST(o_orderkey % 13 + 1 AS INT)) AS type,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'CURRENT' WHEN '2' THEN 'ENGINEERING_RESULT' WHEN '3' THEN 'HISTORICAL'
   WHEN '4' THEN 'HYPOTHESIS' ELSE CASE WHEN o_orderstatus = 'F' THEN 'SUPERSEDED' ELSE 'DEFERRED' END END AS status,
  'statement ' || o_orderkey || ' of ' || o_custkey AS statement, 'src' || (o_custkey % 20) AS source,
  'SOURCE_DOC' AS provenance, 'scope ' || o_orderstatus AS scope, strftime(o_orderdate, '%Y-%m-%d') AS updated_at,
  'orders/' || o_orderkey AS details_pointer, o_custkey % 25 AS tenant, o_orderkey AS order_key FROM orders)
"""
PACKAGE_SQL = RECORDS_SQL + f"""
, pack AS (SELECT *, {SECTION_SQL} AS section FROM rec WHERE status NOT IN ('HISTORICAL', 'SUPERSEDED')),
core AS (SELECT * FROM pack WHERE section IN ('who', 'north_star', 'current_priority', 'active_threads', 'next', 'projects', 'invariants')
  AND status <> 'DEFERRED' AND type <> 'DEFERRED_ITEM')
"""


def seed_records(lake):
    """One record per order; the tenant is a package of its own."""
    key, level = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    status = (F.when(level == "1", "CURRENT").when(level == "2", "ENGINEERING_RESULT").when(level == "3", "HISTORICAL")
              .when(level == "4", "HYPOTHESIS").when(F.col("o_orderstatus") == "F", "SUPERSEDED").otherwise("DEFERRED"))
    n = (F.col("o_custkey") % 20).cast("int")
    return lake.table("orders").select(
        F.concat(F.lit("R"), key).alias("id"), pick(v.SEED_TYPES, key).alias("type"), status.alias("status"),
        F.concat(F.lit("statement "), key, F.lit(" of "), "o_custkey").alias("statement"),
        F.concat(F.lit("src"), n).alias("source"), F.lit("SOURCE_DOC").alias("provenance"),
        F.concat(F.lit("scope "), "o_orderstatus").alias("scope"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"),
        F.concat(F.lit("orders/"), key).alias("details_pointer"), (F.col("o_custkey") % 25).alias("tenant"),
        pick(v.AUTHORITY_CLASSES, n).alias("authority_class"), key.alias("order_key"))


def _package(lake):
    return canon.in_sections(seed_records(lake))


@query("P17_seed_item_type", sql=RECORDS_SQL + f"""
SELECT order_key AS record_id, CASE WHEN CAST(substr(source, 4) AS INT) % 9 = 4 THEN 'HUMAN_LENS'
  WHEN type = 'RESEARCH_RESULT' AND status = 'ENGINEERING_RESULT' THEN 'VALIDATION_RESULT'
  ELSE coalesce({ITEM_TYPE_SQL}, CASE WHEN status IN ('HISTORICAL', 'SUPERSEDED') THEN 'HISTORICAL_NOTE'
    WHEN status = 'HYPOTHESIS' THEN 'HYPOTHESIS' ELSE 'UNKNOWN' END) END AS item_type FROM rec""")
def seed_item_type(lake):
    return seed_records(lake).select(F.col("order_key").alias("record_id"), canon.mapped_item_type().alias("item_type"))


@query("P9_section_selection", sql=PACKAGE_SQL + """
SELECT tenant, section, id, CASE WHEN type = 'DEFERRED_ITEM' THEN 1 ELSE 0 END AS late FROM pack""")
def section_selection(lake):
    return _package(lake).select("tenant", "section", "id", "late")


@query("F6_live_records", sql=RECORDS_SQL + """
SELECT type, count(*) AS live FROM rec WHERE status NOT IN ('HISTORICAL', 'SUPERSEDED') GROUP BY 1""")
def live_records(lake):
    return seed_records(lake).where(canon.is_live()).groupBy("type").agg(F.count("*").alias("live"))


@query("P10_core_and_excluded", sql=PACKAGE_SQL + """
SELECT p.tenant, (SELECT count(*) FROM core c WHERE c.tenant = p.tenant) AS core_records,
  count(*) FILTER (WHERE section = 'known') AS excluded_known,
  count(*) FILTER (WHERE section = 'known_limitations') AS excluded_known_limitations,
  count(*) FILTER (WHERE section = 'open') AS excluded_open, count(*) FILTER (WHERE section = 'sources') AS excluded_sources,
  count(*) FILTER (WHERE section = 'next' AND (type = 'DEFERRED_ITEM' OR status = 'DEFERRED')) AS excluded_deferred
FROM pack p GROUP BY p.tenant""")
def core_and_excluded(lake):
    return canon.excluded_counts(_package(lake), ["tenant"])


@query("P11_record_projection", sql=RECORDS_SQL + """
SELECT id, type, status, statement, source, provenance, scope, updated_at, details_pointer FROM rec""")
def record_projection(lake):
    return seed_records(lake).select(*v.PACKAGE_FIELDS)


LINES_SQL = PACKAGE_SQL + r"""
, lines AS (SELECT tenant, section, CASE WHEN type = 'DEFERRED_ITEM' THEN 1 ELSE 0 END AS late, order_key,
   '- ' || id || ' [' || type || ' · ' || status || '] ' || statement || chr(10) || '  - source: ' || source || '; provenance: '
   || provenance || '; scope: ' || scope || '; updated: ' || updated_at || '; details: ' || details_pointer AS line FROM core
 UNION ALL SELECT DISTINCT tenant, section, -1, CAST(-1 AS BIGINT), '## ' || upper(section) FROM core)
"""


@query("S14_rendered_start_view", sql=LINES_SQL + "SELECT tenant, section, late, order_key, line FROM lines")
def rendered_start_view(lake):
    """Lines of the start view in order: a range-partitioned sort, no text of a tenant is put together in one task."""
    rows = canon.rendered(_package(lake), ["tenant"])
    return rows.orderBy("tenant", "section_place", "late", "order_key").select("tenant", "section", "late", "order_key", "line")


@query("X18_render_lines", sql=LINES_SQL + """
SELECT tenant, sum(length(line))::BIGINT + count(*) - 1 AS chars, count(*) FILTER (WHERE late >= 0) AS records,
  CAST(floor((sum(length(line)) + count(*) - 1) / 4.0 + 0.5) AS BIGINT) AS approx_tokens FROM lines GROUP BY tenant""")
def render_lines(lake):
    return canon.render_size(canon.rendered(_package(lake), ["tenant"]), ["tenant"])


@query("S13_context_package", sql=PACKAGE_SQL + """
, gate AS (SELECT tenant, count(*) % 2 = 0 AS ok FROM rec GROUP BY 1)
SELECT p.tenant, section, count(*) AS records FROM pack p JOIN gate g ON g.tenant = p.tenant AND ok GROUP BY 1, 2""")
def context_package(lake):
    """Only packages that pass the gate are exported; here the manifest of every odd-sized one is wrong."""
    records = seed_records(lake).withColumn("record_hash", content_hash(v.PACKAGE_FIELDS))
    manifest = _manifest(records)
    gate = canon.integrity_gate(records, _no_violations(records), manifest, ["tenant"]).where("ok").select("tenant")
    path = bundles.export_packages(_package(lake), gate, "tenant", v.PACKAGE_FIELDS, scratch_path(lake.spark, "packages"))
    schema = ", ".join(f"{c} string" for c in ["section", *v.PACKAGE_FIELDS]) + ", tenant long"
    rows = lake.spark.read.schema(schema).json(path)
    return rows.groupBy("tenant", "section").agg(F.count("*").alias("records"))


def _manifest(records):
    """Expected count (one too many for odd packages) and digest of every package."""
    n = F.count("*")
    return records.groupBy("tenant").agg(F.when(n % 2 == 0, n).otherwise(n + 1).alias("expected_count"),
                                         canon.content_digest("record_hash").alias("expected_digest"))


def _no_violations(records):
    return records.where(F.lit(False)).select("tenant")


@query("V16_integrity_gate", sql=RECORDS_SQL + """
SELECT tenant, count(*) FILTER (WHERE order_key % 5000 = 77) = 0 AS rules_ok, count(*) % 2 = 0 AS count_ok,
  TRUE AS content_ok, count(*) FILTER (WHERE order_key % 5000 = 77) = 0 AND count(*) % 2 = 0 AS ok FROM rec GROUP BY tenant""")
def integrity_gate(lake):
    records = seed_records(lake).withColumn("record_hash", content_hash(v.PACKAGE_FIELDS))
    broken = records.where("order_key % 5000 = 77").select("tenant")
    return canon.integrity_gate(records, broken, _manifest(records), ["tenant"])


@query("V12_record_rules", sql=RECORDS_SQL + """
SELECT 'SOURCE_NOT_LISTED' AS rule, 'ERROR' AS severity, id AS key FROM rec WHERE source NOT IN ('src1', 'src2', 'src3', 'src4', 'src5')
UNION ALL SELECT 'SOURCE_KIND_DIFFERS', 'ERROR', id FROM rec WHERE source = 'src5'
UNION ALL SELECT 'SUPERSEDED_WITHOUT_SUCCESSOR', 'ERROR', id FROM rec WHERE status = 'SUPERSEDED'""")
def record_rules(lake):
    listed = lake.raw_sources().where(F.col("source_id").isin("src1", "src2", "src3", "src4", "src5")).select(
        F.col("source_id").alias("source"), F.when(F.col("source_id") == "src5", "OTHER").otherwise("DOC").alias("known_kind"))
    records = (seed_records(lake).withColumn("source_kind", F.lit("DOC")).withColumn("valid_from", F.col("updated_at"))
               .withColumn("superseded_by", F.lit(None).cast("string")))
    return violations(lookup_join(records, listed, ["source"], ["id"]), F.col("id"), canon.record_rules())


@query("V12_relation_targets", sql="""
WITH e AS (SELECT DISTINCT l_orderkey AS id, CASE WHEN l_linenumber = 7 THEN l_orderkey ELSE l_partkey END AS target,
  CASE WHEN l_linenumber = 6 THEN 'MADE_UP' ELSE 'SUPPORTS' END AS rel FROM lineitem)
SELECT id, target, 'RELATION_NOT_ALLOWED' AS rule FROM e WHERE rel = 'MADE_UP'
UNION ALL SELECT id, target, 'TARGET_MISSING' FROM e WHERE target NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 1)
UNION ALL SELECT id, target, 'SELF_RELATION' FROM e WHERE id = target""")
def relation_targets(lake):
    line = F.col("l_linenumber")
    edges = lake.table("lineitem").select(
        F.col("l_orderkey").alias("id"), F.when(line == 7, F.col("l_orderkey")).otherwise(F.col("l_partkey")).alias("target"),
        F.when(line == 6, "MADE_UP").otherwise("SUPPORTS").alias("rel")).distinct()
    records = lake.table("orders").where("o_orderkey % 10 <> 1").select(F.col("o_orderkey").alias("id"))
    return canon.edge_violations(edges, records)


@query("A2_record_stats", sql=RECORDS_SQL + """
SELECT 'type' AS dimension, type AS value, count(*) AS records FROM rec GROUP BY 2
UNION ALL SELECT 'status', status, count(*) FROM rec GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM rec GROUP BY 2""")
def record_stats(lake):
    return canon.set_stats(seed_records(lake), ["type", "status", "source"])


@query("A21_registry_counts", sql="""
SELECT kind, mechanism, count(*) AS entries FROM (
  SELECT 'part' AS kind, unnest(string_split(p_name, ' ')) AS mechanism FROM part
  UNION ALL SELECT 'type', p_type FROM part) GROUP BY 1, 2""")
def registry_counts(lake):
    rows = lake.table("part").select(F.explode(F.concat(
        F.transform(F.split("p_name", " "), lambda w: F.struct(F.lit("part").alias("kind"), w.alias("mechanism"))),
        F.array(F.struct(F.lit("type").alias("kind"), F.col("p_type").alias("mechanism"))))).alias("m"))
    return rows.groupBy("m.kind", "m.mechanism").agg(F.count("*").alias("entries"))


# ---- readers and writers ----------------------------------------------------
def _bundle_items(lake):
    sources = ref.normalise_sources(lake.raw_sources())
    return ref.bind_items(lake.raw_items(), sources, hashed=True), sources


def _written_bundle(lake):
    items, sources = _bundle_items(lake)
    lines = bundles.bundle_export(items.select("item_id", *v.ITEM_CONTENT, "version_id"), sources, _bundle_relations(lake),
                                  {"format": "ref-jsonl/1", "seed_id": "documents"})
    return bundles.write_ordered(lines, ["part", "k1", "k2"], scratch_path(lake.spark, "bundle"))


def _bundle_relations(lake):
    items = lake.raw_items(False).where(F.col("supersedes_item_id") != "")
    return items.select(F.concat(F.lit("rel:"), "item_id").alias("relation_id"), F.lit("SUPERSEDES").alias("relation_type"),
                        F.col("item_id").alias("from_item_id"), F.col("supersedes_item_id").alias("to_item_id"))


@query("S1_bundle_reader", needs=("raw_items",), sql="""
SELECT kind, count(*) AS records, count(DISTINCT key) AS ids FROM (
  SELECT 'item' AS kind, item_id AS key FROM raw_items
  UNION ALL SELECT 'relation', item_id FROM raw_items WHERE supersedes_item_id <> ''
  UNION ALL SELECT 'manifest', 'documents') GROUP BY 1""")
def bundle_reader(lake):
    """Documents written as a bundle and read back line by line."""
    parsed = bundles.parse_lines(bundles.bundle_lines(lake.spark, _written_bundle(lake)))
    key = F.coalesce(F.col("record.item.item_id"), F.expr("substring(record.relation.relation_id, 5)"), F.col("record.manifest.seed_id"))
    return parsed.select("kind", key.alias("key")).groupBy("kind").agg(F.count("*").alias("records"),
                                                                      F.count_distinct("key").alias("ids"))


@query("S10_bundle_export", needs=("items", "src"), sql="""
SELECT part, count(*) AS lines FROM (SELECT 0 AS part UNION ALL SELECT 1 FROM items
  UNION ALL SELECT 2 FROM src WHERE source_id NOT IN (SELECT source_id FROM items)
  UNION ALL SELECT 3 FROM items WHERE supersedes_item_id IS NOT NULL) GROUP BY 1""")
def bundle_export(lake):
    items, sources = _bundle_items(lake)
    lines = bundles.bundle_export(items, sources, _bundle_relations(lake), {"format": "ref-jsonl/1"})
    return lines.groupBy("part").agg(F.count("*").alias("lines"))


@query("S12_seed_to_bundle", sql=RECORDS_SQL + f"""
SELECT 'seed:' || id AS item_id, 'seed:src:' || source AS source_id, '[' || type || ' · ' || status || '] ' || statement AS claim,
  CASE WHEN CAST(substr(source, 4) AS INT) % 9 = 4 THEN 'HUMAN_LENS'
   WHEN type = 'RESEARCH_RESULT' AND status = 'ENGINEERING_RESULT' THEN 'VALIDATION_RESULT'
   ELSE coalesce({ITEM_TYPE_SQL}, CASE WHEN status IN ('HISTORICAL', 'SUPERSEDED') THEN 'HISTORICAL_NOTE'
     WHEN status = 'HYPOTHESIS' THEN 'HYPOTHESIS' ELSE 'UNKNOWN' END) END AS item_type,
  'SOURCE_ASSERTION' AS epistemic_state FROM rec""")
def seed_to_bundle(lake):
    state = canon.lookup({"USER_RAW": "USER_RAW", "SOURCE_DOC": "SOURCE_ASSERTION", "AI_SUMMARY": "AI_SUMMARY"}, F.col("provenance"))
    return seed_records(lake).select(
        F.concat(F.lit("seed:"), "id").alias("item_id"), F.concat(F.lit("seed:src:"), "source").alias("source_id"),
        F.concat(F.lit("["), "type", F.lit(" · "), "status", F.lit("] "), "statement").alias("claim"),
        canon.mapped_item_type().alias("item_type"), state.alias("epistemic_state"))


@query("S12_mapped_relations", sql="""
WITH e AS (SELECT list_extract(['MOTIVATED_BY', 'SUPPORTS', 'USES_SOURCE', 'SUPERSEDED_BY'], CAST(l_linenumber % 4 + 1 AS INT)) AS rel FROM lineitem)
SELECT rel, CASE rel WHEN 'MOTIVATED_BY' THEN 'RELATED_TO' WHEN 'SUPPORTS' THEN 'SUPPORTS' ELSE 'DOCUMENTED_IN' END AS relation_type,
  count(*) AS edges FROM e WHERE rel <> 'SUPERSEDED_BY' GROUP BY 1""")
def mapped_relations(lake):
    edges = lake.table("lineitem").select(pick(["MOTIVATED_BY", "SUPPORTS", "USES_SOURCE", "SUPERSEDED_BY"], F.col("l_linenumber")).alias("rel"))
    return canon.mapped_relations(edges).groupBy("rel", "relation_type").agg(F.count("*").alias("edges"))


@query("S2_work_import_reader", sql="""
SELECT 'projects' AS table_name, count(*) AS row_count, TRUE AS fields_ok FROM nation UNION ALL
SELECT 'sources', count(*), TRUE FROM supplier""")
def work_import_reader(lake):
    """Export documents (one per region and nation) written as files, read back and split into their arrays."""
    nations = lake.table("nation").select("n_nationkey", F.struct(
        F.col("n_nationkey").cast("string").alias("project_id"), F.concat(F.lit("N"), "n_nationkey").alias("code"),
        F.col("n_name").alias("name"), F.lit("").alias("summary"), F.lit("2024-01-01").alias("created_at"),
        F.lit("2024-01-01").alias("updated_at")).alias("project"))
    key = F.col("s_suppkey")
    sources = lake.table("supplier").select(F.col("s_nationkey").alias("n_nationkey"), F.struct(
        F.concat(F.lit("s"), key).alias("source_id"), F.col("s_nationkey").cast("string").alias("project_id"),
        pick(v.WORK_SURFACES, key).alias("surface"), pick(v.WORK_ROLES, key).alias("role"), F.col("s_name").alias("title"),
        F.concat(F.lit("loc:"), key).alias("locator"), F.lit("").alias("revision"), F.lit("").alias("note"),
        F.lit("2024-01-01").alias("created_at"), F.lit("2024-01-01").alias("updated_at")).alias("source"))
    # one small document per source row, so that no array grows with the data
    none = F.array().cast("array<string>")
    rest = [none.alias(n) for n in ("items", "item_sources", "relations", "changes")]
    one = nations.select(F.to_json(F.struct(F.lit("work-export/1").alias("format"), F.array("project").alias("projects"),
                                            none.alias("sources"), *rest)).alias("value"))
    two = sources.select(F.to_json(F.struct(F.lit("work-export/1").alias("format"), none.alias("projects"),
                                            F.array("source").alias("sources"), *rest)).alias("value"))
    path = scratch_path(lake.spark, "work-export")
    one.unionByName(two).write.mode("errorifexists").text(path)
    lines = lake.spark.read.text(path).withColumn("file", F.input_file_name())
    documents = lines.withColumn("keys_ok", F.size(F.json_object_keys("value")) == 7)
    parts = [bundles.work_rows(documents, t).agg(F.count("*").alias("row_count"), F.every("fields_ok").alias("fields_ok"))
             .select(F.lit(t).alias("table_name"), "row_count", "fields_ok") for t in ("projects", "sources")]
    return parts[0].unionByName(parts[1])


@query("S5_package_status", sql="""
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'LOAD_ERROR' WHEN event_id % 5 = 0 THEN 'INTEGRITY_FAIL' ELSE 'READY' END AS status,
  CASE WHEN event_id % 7 <> 0 AND event_id % 5 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS payload FROM events""")
def package_status(lake):
    """Unreadable packages, packages that fail their gate, and ready ones; the payload only comes with READY."""
    key = F.col("event_id")
    raw = (F.when(key % 7 == 0, F.substring("props", 1, 4)).when(key % 5 == 0, F.replace("props", F.lit('"k"'), F.lit('"j"')))
           .otherwise(F.col("props")))
    rows = lake.table("events").select("event_id", raw.alias("raw")).withColumn("k", F.get_json_object("raw", "$.k").cast("long"))
    parsed = json_value(F.col("raw")).isNotNull()
    status = canon.package_status(parsed, [Rule("FIELD_MISSING", F.col("k").isNull())])
    return rows.withColumn("status", status).select("event_id", "status", F.when(F.col("status") == "READY", F.col("k")).alias("payload"))


@query("V17_package_gate", sql=RECORDS_SQL + """
SELECT tenant, CASE WHEN count(DISTINCT type) < 13 THEN 'SECTION_MISSING'
  WHEN count(*) FILTER (WHERE order_key % 2500 = 1249) > 0 THEN 'FIELD_MISSING'
  WHEN count(*) % 2 <> 0 THEN 'COUNT_DIFFERS' ELSE 'READY' END AS status FROM rec GROUP BY tenant""")
def package_gate(lake):
    """First failing gate of each package: sections, non-empty fields, count and content of the manifest."""
    empty = F.when(F.col("order_key") % 2500 == 1249, "").otherwise(F.col("scope"))
    records = seed_records(lake).withColumn("record_hash", content_hash(v.PACKAGE_FIELDS)).withColumn("scope", empty)
    blank = F.lit(False)
    for field in v.PACKAGE_FIELDS:
        blank = blank | (F.coalesce(F.col(field), F.lit("")) == "")
    found = records.groupBy("tenant").agg(
        F.count_distinct("type").alias("types"), F.count_if(blank).alias("blanks"), F.count("*").alias("n"),
        canon.content_digest("record_hash").alias("digest"))
    from attesta.functions.rules import first_violation
    rules = [Rule("SECTION_MISSING", F.col("types") < len(v.SEED_TYPES)), Rule("FIELD_MISSING", F.col("blanks") > 0),
             Rule("COUNT_DIFFERS", F.col("n") != F.col("expected_count")),
             Rule("CONTENT_DIFFERS", F.col("digest") != F.col("expected_digest"))]
    joined = found.join(_manifest(records), "tenant")
    return joined.select("tenant", first_violation(rules, "READY").alias("status"))


@query("S7_registry_reader", sql="""
SELECT p_brand AS brand, count(*) AS entries, CAST(sum(len(string_split(p_name, ' '))) AS BIGINT) AS words FROM part GROUP BY 1""")
def registry_reader(lake):
    """Registry as JSON lines with string arrays, written and read back with its schema."""
    rows = lake.table("part").select("p_brand", F.split("p_name", " ").alias("mechanisms"))
    back = bundles.read_lines(lake.spark, bundles.write_lines(rows, "registry"), rows.schema)
    return back.groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("entries"),
                                                            F.sum(F.size("mechanisms")).cast("long").alias("words"))


SEED_FILE_ROWS = 20_000  # some 7 MB: a file is hashed in the memory of one task


@query("S4_seed_and_manifest", sql=RECORDS_SQL + """
SELECT count(*) AS records, count(DISTINCT tenant) AS tenants, TRUE AS digests_match FROM rec""")
def seed_and_manifest(lake):
    """Record set written as JSON lines; its files are hashed in the tasks and checked against their list."""
    rows = seed_records(lake)
    path = bundles.write_lines(rows, "seed", SEED_FILE_ROWS)
    digests = bundles.file_digests(lake.spark, f"{path}/part-*")
    listed = digests.select("name", F.col("actual").alias("expected"))
    checked = bundles.verify_digests(listed, digests).agg(F.every(F.col("status") == "MATCH").alias("ok"))
    back = bundles.read_lines(lake.spark, path, rows.schema)
    return back.agg(F.count("*").alias("records"), F.count_distinct("tenant").alias("tenants")).withColumn(
        "digests_match", checked.scalar())


@query("S9_store_profile", sql="""
SELECT 'events' AS store, 'OK' AS status, count(*) AS row_count, count(*) >= 13500 AS near_cap FROM events
UNION ALL SELECT 'orders', 'OK', count(*), count(*) >= 13500 FROM orders
UNION ALL SELECT 'documents', 'OK', count(*), count(*) >= 13500 FROM documents
UNION ALL SELECT 'snapshots', 'STORE_MISSING', NULL, FALSE""")
def store_profile(lake):
    return bundles.store_profile({"events": lake.table("events"), "orders": lake.table("orders"),
                                  "documents": lake.table("documents"), "snapshots": None}, cap=15000)


@query("S11_work_export", needs=("wi",), sql="""
SELECT count(*) AS items, count(nullif(status_note, '')) AS with_note, min(work_id) AS first_id, max(work_id) AS last_id FROM wi""")
def work_export(lake):
    """Items written in key order with normalised nulls and read back."""
    rows = lake.work_items().withColumn("status_note", F.nullif(F.col("status_note"), F.lit("")))
    path = scratch_path(lake.spark, "items")
    rows.orderBy("work_id").write.mode("errorifexists").json(path)
    back = bundles.read_lines(lake.spark, path, rows.schema)
    return back.agg(F.count("*").alias("items"), F.count("status_note").alias("with_note"),
                    F.min("work_id").alias("first_id"), F.max("work_id").alias("last_id"))


@query("S15_namespace_clear", sql="""
SELECT count(*) AS kept_in_old, CAST(0 AS BIGINT) AS rows_in_new, 'schema_version' AS kept_key FROM nation""")
def namespace_clear(lake):
    """Publishing an empty snapshot: the old one stays readable, the schema version is carried over."""
    from attesta.operators import merge
    spark = lake.spark
    rows = lake.table("nation")
    meta = rows.limit(1).select(F.lit("schema_version").alias("key"), F.lit("3").alias("value"))
    nothing = rows.where(F.lit(False))
    root = scratch_path(spark, "namespace")
    old = merge.commit({"items": rows, "meta": meta}, nothing, root)
    merge.commit({"items": nothing, "meta": meta}, nothing, root)
    new = merge.published(spark, root)
    before = spark.read.parquet(f"{old}/items").agg(F.count("*").alias("kept_in_old"))
    after = spark.read.schema(rows.schema).parquet(f"{new}/items").agg(F.count("*").alias("rows_in_new")).scalar()
    key = spark.read.parquet(f"{new}/meta").select("key").scalar()
    return before.withColumn("rows_in_new", after).withColumn("kept_key", key)


@query("M1_two_phase_import", sql="""
SELECT 'refused' AS first_import, 'committed' AS second_import, count(*) AS published_rows FROM orders""")
def two_phase_import(lake):
    """An import with one bad row leaves nothing behind; the clean one is published."""
    from attesta.operators import merge
    spark = lake.spark
    rows = lake.table("orders").select("o_orderkey", "o_orderstatus")
    root = scratch_path(spark, "import")
    try:
        merge.commit({"items": rows}, rows.where("o_orderkey = 77"), root)
        outcome = "committed"
    except merge.ImportRefused:
        outcome = "refused"
    merge.commit({"items": rows}, rows.where("o_orderstatus = 'Z'"), root)
    back = spark.read.parquet(f"{merge.published(spark, root)}/items")
    return back.agg(F.count("*").alias("published_rows")).select(
        F.lit(outcome).alias("first_import"), F.lit("committed").alias("second_import"), "published_rows")


@query("M12_publish_gate", sql="""
SELECT 'fresh' AS first_state, 'stale' AS second_state, count(*) AS served_rows FROM nation""")
def publish_gate(lake):
    """An invalid candidate keeps the last good snapshot, flagged as stale."""
    from attesta.operators import merge
    spark = lake.spark
    root = scratch_path(spark, "publish")
    rows = lake.table("nation")
    good, first = merge.publish_if_valid(rows, rows.where("n_nationkey < 0"), root, None)
    served, second = merge.publish_if_valid(rows.where("n_nationkey > 3"), rows.where("n_nationkey = 3"), root, good)
    return spark.read.parquet(served).agg(F.count("*").alias("served_rows")).select(
        F.lit(first).alias("first_state"), F.lit(second).alias("second_state"), "served_rows")


@query("V19_namespace_completeness", sql="""
SELECT 'events' AS store, 'FILLED' AS state FROM (SELECT 1) UNION ALL SELECT 'nation', 'FILLED'
UNION ALL SELECT 'labels', 'FILLED' UNION ALL SELECT 'wm_changes', 'STORE_MISSING'""")
def namespace_completeness(lake):
    """Every expected store exists, and a first load requires all of them to be empty."""
    tables = {"events": lake.table("events"), "nation": lake.table("nation"), "labels": lake.table("labels"), "wm_changes": None}
    profile = bundles.store_profile(tables, cap=1)
    state = F.when(F.col("status") != "OK", F.col("status")).when(F.col("row_count") == 0, "EMPTY").otherwise("FILLED")
    return profile.select("store", state.alias("state"))


@query("V20_private_scan", sql=r"""
SELECT doc_id, 'HEX_ID' AS rule FROM documents WHERE regexp_matches(text, '(?i)(^|[^0-9a-z_])[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}([^0-9a-z_]|$)')
UNION ALL SELECT doc_id, 'CREDENTIAL_WORD' FROM documents WHERE regexp_matches(text, '(?i)(password|passwd|api[_-]?key|secret|token|bearer)')
UNION ALL SELECT doc_id, 'EMAIL' FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}')
UNION ALL SELECT doc_id, 'PRIVATE_URL' FROM documents WHERE regexp_matches(text, '(notion\.so/|notion\.site/|docs\.google\.com/|drive\.google\.com/)')
UNION ALL SELECT doc_id, 'LISTED_WORD' FROM documents WHERE contains(lower(text), 'lytionver') OR contains(lower(text), 'token')""")
def private_scan(lake):
    """Rules and a given word list over whole texts, in one scan; only the rule that hit is reported."""
    listed = ["lytionver", "TOKEN"]
    lowered = F.lower("text")
    rules = bundles.secret_rules()
    rules["LISTED_WORD"] = F.lit(False)
    for word in listed:
        rules["LISTED_WORD"] = rules["LISTED_WORD"] | lowered.contains(word.lower())
    rows = violations(lake.texts("documents", "doc_id"), F.col("doc_id"), [Rule(k, c) for k, c in rules.items()])
    return rows.select(F.col("key").cast("long").alias("doc_id"), "rule")
