"""Registered queries: reference memory records, provenance and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import identity as ident
from attesta.functions import vocabulary as v
from attesta.functions.rules import violations
from attesta.operators import reference as ref
from attesta.operators.integrity import conflicting_records, duplicate_keys, present_in
from attesta.plans.registry import query
from attesta.plans.scale import lookup_join

ITEM_JSON = ", ".join(f"CAST({c} AS VARCHAR)" for c in v.ITEM_CONTENT)
ITEM_HASH = f"sha256(CAST(to_json([{ITEM_JSON}]) AS VARCHAR))"


def _sources(lake):
    return ref.normalise_sources(lake.raw_sources())


def _current(lake):
    return ref.normalise_sources(lake.current_sources())


def _items(lake, with_text=False, hashed=False):
    return ref.bind_items(lake.raw_items(with_text), _sources(lake), hashed)


def _marked(lake):
    return ref.mark_superseded(_items(lake), lake.raw_items(False))


@query("P1_normalise_source", needs=("src",), sql="""
SELECT source_id, title, surface, source_kind, authority_class, project_id, locator, revision, as_of, currentness,
       privacy, content_hash FROM src""")
def normalise_source(lake):
    return _sources(lake).drop("record_hash")


@query("P2_normalise_item", needs=("items",), sql="""
SELECT item_id, source_id, project_id, item_type, source_section, source_status, epistemic_state, confidence, as_of,
       supersedes_item_id FROM items""")
def normalise_item(lake):
    return _items(lake).select("item_id", "source_id", "project_id", "item_type", "source_section", "source_status",
                               "epistemic_state", "confidence", "as_of", "supersedes_item_id")


@query("P3_normalise_relation", needs=("edges",), sql="""
SELECT 'rel:' || relation_type || ':' || from_item_id || '->' || to_item_id AS relation_id,
       'SOURCE_ASSERTION' AS epistemic_status, count(*) AS declared
FROM edges GROUP BY ALL""")
def normalise_relation(lake):
    raw = lake.relations().select("from_item_id", "to_item_id", "relation_type", F.lit("").alias("relation_id"),
                                  F.lit("").alias("epistemic_status"))
    return ref.normalise_relations(raw).groupBy("relation_id", "epistemic_status").agg(F.count("*").alias("declared"))


@query("P4_capture_snapshot", needs=("items",), sql="""
SELECT item_id, source_title AS source_title_at_capture, source_surface AS source_surface_at_capture,
       source_kind AS source_kind_at_capture, source_authority_class AS source_authority_class_at_capture,
       source_revision AS source_revision_at_capture, source_as_of AS source_as_of_at_capture,
       source_currentness AS source_currentness_at_capture, source_content_hash AS source_content_hash_at_capture
FROM items""")
def capture_snapshot(lake):
    return _items(lake).select("item_id", *ref.CAPTURED.values())


EVIDENCE_SQL = """
, sup AS (SELECT supersedes_item_id AS item_id, min_by(item_id, doc_id) AS superseded_by FROM items
          WHERE supersedes_item_id IS NOT NULL GROUP BY 1),
j AS (SELECT i.*, s.superseded_by, CASE WHEN s.superseded_by IS NULL THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS lifecycle,
        c.title AS ct, c.surface AS cs, c.source_kind AS ck, c.authority_class AS ca, c.revision AS cr,
        c.as_of AS co, c.currentness AS cc, c.content_hash AS ch, c.project_id AS cp, c.locator AS cl,
        coalesce(i.source_title, c.title) AS et, coalesce(i.source_surface, c.surface) AS es,
        coalesce(i.source_kind, c.source_kind) AS ek, coalesce(i.source_authority_class, c.authority_class) AS ea,
        coalesce(i.source_revision, c.revision) AS er, coalesce(i.source_as_of, c.as_of) AS eo,
        coalesce(i.source_currentness, c.currentness) AS ec, coalesce(i.source_content_hash, c.content_hash) AS eh
      FROM items i JOIN cur c ON c.source_id = i.source_id LEFT JOIN sup s ON s.item_id = i.item_id),
e AS (SELECT *, concat_ws(',', CASE WHEN et IS DISTINCT FROM ct THEN 'title' END,
          CASE WHEN es IS DISTINCT FROM cs THEN 'surface' END, CASE WHEN ek IS DISTINCT FROM ck THEN 'source_kind' END,
          CASE WHEN ea IS DISTINCT FROM ca THEN 'authority_class' END,
          CASE WHEN er IS DISTINCT FROM cr THEN 'revision' END, CASE WHEN eo IS DISTINCT FROM co THEN 'as_of' END,
          CASE WHEN ec IS DISTINCT FROM cc THEN 'currentness' END,
          CASE WHEN eh IS DISTINCT FROM ch THEN 'content_hash' END) AS changed_fields,
        coalesce(es = 'github' AND ea = 'IMPLEMENTATION_EVIDENCE', FALSE) AS impl,
        coalesce(ec = 'DRAFT', FALSE) OR regexp_matches(concat_ws(' ', source_status, ec),
          '(?i)(^|[^A-Za-z0-9_])(draft|branch|unmerged|open pr)([^A-Za-z0-9_]|$)') AS draft FROM j)
"""


CAVEATS_SQL = """concat_ws('|',
         CASE WHEN es = 'demo' OR ea = 'DEMO_ONLY' THEN 'DEMO_DATA' END,
         CASE WHEN es = 'fixture' THEN 'TEST_FIXTURE' END,
         CASE WHEN ea = 'NAVIGATION_ONLY' THEN 'ROUTE_ONLY' END,
         CASE WHEN ea = 'HUMAN_REFERENCE_ONLY' OR item_type = 'HUMAN_LENS' THEN 'HUMAN_LENS' END,
         CASE WHEN ea = 'HISTORICAL_ONLY' OR ec = 'HISTORICAL' OR item_type = 'HISTORICAL_NOTE' THEN 'HISTORICAL_NOTE' END,
         CASE WHEN ea = 'RESEARCH_DONOR' THEN 'BOOK_NOT_CANON' END,
         CASE WHEN NOT impl AND (item_type IN ('IMPLEMENTATION_FACT', 'VALIDATION_RESULT', 'ARCHITECTURE_POSITION')
              OR es IN ('notion', 'drive')) THEN 'NOT_IMPLEMENTATION_EVIDENCE' END,
         CASE WHEN item_type IN ('IMPLEMENTATION_FACT', 'VALIDATION_RESULT') OR ek = 'IMPLEMENTATION'
              THEN 'CACHED_STATE:' || coalesce(as_of, eo, 'UNKNOWN') END,
         CASE WHEN draft THEN 'DRAFT_STATE' END,
         CASE WHEN lifecycle = 'SUPERSEDED' THEN 'SUPERSEDED:' || superseded_by END,
         CASE WHEN changed_fields <> '' THEN 'SOURCE_CHANGED:' || changed_fields || ';captured=' || coalesce(er, '-')
              || '/' || coalesce(eo, '-') || ';now=' || coalesce(cr, '-') || '/' || coalesce(co, '-') END)"""


@query("P12_evidence_blocks", needs=("items", "cur"), sql="WITH dummy AS (SELECT 1)" + EVIDENCE_SQL + """
SELECT item_id, project_id, item_type, epistemic_state, lifecycle, superseded_by, as_of, source_id,
       et AS source_title, es AS source_surface, ek AS source_kind, ea AS authority_class, er AS source_revision,
       changed_fields, changed_fields <> '' AS source_changed, impl AS is_implementation_evidence, draft AS is_draft,
       """ + CAVEATS_SQL + """ AS caveats
FROM e""")
def evidence(lake):
    return ref.evidence_blocks(_marked(lake), _current(lake))


CAVEAT_CASES = " ".join(f"WHEN '{code}' THEN '{text}'" for code, text in ref.CAVEAT_TEXT.items())


@query("P12_block_text", needs=("items", "cur"), sql="WITH dummy AS (SELECT 1)" + EVIDENCE_SQL + f"""
, c AS (SELECT e.*, {CAVEATS_SQL} AS caveats, {ITEM_HASH} AS full_hash FROM e)
SELECT item_id, '[REFERENCE MEMORY] ' || coalesce(project_id, '-') || ' / ' || item_type || ' / ' || concat_ws(' / ', epistemic_state,
    'source_status=' || source_status, 'currentness=' || ec) || chr(10) || 'source (at capture): ' || et || ' (' || source_id || '; ' || es || '/' || ek
    || '; authority=' || coalesce(ea, 'UNSPECIFIED') || coalesce('; rev=' || er, '') || ')' || chr(10) || 'as_of: ' || coalesce(as_of, 'UNKNOWN')
    || coalesce(' · section: ' || source_section, '') || chr(10) || 'version: ' || item_id || '@' || substr(full_hash, 1, 14) || chr(10)
    || 'claim (source-bound, not verified truth): ' || claim || CASE WHEN caveats <> '' THEN chr(10) || array_to_string(list_transform(string_split(caveats, '|'), lambda x: '! ' || x || ' ('
         || CASE regexp_extract(x, '^[A-Z_]+') {CAVEAT_CASES} END || ')'), chr(10)) ELSE '' END AS block
FROM c""")
def block_text(lake):
    """Rendered blocks: a claim never stands without its provenance."""
    rows = ref.evidence_blocks(ref.mark_superseded(_items(lake, True, True), lake.raw_items(False)), _current(lake), with_claim=True)
    return rows.select("item_id", ref.block_text().alias("block"))


@query("P13_draft_items", needs=("items", "cur"), sql="WITH dummy AS (SELECT 1)" + EVIDENCE_SQL + """
SELECT source_id, count(*) FILTER (WHERE draft) AS drafts, count(*) AS items FROM e GROUP BY source_id""")
def draft_items(lake):
    rows = ref.with_source(_marked(lake), _current(lake))
    return rows.groupBy("source_id").agg(F.count_if(ref.is_draft()).alias("drafts"), F.count("*").alias("items"))


@query("P14_implementation_evidence", needs=("items", "cur"), sql="WITH dummy AS (SELECT 1)" + EVIDENCE_SQL + """
SELECT item_id, item_type, source_id FROM e WHERE impl""")
def implementation_evidence(lake):
    rows = ref.with_source(_marked(lake), _current(lake))
    return rows.where(ref.implementation_evidence()).select("item_id", "item_type", "source_id")


@query("F1_retrieval_filters", needs=("items", "cur"), sql="WITH dummy AS (SELECT 1)" + EVIDENCE_SQL + """
SELECT item_id, project_id, ea AS authority_class, es AS surface FROM e
WHERE project_id = 'en' AND item_type = 'HYPOTHESIS' AND ek = 'RESEARCH' AND lifecycle <> 'SUPERSEDED'""")
def retrieval_filters(lake):
    rows = ref.with_source(_marked(lake), _current(lake))
    keep = ref.retrieval_filter(project_id="en", item_type="HYPOTHESIS", source_kind="RESEARCH")
    return rows.where(keep).select("item_id", "project_id",
                                   ref.effective("source_authority_class").alias("authority_class"),
                                   ref.effective("source_surface").alias("surface"))


@query("F2_project_scope", needs=("items", "cur"), sql="WITH dummy AS (SELECT 1)" + EVIDENCE_SQL + """
SELECT item_id, project_id, cp AS source_project FROM e
WHERE (project_id = 'p1' OR cp = 'p1') AND lifecycle <> 'SUPERSEDED'""")
def project_scope(lake):
    rows = ref.with_source(_marked(lake), _current(lake))
    return rows.where(ref.in_project("p1") & ref.retrieval_filter()).select(
        "item_id", "project_id", F.col("cur_project_id").alias("source_project"))


@query("J1_item_with_source", needs=("items", "cur"), sql="WITH dummy AS (SELECT 1)" + EVIDENCE_SQL + """
SELECT item_id, source_id, ct AS title, ca AS authority_class, cl AS locator FROM e""")
def item_with_source(lake):
    return ref.with_source(_items(lake), _current(lake)).select(
        "item_id", "source_id", F.col("cur_title").alias("title"),
        F.col("cur_authority_class").alias("authority_class"), F.col("cur_locator").alias("locator"))


@query("J20_sources_with_items", needs=("raw_items", "cur"), sql="""
SELECT source_id, source_id IN (SELECT source_id FROM raw_items WHERE item_type = 'MYSTERY') AS has_items FROM cur""")
def sources_with_items(lake):
    used = lake.raw_items(False).where(F.col("item_type") == "MYSTERY").select("source_id")
    return present_in(_current(lake).select("source_id"), used, ["source_id"], "has_items")


@query("A1_namespace_stats", needs=("items", "src", "edges"), sql="""
SELECT 'sources' AS table_name, count(*) AS row_count FROM src UNION ALL
SELECT 'items', count(*) FROM raw_items UNION ALL SELECT 'relations', count(*) FROM edges""")
def namespace_stats(lake):
    from attesta.operators.integrity import table_counts
    return table_counts({"sources": lake.raw_sources().select("source_id"), "items": lake.raw_items(False),
                         "relations": lake.relations()})


@query("A3_project_view", needs=("items", "cur"), sql="WITH dummy AS (SELECT 1)" + EVIDENCE_SQL + """
SELECT project_id, item_type, count(*) AS items, count(DISTINCT source_id) AS sources FROM e
WHERE lifecycle <> 'SUPERSEDED' GROUP BY project_id, item_type""")
def project_view(lake):
    return (_marked(lake).where(F.col("lifecycle") != "SUPERSEDED").groupBy("project_id", "item_type")
            .agg(F.count("*").alias("items"), F.count_distinct("source_id").alias("sources")))


@query("A4_source_view", needs=("raw_items", "src"), sql="""
SELECT s.source_id, s.title, s.revision, s.currentness, coalesce(c.items, 0) AS item_count
FROM src s LEFT JOIN (SELECT source_id, count(*) AS items FROM raw_items GROUP BY 1) c ON c.source_id = s.source_id""")
def source_view(lake):
    counts = lake.raw_items(False).groupBy("source_id").agg(F.count("*").alias("n"))
    return _sources(lake).join(counts, "source_id", "left").select(
        "source_id", "title", "revision", "currentness", F.coalesce("n", F.lit(0)).alias("item_count"))


@query("V1_source_rules", needs=("src",), sql="""
SELECT 'HUMAN_REFERENCE_PAIR' AS rule, 'ERROR' AS severity, source_id AS key FROM src
 WHERE source_kind = 'HUMAN_REFERENCE' AND authority_class IS DISTINCT FROM 'HUMAN_REFERENCE_ONLY'
UNION ALL SELECT 'BOOK_DONOR_PAIR', 'ERROR', source_id FROM src
 WHERE source_kind = 'BOOK_DONOR' AND authority_class IS DISTINCT FROM 'RESEARCH_DONOR'
UNION ALL SELECT 'NON_STANDARD_CURRENTNESS', 'WARNING', source_id FROM src WHERE currentness = 'LEGACY'""")
def source_rules(lake):
    return violations(_sources(lake), F.col("source_id"), ref.source_rules())


@query("V2_item_rules", needs=("items",), sql="""
SELECT 'UNKNOWN_ITEM_TYPE' AS rule, 'ERROR' AS severity, item_id AS key FROM items WHERE item_type = 'MYSTERY'
UNION ALL SELECT 'LENS_REQUIRED', 'ERROR', item_id FROM items
 WHERE source_authority_class = 'HUMAN_REFERENCE_ONLY' AND item_type <> 'HUMAN_LENS'
UNION ALL SELECT 'LENS_FORBIDDEN', 'ERROR', item_id FROM items
 WHERE source_authority_class <> 'HUMAN_REFERENCE_ONLY' AND item_type = 'HUMAN_LENS'
UNION ALL SELECT 'STRONG_STATE_KEPT', 'WARNING', item_id FROM items WHERE epistemic_state = 'verified'""")
def item_rules(lake):
    return violations(_items(lake, True), F.col("item_id"), ref.item_rules())


@query("V3_identity_rules", needs=("items",), sql=f"""
WITH h AS (SELECT doc_id, item_id, {ITEM_HASH} AS full_hash FROM items)
SELECT 'LOGICAL_ID_MISMATCH' AS rule, 'ERROR' AS severity, item_id AS key FROM h WHERE doc_id % 101 = 3
UNION ALL SELECT 'VERSION_ID_MISMATCH', 'ERROR', item_id FROM h
 WHERE doc_id % 101 <> 3 AND CASE WHEN doc_id % 50 = 7 THEN item_id || '@00000000000000'
   ELSE item_id || '@' || substr(full_hash, 1, 14) END <> item_id || '@' || substr(full_hash, 1, 14)""")
def identity_rules(lake):
    doc = F.col("line")
    declared = F.when(doc % 50 == 7, F.concat("item_id", F.lit("@00000000000000"))).otherwise(F.col("version_id"))
    rows = (_items(lake, True, True).withColumn("declared_version", declared)
            .withColumn("logical_item_id", F.when(doc % 101 == 3, F.concat("item_id", F.lit("x")))))
    return violations(rows, F.col("item_id"), ref.identity_rules())


@query("V4_relation_rules", needs=("edges",), sql="""
WITH k AS (SELECT e.*, EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderkey % 9 <> 0) AS fk,
                  EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_partkey % 7 <> 0) AS tk FROM edges e)
SELECT 'FROM_UNKNOWN' AS rule, 'ERROR' AS severity, edge_id AS key FROM k WHERE NOT fk
UNION ALL SELECT 'TO_UNKNOWN', 'ERROR', edge_id FROM k WHERE NOT tk""")
def relation_rules(lake):
    rows = _known_endpoints(lake)
    return violations(rows, F.col("edge_id"), ref.relation_rules())


def _known_endpoints(lake):
    orders = lake.table("orders").where(F.col("o_orderkey") % 9 != 0).select(
        F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("from_hit"))
    parts = lake.table("part").where(F.col("p_partkey") % 7 != 0).select(
        F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("to_hit"))
    rows = lookup_join(lake.relations(), orders, ["l_orderkey"], ["edge_id"], salts=1)
    rows = lookup_join(rows, parts, ["l_partkey"], ["edge_id"], salts=1)
    return (rows.withColumn("from_known", F.coalesce("from_hit", F.lit(False)))
            .withColumn("to_known", F.coalesce("to_hit", F.lit(False))))


@query("X1_content_hash", needs=("items",), sql=f"""
SELECT item_id, {ITEM_HASH} AS record_hash,
       item_id || '@' || substr({ITEM_HASH}, 1, 14) AS version_id FROM items""")
def content_hash(lake):
    return _items(lake, True, True).select("item_id", "record_hash", "version_id")


@query("X2_sha256", sql="SELECT doc_id, 'sha256:' || sha256(text) AS text_hash FROM documents")
def sha256_text(lake):
    return lake.table("documents").select("doc_id", ident.sha256_text(F.col("text")).alias("text_hash"))


@query("X3_version_split", sql="""
WITH s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'd' || doc_id
     ELSE 'd@' || doc_id || '@' || substr(sha256(text), 1, 14) END AS ref FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN 'd@' || doc_id END AS logical_id,
       CASE WHEN doc_id % 3 <> 0 THEN right(ref, 14) END AS hash14 FROM s""")
def version_split(lake):
    doc = F.col("doc_id")
    value = F.when(doc % 3 == 0, F.concat(F.lit("d"), doc)).otherwise(
        ident.version_id(F.concat(F.lit("d@"), doc), F.sha2("text", 256)))
    logical, digest = ident.version_parts(F.col("ref"))
    return lake.table("documents").select("doc_id", value.alias("ref")).select(
        "doc_id", logical.alias("logical_id"), digest.alias("hash14"))


@query("X5_blank_and_number", needs=("raw_items",), sql="""
SELECT item_id, nullif(source_status, '') AS source_status, TRY_CAST(nullif(confidence, '') AS DOUBLE) AS confidence,
       TRY_CAST(source_section AS DOUBLE) AS section_number FROM raw_items""")
def blank_and_number(lake):
    return lake.raw_items(False).select(
        "item_id", ident.blank_to_null(F.col("source_status")).alias("source_status"),
        ident.number_or_null(F.col("confidence")).alias("confidence"),
        ident.number_or_null(F.col("source_section")).alias("section_number"))


@query("A7_duplicate_content", sql="""
SELECT sha256(text) AS key_value, count(*) AS copies, min(doc_id) AS first_id FROM documents
GROUP BY 1 HAVING count(*) > 1""")
def duplicate_content(lake):
    rows = lake.table("documents").select(F.sha2("text", 256).alias("key_value"), "doc_id")
    return duplicate_keys(rows, ["key_value"], "doc_id")


@query("A8_conflicting_records", sql="""
SELECT source || '/' || n_chars AS record_key, count(DISTINCT sha256(text)) AS variants, min(doc_id) AS first_line
FROM documents GROUP BY 1 HAVING count(DISTINCT sha256(text)) > 1""")
def conflicting(lake):
    rows = lake.table("documents").select(F.concat_ws("/", "source", "n_chars").alias("record_key"),
                                          F.sha2("text", 256).alias("record_hash"), F.col("doc_id").alias("line"))
    return conflicting_records(rows, ["record_key"])


@query("M5_supersession", needs=("items",), sql="""
WITH first_claim AS (SELECT supersedes_item_id AS item_id, min_by(item_id, doc_id) AS by_id FROM items
                     WHERE supersedes_item_id IS NOT NULL GROUP BY 1)
SELECT i.item_id, CASE WHEN by_id IS NULL THEN 'ACTIVE' ELSE 'SUPERSEDED' END AS lifecycle, by_id AS superseded_by
FROM items i LEFT JOIN first_claim f ON f.item_id = i.item_id""")
def supersession(lake):
    return _marked(lake).select("item_id", "lifecycle", "superseded_by")


@query("M5_supersedes_edges", needs=("items",), sql="""
SELECT 'rel:auto:SUPERSEDES:' || item_id || '->' || supersedes_item_id AS relation_id, item_id AS from_item_id,
       supersedes_item_id AS to_item_id, source_id,
       supersedes_item_id IN (SELECT item_id FROM items) AS target_known
FROM items WHERE supersedes_item_id IS NOT NULL""")
def supersedes_edges(lake):
    return ref.superseding_edges(_items(lake))
