"""Registered queries: working memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.functions.rules import violations
from attesta.operators import work
from attesta.operators.integrity import changed_rows, duplicate_keys, missing_references
from attesta.plans.registry import query
from attesta.plans.scale import Running, lookup_join, running_values, top_k_per_group

PRIORITY_SQL = "CASE priority WHEN 'P0' THEN 0 WHEN 'P1' THEN 1 WHEN 'P2' THEN 2 WHEN 'P3' THEN 3 ELSE 4 END"
BUCKET_SQL = """
WITH b AS (SELECT *, CASE status WHEN 'CURRENT' THEN 'current' WHEN 'IN_PROGRESS' THEN 'in_progress'
   WHEN 'OPEN' THEN 'open' WHEN 'BLOCKED' THEN 'blocked' WHEN 'UNKNOWN' THEN 'unknown'
   WHEN 'COMPLETED' THEN 'recent_completed' END AS bucket FROM wi WHERE archived_at IS NULL
 UNION ALL SELECT *, 'next_actions' FROM wi WHERE archived_at IS NULL AND trim(next_action) <> ''
   AND status IN ('OPEN', 'IN_PROGRESS', 'BLOCKED', 'UNKNOWN'))
"""
RANKED_SQL = BUCKET_SQL + f""", r AS (SELECT *, row_number() OVER (PARTITION BY project_id, bucket ORDER BY
   CASE WHEN bucket = 'recent_completed' THEN 0 ELSE {PRIORITY_SQL} END, updated_at DESC, work_id) AS rank
   FROM b WHERE bucket IS NOT NULL)
"""


@query("P5_project_rows", sql="""
SELECT upper('n-' || n_name) AS code, regexp_full_match(upper('n-' || n_name), '[A-Z][A-Z0-9-]*[A-Z0-9]|[A-Z]') AS code_ok
FROM nation""")
def project_rows(lake):
    raw = lake.table("nation").select(F.concat(F.lit(" n-"), F.lower("n_name")).alias("code"))
    return work.normalise_projects(raw)


@query("P6_work_item_rows", needs=("wi",), sql="""
SELECT work_id, coalesce(nullif(CASE WHEN order_key % 6 = 0 THEN '' ELSE type END, ''), 'NOTE') AS type,
       CASE WHEN order_key % 7 = 0 THEN 'OPEN' ELSE status END AS status,
       CASE WHEN order_key % 8 = 0 THEN 'P2' ELSE priority END AS priority, thread,
       nullif(status_note, '') AS status_note,
       coalesce(resolved_at, CASE WHEN status = 'RESOLVED' AND order_key % 7 <> 0 THEN updated_at END) AS resolved_at
FROM wi""")
def work_item_rows(lake):
    key = F.col("order_key")
    raw = (lake.work_items().withColumn("type", F.when(key % 6 == 0, "").otherwise(F.col("type")))
           .withColumn("status", F.when(key % 7 == 0, F.lit(None)).otherwise(F.col("status")))
           .withColumn("priority", F.when(key % 8 == 0, "").otherwise(F.col("priority"))))
    return work.normalise_items(raw).select("work_id", "type", "status", "priority", "thread", "status_note",
                                            "resolved_at")


@query("P7_tags", sql="""
SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 2 THEN o_orderpriority || ',' || o_orderstatus END AS tags,
       o_orderkey % 4 < 2 AS tags_ok FROM orders""")
def tags(lake):
    key = F.col("o_orderkey")
    text = (F.when(key % 4 < 2, F.to_json(F.array(F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")), "o_orderstatus")))
            .when(key % 4 == 2, F.concat(F.lit('["'), "o_orderstatus", F.lit('", 7]'))).otherwise('["a", "  "]'))
    clean, ok = work.normalise_tags(F.col("tags_json"))
    return lake.table("orders").select("o_orderkey", text.alias("tags_json")).select(
        "o_orderkey", F.concat_ws(",", clean).alias("joined"), ok.alias("tags_ok")).select(
        "o_orderkey", F.when(F.col("tags_ok"), F.col("joined")).alias("tags"), "tags_ok")


@query("P8_work_id_parse", sql="""
WITH t AS (SELECT o_orderkey, 'N' || (o_custkey % 25) AS code, CASE WHEN o_orderkey % 5 = 0 THEN '20230231'
  ELSE strftime(o_orderdate, '%Y%m%d') END AS day, o_orderkey % 1000 AS seq FROM orders)
SELECT o_orderkey, code AS project_code, day, seq AS sequence, o_orderkey % 5 <> 0 AND seq >= 1 AS valid FROM t""")
def work_id_parse(lake):
    key = F.col("o_orderkey")
    day = F.when(key % 5 == 0, "20230231").otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    made = F.concat(F.lit("WRK-N"), F.col("o_custkey") % 25, F.lit("-"), day, F.lit("-"),
                    F.lpad((key % 1000).cast("string"), 3, "0"))
    parts = work.work_id_parts(F.col("work_id"))
    return lake.table("orders").select("o_orderkey", made.alias("work_id")).select(
        "o_orderkey", *[c.alias(n) for n, c in parts.items()])


@query("P15_compact_items", needs=("wi",), sql="""
SELECT work_id, project_id, thread, type, status, priority, updated_at,
       CASE WHEN length(repeat(title || ' ', 12)) > 200 THEN left(repeat(title || ' ', 12), 200) || '…'
            ELSE repeat(title || ' ', 12) END AS title, status_note, next_action,
       CASE WHEN length(repeat(title || ' ', 12)) > 200 THEN 'title' ELSE '' END AS truncated_fields FROM wi""")
def compact_items(lake):
    wide = lake.work_items().withColumn("title", F.repeat(F.concat("title", F.lit(" ")), 12))
    return work.compact_items(wide)


@query("F3_list_items", needs=("wi",), sql="""
SELECT work_id, project_id, status, priority, updated_at FROM wi
WHERE archived_at IS NULL AND status = 'OPEN' AND priority = 'P0' AND thread = 'BUILDING'""")
def list_items(lake):
    keep = work.list_filter(status="OPEN", priority="P0", thread="BUILDING")
    return lake.work_items().where(keep).select("work_id", "project_id", "status", "priority", "updated_at")


@query("F4_unresolved", needs=("wi",), sql="""
SELECT project_id, status, count(*) AS items FROM wi WHERE archived_at IS NULL
 AND status IN ('OPEN', 'IN_PROGRESS', 'BLOCKED', 'UNKNOWN') GROUP BY 1, 2""")
def unresolved(lake):
    return lake.work_items().where(work.unresolved()).groupBy("project_id", "status").agg(F.count("*").alias("items"))


@query("F5_resolved_and_completed", needs=("wi",), sql="""
(SELECT 'resolved' AS view_name, work_id, resolved_at AS sort_key FROM wi WHERE archived_at IS NULL AND status = 'RESOLVED'
 ORDER BY resolved_at DESC NULLS LAST, work_id LIMIT 100)
UNION ALL (SELECT 'completed', work_id, updated_at FROM wi WHERE archived_at IS NULL AND status = 'COMPLETED'
 ORDER BY updated_at DESC, work_id LIMIT 100)""")
def resolved_and_completed(lake):
    items = lake.work_items()
    done = (items.where(work.list_filter(status="RESOLVED")).orderBy(*work.recent_order("resolved_at")).limit(100)
            .select(F.lit("resolved").alias("view_name"), "work_id", F.col("resolved_at").alias("sort_key")))
    finished = (items.where(work.list_filter(status="COMPLETED")).orderBy(*work.recent_order()).limit(100)
                .select(F.lit("completed").alias("view_name"), "work_id", F.col("updated_at").alias("sort_key")))
    return done.unionByName(finished)


@query("F9_project_scope", needs=("wi",), sql="""
SELECT p.n_name AS name, count(*) AS items FROM wi JOIN nation p ON p.n_nationkey = wi.project_id
WHERE p.n_nationkey = 7 GROUP BY 1""")
def project_scope(lake):
    chosen = lake.work_projects().where(work.scope_condition(project="n7", project_id="7"))
    rows = lookup_join(lake.work_items(), chosen, ["project_id"], ["work_id"], "inner")
    return rows.groupBy("name").agg(F.count("*").alias("items"))


@query("J3_item_sources", sql="""
SELECT l_orderkey AS work_id, 's' || l_suppkey AS source_id, min(l_linenumber) = 1 AS is_primary, any_value(s_name) AS title
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey, l_suppkey""")
def item_sources(lake):
    """Primary links first, in a distributed sort."""
    links = lake.table("lineitem").groupBy("l_orderkey", "l_suppkey").agg(
        (F.min("l_linenumber") == 1).alias("is_primary"))
    links = links.select(F.col("l_orderkey").alias("work_id"), F.concat(F.lit("s"), "l_suppkey").alias("source_id"), "is_primary")
    joined = lookup_join(links, lake.work_sources().select("source_id", "title"), ["source_id"], ["work_id", "source_id"], "inner")
    return joined.orderBy("work_id", F.col("is_primary").desc(), "source_id")


@query("J6_touching_relations", needs=("edges",), sql="""
WITH w AS (SELECT 'o' || o_orderkey AS item_id FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'p' || p_partkey FROM part WHERE p_type = 'ECONOMY')
SELECT edge_id, from_item_id, to_item_id FROM edges WHERE from_item_id IN (SELECT item_id FROM w) OR to_item_id IN (SELECT item_id FROM w)""")
def touching_relations(lake):
    """Edges that touch an urgent order or an economy part: two equality joins and a union, instead of one OR join."""
    from attesta.operators.versions import touching
    wanted = lake.table("orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("o"), "o_orderkey").alias("item_id")).unionByName(
        lake.table("part").where("p_type = 'ECONOMY'").select(F.concat(F.lit("p"), "p_partkey").alias("item_id")))
    return touching(lake.relations().select("edge_id", "from_item_id", "to_item_id"), wanted, "edge_id",
                    "from_item_id", "to_item_id", "item_id")


@query("J10_import_conflicts", sql="""
SELECT o.o_orderkey AS key FROM orders o WHERE o.o_orderkey % 100 = 3 AND o.o_orderpriority <> '3-MEDIUM'""")
def import_conflicts(lake):
    from attesta.operators.merge import import_conflicts as conflicts
    stored = lake.table("orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus", "o_orderpriority")
    incoming = stored.where(F.col("key") % 2 == 1).withColumn(
        "o_orderpriority", F.when(F.col("key") % 100 == 3, "3-MEDIUM").otherwise(F.col("o_orderpriority")))
    return conflicts(stored, incoming, ["key"], ["o_orderstatus", "o_orderpriority"])


@query("J11_missing_references", sql="""
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <> 7)""")
def missing_parts(lake):
    lines = lake.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    parts = lake.table("part").where(F.col("p_size") != 7).select("p_partkey")
    return missing_references(lines, parts, "l_partkey", "p_partkey", "l_orderkey")


@query("W1_next_work_ids", needs=("wi",), sql="""
WITH t AS (SELECT order_key, 'N' || project_id AS code, replace(updated_at, '-', '') AS day FROM wi),
old AS (SELECT code, day, count(*) AS used FROM t WHERE order_key % 2 = 0 GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY code, day ORDER BY order_key) AS place FROM t WHERE order_key % 2 = 1)
SELECT n.order_key, coalesce(used, 0) + place AS sequence,
       'WRK-' || n.code || '-' || n.day || '-' || CASE WHEN coalesce(used, 0) + place > 999
         THEN CAST(coalesce(used, 0) + place AS VARCHAR) ELSE lpad(CAST(coalesce(used, 0) + place AS VARCHAR), 3, '0') END AS new_work_id
FROM n LEFT JOIN old USING (code, day)""")
def next_work_ids(lake):
    """Odd orders are new; the even ones hold the numbers 1..n of their (project, day)."""
    rows = lake.work_items().select("order_key", F.concat(F.lit("N"), "project_id").alias("code"),
                                    F.replace("updated_at", F.lit("-"), F.lit("")).alias("day"))
    taken = rows.where(F.col("order_key") % 2 == 0).groupBy("code", "day").agg(F.count("*").alias("sequence"))
    new = rows.where(F.col("order_key") % 2 == 1)
    return work.number_new_items(new, taken).select("order_key", "sequence", "new_work_id")


@query("W2_status_top_items", needs=("wi",), sql=RANKED_SQL + """
SELECT project_id, bucket, rank, work_id FROM r WHERE rank <= 5 AND bucket NOT IN ('next_actions', 'recent_completed')""")
def status_top_items(lake):
    rows = work.dashboard(lake.work_items())
    return rows.where(~F.col("bucket").isin("next_actions", "recent_completed")).select(
        "project_id", "bucket", "rank", "work_id")


@query("W3_recent_completed", needs=("wi",), sql=f"""
SELECT project_id, work_id, updated_at, rank FROM (SELECT *, row_number() OVER (PARTITION BY project_id
  ORDER BY updated_at DESC, work_id) AS rank FROM wi WHERE archived_at IS NULL AND status = 'COMPLETED') WHERE rank <= 5""")
def recent_completed(lake):
    rows = lake.work_items().where(work.list_filter(status="COMPLETED"))
    return top_k_per_group(rows, ["project_id"], work.recent_order(), 5).select(
        "project_id", "work_id", "updated_at", "rank")


@query("W4_next_actions", needs=("wi",), sql=RANKED_SQL + """
SELECT project_id, work_id, status, priority, next_action, rank FROM r WHERE bucket = 'next_actions' AND rank <= 5""")
def next_actions(lake):
    rows = lake.work_items().where(work.unresolved() & tx.has_text(F.col("next_action")))
    return top_k_per_group(rows, ["project_id"], work.priority_order(), 5).select(
        "project_id", "work_id", "status", "priority", "next_action", "rank")


POINTER_SQL = """
WITH e AS (SELECT *, CASE role WHEN 'PRIMARY' THEN 0 ELSE 1 END AS ro FROM ws WHERE role IN ('PRIMARY', 'NAVIGATION')),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ro, title, source_id) AS rank FROM e),
shown AS (SELECT * FROM r WHERE rank <= 3 ORDER BY 'N' || project_id, project_id, rank LIMIT 15)
"""


@query("W5_source_pointers", needs=("ws",), sql=POINTER_SQL + """
SELECT project_id, source_id, role, title, locator, rank FROM shown""")
def source_pointers(lake):
    return work.source_pointers(lake.work_sources(), lake.work_projects()).select(
        "project_id", "source_id", "role", "title", "locator", "rank")


@query("W5_omitted_projects", needs=("ws",), sql=POINTER_SQL + """
SELECT DISTINCT project_id FROM e WHERE project_id NOT IN (SELECT project_id FROM shown)""")
def omitted_projects(lake):
    return work.omitted_projects(lake.work_sources(), lake.work_projects())


@query("A5_bucket_totals", needs=("wi",), sql=BUCKET_SQL + """
SELECT project_id, bucket, count(*) AS total, count(*) > 5 AS truncated FROM b WHERE bucket IS NOT NULL GROUP BY 1, 2""")
def bucket_totals(lake):
    return work.dashboard_totals(lake.work_items())


@query("U5_status_union", needs=("wi",), sql="""
SELECT project_id, count(*) AS items FROM wi WHERE archived_at IS NULL
 AND status IN ('OPEN', 'IN_PROGRESS', 'BLOCKED', 'UNKNOWN') GROUP BY 1""")
def status_union(lake):
    return lake.work_items().where(work.unresolved()).groupBy("project_id").agg(F.count("*").alias("items"))


@query("R9_orientation", needs=("wi",), sql=RANKED_SQL + """
, t AS (SELECT project_id, bucket, count(*) AS total FROM b WHERE bucket IS NOT NULL GROUP BY 1, 2)
SELECT r.project_id, r.bucket, r.rank, r.work_id, r.title, t.total, t.total > 5 AS truncated
FROM r JOIN t ON t.project_id = r.project_id AND t.bucket = r.bucket WHERE r.rank <= 5""")
def orientation(lake):
    """Bounded start view of every project; totals join the few shown rows, so nothing large is joined."""
    items = lake.work_items()
    totals = work.dashboard_totals(items)
    return work.dashboard(items).join(totals, ["project_id", "bucket"]).select(
        "project_id", "bucket", "rank", "work_id", "title", "total", "truncated")


@query("K1_recent_list", needs=("wi",), sql="""
SELECT work_id, updated_at FROM wi WHERE archived_at IS NULL ORDER BY updated_at DESC, work_id LIMIT 20""")
def recent_list(lake):
    return lake.work_items().where(work.live()).orderBy(*work.recent_order()).limit(work.clamp_limit(None)).select(
        "work_id", "updated_at")


@query("K2_clamped_list", needs=("wi",), sql="""
SELECT work_id, updated_at, TRUE AS limit_clamped FROM wi WHERE archived_at IS NULL ORDER BY updated_at DESC, work_id LIMIT 50""")
def clamped_list(lake):
    limit, clamped = work.view_limit(500, 20, 50)
    return lake.work_items().where(work.live()).orderBy(*work.recent_order()).limit(limit).select(
        "work_id", "updated_at", F.lit(clamped).alias("limit_clamped"))


@query("K3_bounded_envelope", needs=("ws",), sql="""
SELECT source_id, role, title, total, total > 10 AS truncated FROM (
  SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY CASE role WHEN 'PRIMARY' THEN 0 WHEN 'NAVIGATION' THEN 1
    ELSE 9 END, title, source_id) AS rn FROM ws) WHERE rn <= 10""")
def bounded_envelope(lake):
    rows = lake.work_sources()
    total = rows.agg(F.count("*").alias("n")).scalar()
    return rows.orderBy(*work.pointer_order()).limit(10).select("source_id", "role", "title").withColumn(
        "total", total).withColumn("truncated", F.col("total") > 10)


@query("K4_truncation_probe", needs=("wi",), sql="""
SELECT project_id, work_id FROM wi WHERE archived_at IS NULL AND project_id = 3 ORDER BY updated_at DESC, work_id LIMIT 21""")
def truncation_probe(lake):
    """One row more than the limit tells that the list was cut; the scope applies first."""
    keep = work.list_filter(project_id=3)
    return lake.work_items().where(keep).orderBy(*work.recent_order()).limit(work.clamp_limit(20) + 1).select(
        "project_id", "work_id")


@query("K6_source_order", needs=("ws",), sql="""
SELECT project_id, source_id, row_number() OVER (PARTITION BY project_id ORDER BY role, title, source_id) AS place FROM ws""")
def source_order(lake):
    place = Running("sum", F.lit(1).cast("long"), inclusive=True)
    return running_values(lake.work_sources(), ["project_id"], ["role", "title", "source_id"], {"place": place},
                          [["role"]]).select("project_id", "source_id", "place")


@query("R3_ranked_search", sql="""
WITH t AS (SELECT 'w' || p_partkey AS work_id, p_name AS title, p_type AS summary, p_brand AS tag,
  p_name || ' of ' || p_type AS body FROM part)
SELECT work_id, title, rank FROM (SELECT *, CASE WHEN work_id = 'red bolt' THEN 1 WHEN lower(title) = 'red bolt' THEN 2
  WHEN contains(lower(title), 'red bolt') THEN 3 WHEN lower(tag) = 'red bolt' THEN 4
  WHEN contains(lower(summary), 'red bolt') THEN 5 WHEN contains(lower(body), 'red bolt') THEN 6 END AS rank FROM t)
WHERE rank IS NOT NULL ORDER BY rank, title, work_id LIMIT 100""")
def ranked_search(lake):
    rows = lake.table("part").select(
        F.concat(F.lit("w"), "p_partkey").alias("work_id"), F.col("p_name").alias("title"),
        F.col("p_type").alias("summary"), F.array("p_brand").alias("tags"), F.lit(None).cast("string").alias("archived_at"),
        F.concat("p_name", F.lit(" of "), "p_type").alias("body"))
    hits = work.search_items(rows, " Red Bolt ", limit=500, tags=F.col("tags"))
    return hits.select("work_id", "title", F.col("rank").cast("int").alias("rank"))


@query("V7_work_item_rules", needs=("wi",), sql="""
SELECT 'STATUS_NOTE_REQUIRED' AS rule, 'ERROR' AS severity, work_id AS key FROM wi
 WHERE status IN ('BLOCKED', 'RESOLVED', 'REJECTED') AND trim(status_note) = ''
UNION ALL SELECT 'RESOLVED_AT_REQUIRED', 'ERROR', work_id FROM wi WHERE status = 'RESOLVED' AND resolved_at IS NULL""")
def work_item_rules(lake):
    return violations(lake.work_items(), F.col("work_id"), work.item_rules())


@query("V7_work_relation_rules", sql="""
WITH r AS (SELECT l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey AS key, l_orderkey = l_partkey AS self, l_returnflag = 'N' AND l_linenumber = 2 AS bad FROM lineitem)
SELECT 'SELF_RELATION' AS rule, 'ERROR' AS severity, key FROM r WHERE self UNION ALL SELECT 'UNKNOWN_RELATION_TYPE', 'ERROR', key FROM r WHERE bad""")
def work_relation_rules(lake):
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    kind = (F.when(flag == "R", "BLOCKED_BY").when(flag == "A", "DEPENDS_ON").when(line == 2, "LIKES").otherwise("RELATED_TO"))
    rows = lake.table("lineitem").select(
        F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("relation_id"),
        F.col("l_orderkey").cast("string").alias("from_work_id"), F.col("l_partkey").cast("string").alias("to_work_id"), kind.alias("relation_type"))
    return violations(rows, F.col("relation_id"), work.relation_rules())


@query("V8_uniqueness", sql="""
SELECT o_custkey || '|' || strftime(o_orderdate, '%Y-%m-%d') AS key_value, count(*) AS copies, min(o_orderkey) AS first_id
FROM orders GROUP BY 1 HAVING count(*) > 1""")
def uniqueness(lake):
    rows = lake.table("orders").select(
        F.concat_ws("|", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("key_value"), "o_orderkey")
    return duplicate_keys(rows, ["key_value"], "o_orderkey")


@query("V9_project_code_of_id", needs=("wi",), sql="""
SELECT work_id, 'N' || CASE WHEN order_key % 40 = 1 THEN project_id + 1 ELSE project_id END AS id_code,
       'N' || project_id AS project_code FROM wi WHERE order_key % 40 = 1""")
def project_code_of_id(lake):
    key = F.col("order_key")
    code = F.when(key % 40 == 1, F.col("project_id") + 1).otherwise(F.col("project_id"))
    rows = lake.work_items().select("work_id", "project_id", F.concat(
        F.lit("WRK-N"), code, F.lit("-"), F.replace("updated_at", F.lit("-"), F.lit("")), F.lit("-001")).alias("made"))
    joined = lookup_join(rows, lake.work_projects(), ["project_id"], ["work_id"])
    id_code = work.work_id_parts(F.col("made"))["project_code"]
    return joined.where(~id_code.eqNullSafe(F.col("code"))).select(
        "work_id", id_code.alias("id_code"), F.col("code").alias("project_code"))


@query("V10_immutability_audit", sql="""
SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 9 THEN 'DELETED' ELSE 'MUTATED' END AS violation FROM orders
WHERE o_orderkey % 50 = 9 OR (o_orderkey % 50 = 11 AND o_custkey IS NOT NULL)""")
def immutability_audit(lake):
    old = lake.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    key = F.col("o_orderkey")
    new = old.where(key % 50 != 9).withColumn("o_custkey", F.when(key % 50 == 11, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    return changed_rows(old, new, ["o_orderkey"], ["o_custkey", "o_orderdate"])


@query("M10_batch_update", sql="""
WITH p AS (SELECT event_id AS o_orderkey, CASE WHEN event_type = 'click' THEN '1-URGENT' END AS o_orderpriority,
   CASE WHEN event_type = 'error' THEN 'P' WHEN event_type = 'view' THEN 'F' END AS o_orderstatus FROM events),
j AS (SELECT o.o_orderkey, o.o_orderpriority AS op, o.o_orderstatus AS os, coalesce(p.o_orderpriority, o.o_orderpriority) AS np,
   coalesce(p.o_orderstatus, o.o_orderstatus) AS ns FROM orders o JOIN p ON p.o_orderkey = o.o_orderkey)
SELECT o_orderkey AS work_id, concat_ws(',', CASE WHEN op <> np THEN 'priority' END, CASE WHEN os <> ns THEN 'status' END) AS changed,
       np AS priority, ns AS status FROM j WHERE op <> np OR os <> ns""")
def batch_update(lake):
    items = lake.table("orders").select(F.col("o_orderkey").alias("work_id"), F.col("o_orderpriority").alias("priority"),
                                        F.col("o_orderstatus").alias("status"))
    kind = F.col("event_type")
    patches = lake.table("events").select(
        F.col("event_id").alias("work_id"), F.when(kind == "click", "1-URGENT").alias("priority"),
        F.when(kind == "error", "P").when(kind == "view", "F").alias("status"))
    return work.apply_patches(items, patches, ["priority", "status"]).select(
        "work_id", F.concat_ws(",", "changed").alias("changed"), "after.priority", "after.status")


@query("M11_single_primary", sql="""
WITH l AS (SELECT user_id AS work_id, event_type AS source_id, event_id AS seq,
     CAST(json_extract_string(props, '$.k') AS INT) % 3 = 0 AS p FROM events),
last AS (SELECT work_id, source_id, max_by(p, seq) AS p FROM l GROUP BY 1, 2),
pr AS (SELECT work_id, max_by(source_id, seq) AS ps FROM l WHERE p GROUP BY 1)
SELECT last.work_id, last.source_id, p AND last.source_id IS NOT DISTINCT FROM ps AS is_primary
FROM last LEFT JOIN pr ON pr.work_id = last.work_id""")
def single_primary(lake):
    links = lake.table("events").select(
        F.col("user_id").alias("work_id"), F.col("event_type").alias("source_id"), F.col("event_id").alias("seq"),
        (F.get_json_object("props", "$.k").cast("int") % 3 == 0).alias("is_primary"))
    return work.switch_primary(links)


@query("U3_changed_fields", sql="""
WITH n AS (SELECT o_custkey, o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, lag(o_orderkey) OVER w AS pk,
  lag(o_orderstatus) OVER w AS ps, lag(o_orderpriority) OVER w AS pp, lag(o_totalprice) OVER w AS pt FROM orders
  WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, concat_ws(',', CASE WHEN o_totalprice IS DISTINCT FROM pt THEN 'price' END,
  CASE WHEN o_orderpriority IS DISTINCT FROM pp THEN 'priority' END, CASE WHEN o_orderstatus IS DISTINCT FROM ps THEN 'status' END) AS changed
FROM n WHERE pk IS NOT NULL""")
def changed_fields(lake):
    from attesta.operators.versions import with_neighbours
    fields = ["price", "priority", "status"]
    rows = with_neighbours(lake.revisions(), ["revision_no", *fields], later=False)
    return rows.where(F.col("earlier").isNotNull()).withColumn("now", F.struct(*fields)).select(
        F.col("revision_no").alias("o_orderkey"),
        F.concat_ws(",", work.changed_fields("earlier", "now", fields)).alias("changed"))


@query("V11_strict_export_check", sql="""
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'FIELDS' WHEN event_id % 5 = 0 THEN 'TIMESTAMP' WHEN event_id % 3 = 0 THEN 'CHANGED_FIELDS'
  WHEN event_id % 11 = 0 THEN 'ACTOR' ELSE 'OK' END AS verdict FROM events""")
def strict_export_check(lake):
    """Change rows of an export: exact fields, real timestamps, a JSON array of field names, a named actor, valid images."""
    key = F.col("event_id")
    row = F.to_json(F.struct(
        F.concat(F.lit("c"), key).alias("change_id"), F.lit(None).cast("string").alias("work_id"), F.col("event_type").alias("change_type"),
        F.when(key % 11 == 0, " ").otherwise("USER").alias("actor_class"),
        F.when(key % 3 == 0, '["a", 1]').otherwise('["a"]').alias("changed_fields_json"), F.lit(None).cast("string").alias("before_json"),
        F.col("props").alias("after_json"),
        F.when(key % 5 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("created_at")), {"ignoreNullFields": "false"})
    raw = F.when(key % 7 == 0, F.replace(row, F.lit('"actor_class"'), F.lit('"actor"'))).otherwise(row)
    return work.check_change_rows(lake.table("events").select("event_id", raw.alias("raw")), "event_id")


@query("U2_exact_keys", sql="""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'k' ELSE '' END AS missing_keys,
       CASE WHEN event_id % 3 = 0 THEN 'other' ELSE '' END AS unknown_keys FROM events""")
def exact_keys(lake):
    """Keys of each JSON object against the allowed list, both ways."""
    text = F.when(F.col("event_id") % 3 == 0, F.replace("props", F.lit('"k"'), F.lit('"other"'))).otherwise(F.col("props"))
    allowed = F.array(F.lit("k"))
    rows = lake.table("events").select("event_id", F.json_object_keys(text).alias("found"))
    return rows.select("event_id", F.concat_ws(",", F.array_except(allowed, F.col("found"))).alias("missing_keys"),
                       F.concat_ws(",", F.array_except(F.col("found"), allowed)).alias("unknown_keys"))
