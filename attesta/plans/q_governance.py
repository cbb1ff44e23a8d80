"""Registered queries: typed events, decision states, change log, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import governance as gov
from attesta.operators import reference as ref
from attesta.plans.registry import query
from attesta.session import written
from attesta.streaming import decisions as st

STATES_SQL = """
WITH t AS (SELECT * FROM gov WHERE event_type <> 'OPEN_LOOP'),
p AS (SELECT *, last_value(CASE WHEN event_type = 'USER_DECISION' THEN event_id END IGNORE NULLS) OVER w AS prior_id,
   last_value(CASE WHEN event_type = 'USER_DECISION' THEN parity END IGNORE NULLS) OVER w AS prior_parity,
   first_value(CASE WHEN event_type = 'USER_DECISION' THEN event_id END IGNORE NULLS) OVER (PARTITION BY scope ORDER BY ts, event_id
     ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_id FROM t
   WINDOW w AS (PARTITION BY scope ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
a AS (SELECT *, CASE event_type WHEN 'USER_DECISION' THEN 'ACTIVE' WHEN 'RESEARCH_CLAIM' THEN 'HELD' WHEN 'QUERY_RESUME' THEN 'RESUME_QUERY'
   ELSE CASE WHEN prior_id IS NOT NULL AND prior_parity = parity THEN 'REJECTED' ELSE 'PROPOSED' END END AS target FROM p),
s AS (SELECT *, CASE target WHEN 'HELD' THEN 'HOLD' WHEN 'REJECTED' THEN 'REJECT' ELSE 'ACCEPT' END AS outcome,
   CASE target WHEN 'ACTIVE' THEN CASE WHEN next_id IS NULL THEN 'ACTIVE' ELSE 'SUPERSEDED' END
     WHEN 'PROPOSED' THEN CASE WHEN next_id IS NULL THEN 'PROPOSED' ELSE 'REJECTED' END
     WHEN 'RESUME_QUERY' THEN NULL ELSE target END AS status FROM a),
ed AS (SELECT scope, event_id AS from_event, prior_id AS to_event, 'SUPERSEDES' AS relation_type FROM s WHERE target = 'ACTIVE' AND prior_id IS NOT NULL
 UNION ALL SELECT scope, next_id, event_id, 'REJECTED_BECAUSE' FROM s WHERE target = 'PROPOSED' AND next_id IS NOT NULL
 UNION ALL SELECT scope, event_id, prior_id, 'CONTRADICTS' FROM s WHERE target = 'REJECTED'
 UNION ALL SELECT scope, prior_id, event_id, 'REJECTED_BECAUSE' FROM s WHERE target = 'REJECTED'
 UNION ALL SELECT scope, event_id, prior_id, 'CONTRADICTS' FROM s WHERE target = 'HELD' AND prior_id IS NOT NULL)
"""


def _states(lake):
    return gov.final_states(gov.admitted(lake.governance_events()))


@query("W11_event_states", needs=("gov",), sql=STATES_SQL + "SELECT event_id, scope, event_type, prior_id AS active_before, status FROM s")
def event_states(lake):
    return _states(lake).select("event_id", "scope", "event_type", F.col("prior.event_id").alias("active_before"), "status")


@query("T1_admission", needs=("gov",), sql=STATES_SQL + "SELECT event_id, outcome, target FROM s")
def admission(lake):
    return gov.admitted(lake.governance_events()).select("event_id", "outcome", "target")


@query("T1_decision_edges", needs=("gov",), sql=STATES_SQL + "SELECT scope, from_event, to_event, relation_type FROM ed")
def decision_edges(lake):
    return gov.edges(_states(lake))


def _stream(lake):
    """The events as a file stream, whether the table is one file or a folder of files."""
    schema = lake.table("events").schema
    spark = lake.spark
    first = lake.table("events").select(F.input_file_name().alias("f")).limit(1).take(1)
    one_file = bool(first) and first[0]["f"].endswith("/events.parquet")
    folder, pattern = (lake.root, "events.parquet") if one_file else (f"{lake.root}/events.parquet", "*")
    return st.event_stream(spark, folder, pattern, schema)


class _StreamLake:
    """The same mapping of events, over the stream."""

    def __init__(self, lake):
        self.events = _stream(lake)

    def table(self, name):
        return self.events

    def governance_events(self):
        from attesta.sources.lake import Lake
        return Lake.governance_events(self)


@query("T1_streamed_states", needs=("gov",), sql=STATES_SQL + "SELECT event_id, scope, outcome, target, status FROM s")
def streamed_states(lake):
    """The streaming run gives the states of the batch form."""
    run = st.DecisionStream(lake.spark)
    run.run(_StreamLake(lake).governance_events())
    return run.states().select("event_id", "scope", "outcome", "target", "status")


@query("T1_settled_by_watermark", needs=("gov",), sql="""
WITH t AS (SELECT * FROM gov WHERE event_type <> 'OPEN_LOOP'), w AS (SELECT max(ts) - INTERVAL 6 HOUR AS mark FROM t)
SELECT date_trunc('minute', ts) + INTERVAL 1 MINUTE <= mark AS settled, count(*) AS events, count(DISTINCT scope) AS scopes FROM t, w GROUP BY 1""")
def settled_by_watermark(lake):
    """What the watermark (six hours behind the last event) has closed and what is still open in the state."""
    run = st.DecisionStream(lake.spark, delay="6 hours")
    run.run(_StreamLake(lake).governance_events())
    return run.log().groupBy("settled").agg(F.count("*").alias("events"), F.count_distinct("scope").alias("scopes"))


@query("T2_change_fold", sql="""
SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(props, (ts, event_id)) AS props, count(*) AS changes FROM events GROUP BY 1""")
def change_fold(lake):
    return gov.fold_changes(lake.table("events"), "user_id", ["ts", "event_id"], ["event_type", "props"])


@query("T2_change_fold_as_of", sql="""
SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, count(*) AS changes FROM events WHERE ts <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1""")
def change_fold_as_of(lake):
    """Time travel: the filter by time reaches the scan, then the same fold."""
    rows = lake.table("events").where(F.col("ts") <= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))
    return gov.fold_changes(rows, "user_id", ["ts", "event_id"], ["event_type"])


@query("T2_streamed_fold", sql="""
SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(props, (ts, event_id)) AS props, count(*) AS changes FROM events GROUP BY 1""")
def streamed_fold(lake):
    return st.ChangeFold(lake.spark, "user_id", ["ts", "event_id"], ["event_type", "props"]).run(_stream(lake))


@query("T3_without_redelivery", sql="SELECT event_type, count(*) AS events FROM events GROUP BY 1")
def without_redelivery(lake):
    """Every event is delivered twice; the stream keeps it once."""
    twice = _stream(lake).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type",
                                 F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    kept = st.append_run(st.without_redelivery(twice).select("event_id", "event_type"), "dedup")
    return kept.groupBy("event_type").agg(F.count("*").alias("events"))


@query("T4_audit_log", needs=("gov",), sql=STATES_SQL + """
SELECT CASE event_type WHEN 'USER_DECISION' THEN 'APPLY_USER_DECISION' WHEN 'MODEL_PROPOSAL' THEN 'APPLY_MODEL_PROPOSAL'
  WHEN 'RESEARCH_CLAIM' THEN 'APPLY_RESEARCH_CLAIM' ELSE 'APPLY_RESUME_QUERY' END AS operation, outcome || ':' || target AS result, count(*) AS entries
FROM s GROUP BY 1, 2""")
def audit_log(lake):
    return gov.audit(gov.admitted(lake.governance_events())).groupBy("operation", "result").agg(F.count("*").alias("entries"))


@query("T5_resume_points", needs=("gov",), sql="""
WITH p AS (SELECT *, last_value(CASE WHEN event_type = 'USER_DECISION' THEN event_id END IGNORE NULLS) OVER w AS active_event,
  count(*) FILTER (WHERE event_type = 'USER_DECISION') OVER w AS decisions, count(*) FILTER (WHERE event_type = 'MODEL_PROPOSAL') OVER w AS proposals,
  count(*) FILTER (WHERE event_type = 'RESEARCH_CLAIM') OVER w AS claims, count(*) FILTER (WHERE event_type = 'OPEN_LOOP') OVER w AS open_loops
  FROM gov WINDOW w AS (PARTITION BY scope ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, scope, active_event, decisions, proposals, claims, open_loops FROM p WHERE event_type = 'QUERY_RESUME'""")
def resume_points(lake):
    return gov.resume_points(lake.governance_events())


@query("A22_resume_projection", needs=("gov",), sql=STATES_SQL + f"""
, sm AS (SELECT scope, max(CASE WHEN status = 'ACTIVE' THEN event_id END) AS active_event, count(*) FILTER (WHERE status = 'ACTIVE') AS active_count,
   count(*) FILTER (WHERE status = 'REJECTED') AS rejected_count, count(*) FILTER (WHERE status = 'HELD') AS held_count FROM s GROUP BY 1),
lo AS (SELECT scope, min_by(event_id, (ts, event_id)) AS open_loop FROM gov WHERE event_type = 'OPEN_LOOP' GROUP BY 1)
SELECT coalesce(sm.scope, lo.scope) AS scope, active_event, coalesce(active_count, 0) AS active_count, coalesce(rejected_count, 0) AS rejected_count,
  coalesce(held_count, 0) AS held_count, (SELECT count(*) FROM ed WHERE ed.scope = sm.scope AND (from_event = active_event OR to_event = active_event)) AS rationale_edges,
  open_loop, CASE WHEN open_loop IS NOT NULL THEN '{gov.NEXT_WITH_LOOP}' ELSE '{gov.NEXT_WITHOUT_LOOP}' END AS next_action
FROM sm FULL JOIN lo ON lo.scope = sm.scope""")
def resume_projection(lake):
    states = written(_states(lake), "states")
    return gov.resume(states, lake.governance_events(), gov.edges(states))


@query("V21_governance_invariants", needs=("gov",), sql="""
SELECT scope, TRUE AS one_active, TRUE AS active_from_user, TRUE AS nothing_deleted, TRUE AS rationale_present
FROM gov WHERE event_type <> 'OPEN_LOOP' GROUP BY 1""")
def governance_invariants(lake):
    states = written(_states(lake), "states")
    return gov.invariants(states, gov.edges(states))


@query("W13_change_sequence", sql="""
SELECT event_id, CAST(row_number() OVER w AS BIGINT) AS seq, lag(props) OVER w AS before, lag(props) OVER w IS DISTINCT FROM props AS changed
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def change_sequence(lake):
    rows = lake.table("events").withColumn("minute", F.date_trunc("minute", "ts"))
    out = gov.change_sequence(rows, "user_id", ["ts", "event_id"], "props", gov.LEVELS)
    return out.select("event_id", "seq", "before", (~F.col("before").eqNullSafe(F.col("props"))).alias("changed"))


@query("T6_source_freshness", needs=("src",), sql="""
SELECT source_id, as_of, date_diff('day', CAST(as_of AS DATE), DATE '2024-02-01') AS age_days,
  CASE WHEN date_diff('day', CAST(as_of AS DATE), DATE '2024-02-01') > 20 THEN 'STALE' ELSE 'FRESH' END AS freshness FROM src""")
def source_freshness(lake):
    return gov.freshness(ref.normalise_sources(lake.raw_sources()), "2024-02-01", 20)


@query("T7_fact_decay", sql="""
WITH f AS (SELECT user_id AS fact_id, max(ts) AS la, count(*) AS access_count, 0.01 * (user_id % 10 + 1) AS stability FROM events WHERE event_type = 'signup' GROUP BY 1),
a AS (SELECT *, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(la)) / 86400000000.0 AS days FROM f)
SELECT fact_id, access_count, round(days, 4) AS age_days, CASE WHEN exp(-days / (30.0 * stability)) < 0.05 THEN 'Deprecated' ELSE 'Active' END AS state FROM a""")
def fact_decay(lake):
    events = lake.table("events")
    facts = events.where("event_type = 'signup'").groupBy(F.col("user_id").alias("fact_id")).agg(
        F.max("ts").alias("last_accessed"), F.count("*").alias("access_count")).withColumn("stability", (F.col("fact_id") % 10 + 1) * 0.01)
    now = events.agg(F.max("ts").cast("timestamp").alias("now")).scalar()
    return gov.decayed(facts, now)


@query("S6_event_fixture_reader", sql="""
SELECT user_id AS scope, count(*) AS steps, CAST(min(event_id) AS BIGINT) AS first_event FROM events GROUP BY 1""")
def event_fixture_reader(lake):
    """Fixture files (a few ordered steps each) written as JSON, read back and unfolded in step order."""
    from attesta.sources.bundles import read_lines, write_lines
    rows = lake.table("events").select("user_id", F.array(F.struct(
        F.col("event_id").alias("step"), "event_id", "event_type")).alias("steps"))
    back = read_lines(lake.spark, write_lines(rows, "fixture"), rows.schema)
    steps = back.select("user_id", F.posexplode("steps").alias("place", "s"))
    return steps.groupBy(F.col("user_id").alias("scope")).agg(F.count("*").alias("steps"), F.min("s.event_id").alias("first_event"))
