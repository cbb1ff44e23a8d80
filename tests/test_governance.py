"""The small decision story, batch and stream, and the change log."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from attesta.operators import governance as gov
from attesta.session import scratch_path
from attesta.streaming.decisions import DecisionStream

# proposal, decision against it, the proposal again, an unsupported claim, a resume query
STORY = [(1, "MODEL_PROPOSAL", 1), (2, "USER_DECISION", 1), (3, "MODEL_PROPOSAL", 1), (4, "RESEARCH_CLAIM", 0), (5, "QUERY_RESUME", 0)]


def events(spark, rows, scope=7):
    start = dt.datetime(2024, 1, 1)
    data = [(e, start + dt.timedelta(seconds=40 * e), scope, kind, parity) for e, kind, parity in rows]
    df = spark.createDataFrame(data, "event_id long, ts timestamp_ntz, scope long, event_type string, parity long")
    return df.withColumn("minute", F.date_trunc("minute", "ts"))


def status_of(states):
    return {r.event_id: r.status for r in states.select("event_id", "status").collect()}


def test_story(spark):
    states = gov.final_states(gov.admitted(events(spark, STORY)))
    assert status_of(states) == {1: "REJECTED", 2: "ACTIVE", 3: "REJECTED", 4: "HELD", 5: None}
    got = {tuple(r) for r in gov.edges(states).select("from_event", "to_event", "relation_type").collect()}
    assert got == {(2, 1, "REJECTED_BECAUSE"), (3, 2, "CONTRADICTS"), (2, 3, "REJECTED_BECAUSE"), (4, 2, "CONTRADICTS")}
    view = gov.resume(states, events(spark, STORY), gov.edges(states)).first()
    assert (view.active_event, view.active_count, view.rejected_count, view.rationale_edges) == (2, 1, 2, 4)
    assert view.next_action == gov.NEXT_WITHOUT_LOOP


def test_a_decision_rejects_every_open_proposal(spark):
    rows = [(1, "MODEL_PROPOSAL", 0), (2, "MODEL_PROPOSAL", 1), (3, "USER_DECISION", 0), (4, "MODEL_PROPOSAL", 1), (5, "USER_DECISION", 1)]
    states = gov.final_states(gov.admitted(events(spark, rows)))
    assert status_of(states) == {1: "REJECTED", 2: "REJECTED", 3: "SUPERSEDED", 4: "REJECTED", 5: "ACTIVE"}
    flags = gov.invariants(states, gov.edges(states)).drop("scope").first()
    assert all(flags)


def test_conflict_is_a_parameter(spark):
    states = gov.admitted(events(spark, STORY), F.lit(False))
    assert {r.outcome for r in states.where("event_id = 3").collect()} == {"ACCEPT"}


def story_files(spark, df, parts):
    """One file for each condition, in this order of arrival."""
    import time
    folder = scratch_path(spark, "story")
    for part in parts:
        df.where(part).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.02)
    return folder


def opened(spark, df, folder):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def many_events(spark, n=120):
    import random
    rng = random.Random(n)
    kinds = ["MODEL_PROPOSAL", "USER_DECISION", "RESEARCH_CLAIM", "QUERY_RESUME", "OPEN_LOOP"]
    rows = [(i, rng.choice(kinds), rng.randint(0, 1)) for i in range(n)]
    return events(spark, rows, 1).withColumn("scope", F.when(F.col("event_id") % 3 > 0, F.lit(1)).otherwise(F.col("event_id") % 5))


@pytest.mark.parametrize("parts, delay", [
    (["true"], "10 minutes"), (["event_id >= 40 AND event_id < 80", "event_id < 40", "event_id >= 80"], "1 hour"),
    (["event_id % 2 = 1", "event_id % 2 = 0"], "2 hours"), (["event_id < 0"], "1 hour")])
def test_stream_equals_batch(spark, parts, delay):
    """The same events in one and in several micro-batches, in any order of files, and no events at all."""
    df = many_events(spark)
    run = DecisionStream(spark, delay=delay)
    run.run(opened(spark, df, story_files(spark, df, parts)))
    kept = df if parts != ["event_id < 0"] else df.where("event_id < 0")
    batch = gov.final_states(gov.admitted(kept))
    columns = ["scope", "event_id", "event_type", "prior", "outcome", "target", "status"]
    assert {tuple(r) for r in run.states().select(*columns).collect()} == {tuple(r) for r in batch.select(*columns).collect()}
    assert run.ledger().count() == 0


def test_closed_minutes_are_settled_and_late_events_go_to_the_ledger(spark):
    """With no delay, the first file closes what lies before its end; a restart goes on from the stored state."""
    df = many_events(spark)
    run = DecisionStream(spark, delay="0 seconds", slices=3)
    folder = story_files(spark, df, ["event_id < 80 AND event_id <> 20", "event_id >= 80"])
    run.run(opened(spark, df, folder))
    assert run.log().where("settled").count() > 60
    again = DecisionStream(spark, root=run.root, delay="0 seconds", slices=3)
    late = df.where("event_id = 20").withColumn("event_type", F.lit("USER_DECISION"))
    late.coalesce(1).write.mode("append").parquet(folder)
    again.run(opened(spark, df, folder))
    assert [(r.event_id, r.reason) for r in again.ledger().collect()] == [(20, "LATE")]
    batch = gov.final_states(gov.admitted(df.where("event_id <> 20")))
    assert status_of(again.states()) == status_of(batch)


def test_decay_deprecates_the_forgotten(spark):
    now = dt.datetime(2024, 6, 1)
    facts = spark.createDataFrame([("old", now - dt.timedelta(days=1000), 0.1, 0), ("new", now, 1.0, 3)],
                                  "fact_id string, last_accessed timestamp, stability double, access_count long")
    got = {r.fact_id: r.state for r in gov.decayed(facts, F.lit(now)).collect()}
    assert got == {"old": "Deprecated", "new": "Active"}


def test_change_fold_over_several_batches_and_a_restart(spark):
    from attesta.streaming.decisions import ChangeFold
    df = spark.range(90).select((F.col("id") % 4).alias("work_id"), F.col("id").alias("at"), F.concat(F.lit("v"), "id").alias("after"))
    folder = scratch_path(spark, "changes")
    for part in range(3):
        df.where(f"at % 3 = {part}").coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    fold = ChangeFold(spark, "work_id", ["at"], ["after"])
    want = {tuple(r) for r in gov.fold_changes(df, "work_id", ["at"], ["after"]).collect()}
    assert {tuple(r) for r in fold.run(stream()).collect()} == want
    again = ChangeFold(spark, "work_id", ["at"], ["after"], root=fold.root)
    assert {tuple(r) for r in again.run(stream()).collect()} == want


def test_the_stream_runs_in_a_session_with_the_default_state_store(spark):
    """The operator has two state variables and a timer: a session of Spark's own defaults serves it too, and stays as it was."""
    name, default = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    df = many_events(spark, 40)
    before = spark.conf.get(name)
    spark.conf.set(name, default)
    try:
        run = DecisionStream(spark)
        run.run(opened(spark, df, story_files(spark, df, ["event_id < 20", "event_id >= 20"])))
        assert status_of(run.states()) == status_of(gov.final_states(gov.admitted(df)))
        assert spark.conf.get(name) == default
    finally:
        spark.conf.set(name, before)
