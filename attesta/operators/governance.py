"""Typed events to decision states: admission, state after all later events, edges, audit and resume view.

Batch form of the state machine.  Order within a scope is (ts, event_id).  The conflict test is a parameter:
a column over the proposal's ``parity`` and the latest earlier decision's ``prior.parity``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.plans.scale import Running, lookup_join, running_values

ORDER = ["ts", "event_id"]
# minutes follow the event time: a scope with a third of all events is cut at every minute, and what is carried
# from minute to minute is one row (half a million rows for a year of events in one scope)
LEVELS = [["minute"]]
DECISION, PROPOSAL, CLAIM, RESUME = "USER_DECISION", "MODEL_PROPOSAL", "RESEARCH_CLAIM", "QUERY_RESUME"
NEXT_WITH_LOOP = "resolve the open question first"
NEXT_WITHOUT_LOOP = "continue from the active decision"


def same_parity() -> Column:
    return F.col("parity") == F.col("prior.parity")


def with_prior_decision(events: DataFrame, extra: dict[str, Running] | None = None) -> DataFrame:
    """The latest decision before each event of its scope."""
    decision = F.when(F.col("event_type") == DECISION, F.struct("event_id", "parity"))
    return running_values(events, ["scope"], ORDER, {"prior": Running("last", decision), **(extra or {})}, LEVELS)


def admission(conflict: Column) -> Column:
    """ACCEPT, HOLD or REJECT with the status the event asks for."""
    kind = F.col("event_type")
    rejected = (kind == PROPOSAL) & F.coalesce(F.col("prior").isNotNull() & conflict, F.lit(False))
    return (F.when(rejected, F.struct(F.lit("REJECT").alias("outcome"), F.lit("REJECTED").alias("target")))
            .when(kind == PROPOSAL, F.struct(F.lit("ACCEPT").alias("outcome"), F.lit("PROPOSED").alias("target")))
            .when(kind == DECISION, F.struct(F.lit("ACCEPT").alias("outcome"), F.lit("ACTIVE").alias("target")))
            .when(kind == CLAIM, F.struct(F.lit("HOLD").alias("outcome"), F.lit("HELD").alias("target")))
            .when(kind == RESUME, F.struct(F.lit("ACCEPT").alias("outcome"), F.lit("RESUME_QUERY").alias("target")))
            .otherwise(F.struct(F.lit("REJECT").alias("outcome"), F.lit("UNKNOWN").alias("target"))))


def admitted(events: DataFrame, conflict: Column | None = None) -> DataFrame:
    """Events with their admission; open loops are seed rows and are not admitted."""
    typed = events.where(F.col("event_type") != "OPEN_LOOP")
    rows = with_prior_decision(typed)
    return rows.withColumn("admission", admission(conflict if conflict is not None else same_parity())).withColumn(
        "outcome", F.col("admission.outcome")).withColumn("target", F.col("admission.target")).drop("admission")


def final_states(log: DataFrame, position: list[str] | None = None) -> DataFrame:
    """State of every event after all events of its scope.

    Whether a later decision exists follows from the position of the last decision of the scope: one small
    aggregate and a lookup instead of a second window.
    """
    place = F.struct(*(position or ORDER))
    last = log.where(F.col("event_type") == DECISION).groupBy("scope").agg(F.max(place).alias("last_decision"))
    rows = lookup_join(log, last, ["scope"], ["event_id"])
    later = F.coalesce(place < F.col("last_decision"), F.lit(False))
    status = (F.when(F.col("target") == "ACTIVE", F.when(later, "SUPERSEDED").otherwise("ACTIVE"))
              .when(F.col("target") == "PROPOSED", F.when(later, "REJECTED").otherwise("PROPOSED"))
              .when(F.col("target").isin("REJECTED", "HELD"), F.col("target")))
    return rows.withColumn("status", status).drop("last_decision")


def edges(states: DataFrame) -> DataFrame:
    """Why a state is what it is: SUPERSEDES, REJECTED_BECAUSE and CONTRADICTS edges between events."""
    decision = F.when(F.col("event_type") == DECISION, F.col("event_id"))
    rows = running_values(states, ["scope"], ORDER, {"next_decision": Running("last", decision)}, LEVELS, reverse=True)
    me, prior, following = F.col("event_id"), F.col("prior.event_id"), F.col("next_decision")

    def edge(when: Column, start: Column, end: Column, kind: str) -> Column:
        return F.when(F.coalesce(when, F.lit(False)), F.struct(start.alias("from_event"), end.alias("to_event"), F.lit(kind).alias("relation_type")))

    target = F.col("target")
    made = F.array_compact(F.array(
        edge((target == "ACTIVE") & prior.isNotNull(), me, prior, "SUPERSEDES"),
        edge((target == "PROPOSED") & following.isNotNull(), following, me, "REJECTED_BECAUSE"),
        edge(target == "REJECTED", me, prior, "CONTRADICTS"),
        edge(target == "REJECTED", prior, me, "REJECTED_BECAUSE"),
        edge((target == "HELD") & prior.isNotNull(), me, prior, "CONTRADICTS")))
    return rows.select("scope", F.explode(made).alias("e")).select("scope", "e.*")


def audit(states: DataFrame) -> DataFrame:
    """Append-only audit rows, one per applied event."""
    operation = (F.when(F.col("event_type") == DECISION, "APPLY_USER_DECISION").when(F.col("event_type") == PROPOSAL, "APPLY_MODEL_PROPOSAL")
                 .when(F.col("event_type") == CLAIM, "APPLY_RESEARCH_CLAIM").otherwise("APPLY_RESUME_QUERY"))
    return states.select(F.col("ts").alias("at"), operation.alias("operation"), F.col("event_id").alias("target_id"), "scope",
                         F.concat_ws(":", "outcome", "target").alias("result"))


def resume(states: DataFrame, events: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Resume view per scope: active decision, rejected branches, rationale edges, first open loop, next action."""
    loops = events.where(F.col("event_type") == "OPEN_LOOP").groupBy("scope").agg(
        F.min_by("event_id", F.struct(*ORDER)).alias("open_loop"))
    summary = states.groupBy("scope").agg(
        F.max(F.when(F.col("status") == "ACTIVE", F.col("event_id"))).alias("active_event"),
        F.count_if(F.col("status") == "ACTIVE").alias("active_count"),
        F.count_if(F.col("status") == "REJECTED").alias("rejected_count"),
        F.count_if(F.col("status") == "HELD").alias("held_count"))
    active = summary.select("scope", F.col("active_event").alias("event_id"))
    touching = edge_rows.select("scope", F.explode(F.array("from_event", "to_event")).alias("event_id"))
    rationale = touching.groupBy("scope", "event_id").agg(F.count("*").alias("rationale_edges"))
    out = summary.join(loops, "scope", "full_outer").join(active.join(rationale, ["scope", "event_id"]).drop("event_id"), "scope", "left")
    return out.select(
        "scope", "active_event", F.coalesce("active_count", F.lit(0)).alias("active_count"),
        F.coalesce("rejected_count", F.lit(0)).alias("rejected_count"), F.coalesce("held_count", F.lit(0)).alias("held_count"),
        F.coalesce("rationale_edges", F.lit(0)).alias("rationale_edges"), "open_loop",
        F.when(F.col("open_loop").isNotNull(), NEXT_WITH_LOOP).otherwise(NEXT_WITHOUT_LOOP).alias("next_action"))


def resume_points(events: DataFrame) -> DataFrame:
    """What a resume query sees at its place in the stream: active decision and what came before it."""
    kind = F.col("event_type")
    counted = {name: Running("sum", F.when(kind == wanted, 1).otherwise(0))
               for name, wanted in (("decisions", DECISION), ("proposals", PROPOSAL), ("claims", CLAIM), ("open_loops", "OPEN_LOOP"))}
    rows = with_prior_decision(events, counted).where(kind == RESUME)
    return rows.select("event_id", "scope", F.col("prior.event_id").alias("active_event"),
                       *[F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n) for n in counted])


def invariants(states: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Per scope: one active decision at most, only from the user, nothing deleted, every change has its reason."""
    explained = edge_rows.select("scope", F.when(F.col("relation_type") == "SUPERSEDES", F.col("to_event"))
                                 .when(F.col("relation_type") == "REJECTED_BECAUSE", F.col("to_event")).alias("event_id")).where(
        F.col("event_id").isNotNull()).distinct().withColumn("explained", F.lit(True))
    rows = states.join(explained, ["scope", "event_id"], "left")
    changed = F.col("status").isin("SUPERSEDED", "REJECTED")
    return rows.groupBy("scope").agg(
        (F.count_if(F.col("status") == "ACTIVE") <= 1).alias("one_active"),
        (F.count_if((F.col("status") == "ACTIVE") & (F.col("event_type") != DECISION)) == 0).alias("active_from_user"),
        (F.count_if(F.col("status").isNull() & (F.col("event_type") != RESUME)) == 0).alias("nothing_deleted"),
        (F.count_if(changed & F.col("explained").isNull()) == 0).alias("rationale_present"))


def fold_changes(changes: DataFrame, key: str, order: list[str], after: list[str]) -> DataFrame:
    """Current row per item: the last after-image, partially aggregated before the shuffle."""
    last = changes.groupBy(key).agg(F.max_by(F.struct(*after), F.struct(*order)).alias("last"), F.count("*").alias("changes"))
    return last.select(key, "last.*", "changes")


def change_sequence(changes: DataFrame, key: str, order: list[str], after: str, levels: list[list[str]]) -> DataFrame:
    """Place of each change in its item's log and the image it starts from."""
    return running_values(changes, [key], order, {"seq": Running("sum", F.lit(1), inclusive=True),
                                                  "before": Running("last", F.col(after))}, levels)


def freshness(sources: DataFrame, today: str, stale_after_days: int) -> DataFrame:
    age = F.datediff(F.lit(today).cast("date"), F.try_to_timestamp("as_of", F.lit("yyyy-MM-dd")).cast("date"))
    return sources.select("source_id", "as_of", age.cast("long").alias("age_days"),
                          F.when(age.isNull(), "UNKNOWN").when(age > stale_after_days, "STALE").otherwise("FRESH").alias("freshness"))


def decayed(facts: DataFrame, now: Column, floor: float = 0.05, scale_days: float = 30.0) -> DataFrame:
    """Facts whose strength exp(-age / (scale * stability)) fell below the floor become Deprecated.

    ``facts`` has (fact_id, last_accessed, stability, access_count).  The formula is a declared parameter.
    """
    age = F.unix_micros(now) - F.unix_micros(F.col("last_accessed").cast("timestamp"))
    days = age / F.lit(86400000000.0)
    strength = F.exp(-days / (scale_days * F.col("stability")))
    return facts.select("fact_id", "access_count", F.round(days, 4).alias("age_days"),
                        F.when(strength < floor, "Deprecated").otherwise("Active").alias("state"))
