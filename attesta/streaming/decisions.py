"""Structured Streaming form of the decision state machine and of the change log; Spark keeps the state.

Events may arrive in any order within the watermark.  A scope's state is its last decision and the events that the
watermark has not passed yet; an event-time timer takes those in the order of (ts, event_id) once it has.  A scope
without new events or due timers costs a batch nothing.  What a later decision does to older events follows from the
log.  An event that comes after its minute was closed goes to the ledger and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from attesta.operators import governance as gov
from attesta.plans.scale import lookup_join
from attesta.session import DEFAULTS, scratch_path

MINUTE_MS = 60_000
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
EVENT = "event_id long, at long, event_type string, parity long, home boolean"
LAST = "event_id long, parity long"
ADMITTED = ("scope long, event_id long, at long, event_type string, parity long, prior_id long, prior_parity long, reason string")
AdmittedRow = Row(*[field.split()[0] for field in ADMITTED.split(", ")])


def event_stream(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    """File stream over the files of one table."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


@contextmanager
def _state_columns(spark: SparkSession) -> Iterator[None]:
    """A query started inside keeps its state in RocksDB, whatever the session has: only that store takes several state
    variables of one operator.  The query copies the session's settings when it starts and a restart takes them from its
    checkpoint, so the session gets its own back at once."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, DEFAULTS[STATE_STORE])
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


class DecisionProcessor(StatefulProcessor):
    """Puts the events of one (scope, slice) into order and gives each the decision before it.

    Decisions come to every slice of their scope, other events to one; only the row marked ``home`` is written.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", LAST)
        self.pending = handle.getListState("pending", EVENT)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        closed = timerValues.getCurrentWatermarkInMs()
        early = []
        for r in rows:
            if r.at is not None and self._end(r.at) > closed:
                early.append((r.event_id, r.at, r.event_type, r.parity, r.home))
            elif r.home:
                yield AdmittedRow(key[0], r.event_id, r.at, r.event_type, r.parity, None, None, "NO_TIME" if r.at is None else "LATE")
        if early:
            self.pending.appendList(early)
            self._wake(min(self._end(e[1]) for e in early))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        closed = timerValues.getCurrentWatermarkInMs()
        due, later = [], []
        for e in self.pending.get():
            (due if self._end(e[1]) <= closed else later).append(tuple(e))
        self.pending.clear()
        if later:
            self.pending.put(later)
            self._wake(min(self._end(e[1]) for e in later))
        last = self.last.get() or (None, None)
        decided = False
        for event_id, at, kind, parity, home in sorted(due, key=lambda e: (e[1], e[0])):
            if home:
                yield AdmittedRow(key[0], event_id, at, kind, parity, last[0], last[1], None)
            if kind == gov.DECISION:
                last, decided = (event_id, parity), True
        if decided:
            self.last.update(last)

    def _wake(self, at: int) -> None:
        """One timer for each key: the earliest minute that has to be closed."""
        for other in list(self.handle.listTimers()):
            if other <= at:
                return
            self.handle.deleteTimer(other)
        self.handle.registerTimer(at)

    @staticmethod
    def _end(at: int) -> int:
        """Milliseconds of the end of the minute of a time in microseconds."""
        return (at // 1000 // MINUTE_MS + 1) * MINUTE_MS

    def close(self) -> None:
        pass


class DecisionStream:
    """Runs the state machine over a stream of typed events; log, ledger and checkpoint lie below ``root``.

    ``delay`` is how late an event may come.  ``slices`` deals the events of a scope over that many keys, so that a
    scope with a third of all events is not one task's work; its decisions, the few events that others need, are
    repeated for each slice.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, delay: str = "1 hour", slices: int = 4):
        self.spark = spark
        self.root = root or scratch_path(spark, "decisions")
        self.delay, self.slices = delay, slices
        self.checkpoint = f"{self.root}/checkpoint"

    def admitted(self, events: DataFrame) -> DataFrame:
        """Stream of (scope, event, decision before it), or a ledger reason, as the watermark passes."""
        home = F.pmod(F.xxhash64("event_id"), F.lit(self.slices)).cast("int")
        every = F.sequence(F.lit(0), F.lit(self.slices - 1))
        timed = events.where(F.col("event_type") != "OPEN_LOOP").withColumn("ts", F.col("ts").cast("timestamp"))
        # the time goes on as a number: Spark drops late rows of a marked time column before the operator sees them
        rows = timed.withWatermark("ts", self.delay).select(
            F.col("scope").cast("long").alias("scope"), F.col("event_id").cast("long").alias("event_id"), F.unix_micros("ts").alias("at"),
            "event_type", F.col("parity").cast("long").alias("parity"), home.alias("own"),
            F.explode(F.when(F.col("event_type") == gov.DECISION, every).otherwise(F.array(home))).alias("slice"))
        return (rows.withColumn("home", F.col("slice") == F.col("own")).drop("own").groupBy("scope", "slice")
                .transformWithState(DecisionProcessor(), ADMITTED, "Append", "EventTime"))

    def run(self, events: DataFrame) -> None:
        """Process everything that is there now and stop."""
        with _state_columns(self.spark):
            query = (self.admitted(events).writeStream.format("parquet").outputMode("append").option("path", f"{self.root}/log")
                     .option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start())
        query.awaitTermination()

    def _written(self) -> DataFrame:
        return self.spark.read.schema(ADMITTED).parquet(f"{self.root}/log")

    def _state(self, name: str) -> DataFrame:
        return self.spark.read.format("statestore").option("stateVarName", name).load(self.checkpoint)

    def ledger(self) -> DataFrame:
        """Events that came too late or without a time; they were not applied."""
        return self._written().where(F.col("reason").isNotNull()).select(
            "scope", "event_id", F.timestamp_micros("at").alias("ts"), "event_type", "reason")

    def _open(self) -> DataFrame:
        """Events the watermark has not passed, in the order that holds if nothing else comes."""
        rows = self._state("pending").select(F.col("key.scope").alias("scope"), F.col("list_element.*")).where("home")
        rows = rows.withColumn("ts", F.timestamp_micros("at")).withColumn("minute", F.date_trunc("minute", "ts"))
        last = self._state("last").where("key.slice = 0").select(
            F.col("key.scope").alias("scope"), F.struct("value.event_id", "value.parity").alias("carried"))
        rows = lookup_join(gov.with_prior_decision(rows), last, ["scope"], ["event_id"])
        return rows.withColumn("prior", F.coalesce("prior", "carried"))

    def log(self) -> DataFrame:
        """Every applied event with its admission: what is written, and what still waits for the watermark."""
        columns = ["scope", "event_id", "ts", "event_type", "parity", "prior", "settled"]
        prior = F.when(F.col("prior_id").isNotNull(), F.struct(F.col("prior_id").alias("event_id"), F.col("prior_parity").alias("parity")))
        done = self._written().where(F.col("reason").isNull()).withColumn("ts", F.timestamp_micros("at")).withColumn("prior", prior)
        rows = done.withColumn("settled", F.lit(True)).select(*columns).unionByName(
            self._open().withColumn("settled", F.lit(False)).select(*columns))
        return rows.withColumn("minute", F.date_trunc("minute", "ts")).withColumn("admission", gov.admission(gov.same_parity())).select(
            *columns, "minute", F.col("admission.outcome").alias("outcome"), F.col("admission.target").alias("target"))

    def states(self) -> DataFrame:
        """Status of every applied event now."""
        return gov.final_states(self.log())


class ChangeFold:
    """Current row per item from a stream of changes: a streaming aggregate; each batch writes the rows it changed.

    A repeated batch overwrites its own folder, so nothing counts twice.
    """

    def __init__(self, spark: SparkSession, key: str, order: list[str], after: list[str], root: str | None = None):
        self.spark, self.key, self.order, self.after = spark, key, order, after
        self.root = root or scratch_path(spark, "fold")

    def _store(self, changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{self.root}/rows/batch={batch_id}")

    def run(self, changes: DataFrame) -> DataFrame:
        folded = gov.fold_changes(changes, self.key, self.order, self.after)
        query = (folded.writeStream.outputMode("update").foreachBatch(self._store)
                 .option("checkpointLocation", f"{self.root}/checkpoint").trigger(availableNow=True).start())
        query.awaitTermination()
        rows = self.spark.read.parquet(f"{self.root}/rows")
        columns = [*self.after, "changes"]
        return rows.groupBy(self.key).agg(F.max_by(F.struct(*columns), "batch").alias("row")).select(self.key, "row.*")


def without_redelivery(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Drop events delivered again within the watermark."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])


def append_run(events: DataFrame, label: str) -> DataFrame:
    """Append what the stream holds now to a table in the shared folder and read it."""
    spark = events.sparkSession
    root = scratch_path(spark, label)
    query = (events.writeStream.format("parquet").outputMode("append").option("path", f"{root}/data")
             .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(events.schema).parquet(f"{root}/data")
