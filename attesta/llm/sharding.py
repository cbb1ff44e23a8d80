"""Sharding by histogram sort: exact bytes below candidate boundaries, refined probes, then one exchange."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import halving
from attesta.session import written

SHARDS = 40
ROW_BYTES = 16
TOLERANCE = 0.001          # of a shard
PROBES = 64                # candidate boundaries inside each open interval, per round
TASK_BYTES = 64 * 2**20    # a task of the exchange sorts about this much


@dataclass
class _Open:
    """A boundary still sought: ``goal`` bytes below it, between ``low`` (with ``below`` bytes) and ``high``."""

    goal: int
    low: int
    high: int
    below: int
    upto: int


def split_points(rows: DataFrame, key: str, size: str, parts: int, tolerance: float = TOLERANCE) -> list[int]:
    """``parts - 1`` ascending keys that cut ``rows`` into parts of nearly equal ``size``; a part holds keys >= its
    lower point.

    Every round counts, over all partitions, the exact bytes between candidate keys, ``PROBES`` inside each open
    interval, and keeps the bin that holds the wanted number.  A round moves at most ``parts * PROBES`` sums to the driver, never rows, and an interval shrinks by the factor
    ``PROBES``, so 64-bit keys are settled after 11 rounds.  A boundary is settled when a candidate is within
    ``tolerance`` of a part or the interval is a single key; then the nearer end counts.
    """
    span = rows.agg(F.min(key), F.max(key), F.sum(size)).first()
    if span[0] is None:
        return [0] * (parts - 1)
    low, high, total = int(span[0]), int(span[1]) + 1, int(span[2])
    slack = tolerance * total / parts
    settled: dict[int, int] = {}
    open_ = {i: _Open(total * i // parts, low, high, 0, total) for i in range(1, parts)}
    while open_:
        intervals = sorted({(o.low, o.high) for o in open_.values()})
        sums = _histogram(rows, key, size, intervals)
        for i, o in list(open_.items()):
            width = max(1, -(-(o.high - o.low) // PROBES))
            below = o.below
            for n in range(PROBES):
                start = o.low + n * width
                upto = below + sums.get((o.low, n), 0)
                if upto >= o.goal or start + width >= o.high:
                    o.low, o.high, o.below, o.upto = start, min(start + width, o.high), below, upto
                    break
                below = upto
            near_low, near_high = o.goal - o.below, o.upto - o.goal
            if min(near_low, near_high) <= slack or o.high - o.low <= 1:
                settled[i] = o.low if near_low <= near_high else o.high
                del open_[i]
    return [settled[i] for i in range(1, parts)]


def _histogram(rows, key, size, intervals):
    """Exact ``size`` sums per (interval, bin); open intervals are disjoint or equal, at most one per boundary."""
    starts = [lo for lo, _ in intervals]
    widths = F.array(*[F.lit(max(1, -(-(hi - lo) // PROBES))).cast("long") for lo, hi in intervals])
    place = halving(F.col(key), starts)
    inside = rows.select(F.col(key).alias("k"), F.col(size).alias("s"), place.alias("i")).where("i > 0")
    inside = inside.withColumn("lo", F.element_at(F.array(*[F.lit(x).cast("long") for x in starts]), F.col("i")))
    ends = F.array(*[F.lit(hi - 1).cast("long") for _, hi in intervals])
    inside = inside.where(F.col("k") <= F.element_at(ends, F.col("i")))
    inside = inside.withColumn("width", F.element_at(widths, F.col("i")))
    # a key range wider than 63 bits needs wider arithmetic
    kind = "decimal(20,0)" if max(hi - lo for lo, hi in intervals) >= 2**63 else "long"
    step = F.expr(f"(cast(k as {kind}) - lo) div width")
    found = inside.groupBy("lo", step.alias("bin")).agg(F.sum("s").alias("bytes")).collect()
    return {(r["lo"], r["bin"]): int(r["bytes"]) for r in found}


def shard(rows: DataFrame, key: str, size: str, shards: int = SHARDS, tie: str | None = None,
          task_bytes: int = TASK_BYTES) -> DataFrame:
    """``rows`` plus ``shard`` (0 to ``shards - 1``, nearly equal bytes, ascending in ``key``) and ``slot`` (gapless
    place inside the shard, ascending in ``key``, then ``tie``).

    Each shard is cut into pieces of about ``task_bytes`` (by the same histogram), so no task sorts a whole shard; the rows cross the network
    once, to their piece.  Slots of a piece start where the pieces before it in the shard end; that table has one row
    per piece.  Rows with an equal key stay together (a key is one document); a missing key goes to shard 0 as key
    0.  An empty table gives no rows.
    """
    keyed = rows.withColumn("__key", F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long")))
    total = keyed.agg(F.sum(size)).first()[0] or 0
    pieces = max(1, -(-int(total) // (shards * task_bytes)))
    points = split_points(keyed, "__key", size, shards * pieces)
    placed = keyed.withColumn("__piece", halving(F.col("__key"), points))
    counts = placed.groupBy("__piece").agg(F.count("*").alias("__rows")) \
        .withColumn("__shard", F.expr(f"__piece div {pieces}"))
    ahead = Window.partitionBy("__shard").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__piece", F.coalesce(F.sum("__rows").over(ahead), F.lit(0)).alias("__ahead"))
    inside = Window.partitionBy("__piece").orderBy("__key", *([tie] if tie else []))
    return (placed.withColumn("__row", F.row_number().over(inside).cast("long"))
            .join(F.broadcast(offsets), "__piece")
            .withColumn("shard", F.expr(f"__piece div {pieces}").cast("int"))
            .withColumn("slot", F.col("__row") - 1 + F.col("__ahead"))
            .drop("__key", "__piece", "__row", "__ahead"))


def document_sizes(docs: DataFrame) -> DataFrame:
    """Per document its bytes in a shard (UTF-8 bytes of the text, none if missing, plus 16) and its text's CRC-32 (of
    no bytes if missing)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))


def sharded_sizes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """All documents with size, checksum, shard and slot, by the law ``bytes``; only these narrow rows are exchanged."""
    sizes = written(document_sizes(docs), "shard-sizes")
    return (shard(sizes, "doc_id", "size", shards, tie="text_crc32")
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Store whole documents, one folder per shard; files of a shard follow the order of its slots."""
    sized = docs.withColumn("__size", (F.octet_length(F.coalesce("text", F.lit(""))) + ROW_BYTES).cast("long"))
    shard(sized, "doc_id", "__size", shards).drop("__size").write.partitionBy("shard").parquet(path)
