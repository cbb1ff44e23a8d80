"""What several operators of this subpackage share."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.session import written

# a word is a run of characters other than ASCII blanks; bytes.split() cuts UTF-8 at the same places
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(df: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """``df`` plus ``before_rows`` and ``before_<column>``: rows, and sums of ``sums``, ahead of each row in ``order``.

    The rows are range-partitioned and stored once, so that partition numbers stay as they are when a task is
    repeated.  What lies ahead of a partition is a running sum over one row per partition (bounded by the number of
    partitions, hence the broadcast); within a partition it is a window.  No task sees more than its own range.
    """
    n = partitions(df.sparkSession)
    parts = written(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    one = F.lit(1).cast("long")
    values = {"rows": one, **{c: F.col(c) for c in sums}}
    totals = parts.groupBy("__part").agg(*[F.sum(v).alias(f"__{c}") for c, v in values.items()])
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", *[F.coalesce(F.sum(f"__{c}").over(ahead), F.lit(0)).alias(f"__{c}")
                                        for c in values])
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = parts.withColumns({f"before_{c}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for c, v in values.items()})
    return (near.join(F.broadcast(offsets), "__part")
            .withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"__{c}") for c in values})
            .drop("__part", *[f"__{c}" for c in values]))


def matched(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int, share: int = 1000) -> DataFrame:
    """Left join of ``rows`` with one row per ``key`` of ``groups`` when a key may hold a third of all rows.

    ``count`` is how many of the ``total`` rows a key has.  At most ``share`` keys can have more than
    ``total / share`` rows each, so those are broadcast and their rows stay where they are; every other key is small
    and goes through an ordinary join.
    """
    hot = groups.where(F.col(count) * share > total)
    cold = groups.where(F.col(count) * share <= total)
    on_hot = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return on_hot.unionByName(rest.join(cold, key, "left"))


def slices(batches, column: str = "text", most: int = 2**21, rows: int = 512):
    """Arrow batches cut to at most ``rows`` rows and about ``most`` bytes of ``column`` (a longer value alone), so
    that what a task unpacks at a time stays small whatever the session's batch size."""
    for batch in batches:
        values = batch.column(column)
        measure = pc.list_value_length if pa.types.is_list(values.type) else pc.binary_length
        lengths = pc.fill_null(measure(values), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            ends = lengths[at:at + rows].cumsum()
            n = max(1, int((ends <= most).sum()))
            yield batch.slice(at, n)
            at += n


def runs(batches, keys: list[str], columns: list[str]):
    """(key values, rows) for each run of equal ``keys`` in batches that are sorted by them; holds one run."""
    last, held = None, []
    for batch in batches:
        for key, row in zip(zip(*[batch.column(k).to_pylist() for k in keys]),
                            zip(*[batch.column(c).to_pylist() for c in columns])):
            if held and key != last:
                yield last, held
                held = []
            last = key
            held.append(row)
    if held:
        yield last, held


def halving(key: Column, points: list[int]) -> Column:
    """How many of the ascending ``points`` are at or below ``key``: a few comparisons for each row."""
    def between(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(key < F.lit(points[middle]), between(lo, middle)).otherwise(between(middle + 1, hi))

    if len(points) <= 128:
        return between(0, len(points)).cast("int")
    # many points: halve over every 64th, then look through the 64 that follow
    coarse = halving(key, points[63::64])
    blocks = F.array(*[F.array(*[F.lit(p).cast("long") for p in points[i:i + 64]])
                       for i in range(0, len(points), 64)], F.array().cast("array<long>"))
    block = F.element_at(blocks, coarse + 1)
    return (coarse * 64 + F.size(F.filter(block, lambda p: p <= key))).cast("int")
