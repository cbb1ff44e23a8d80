"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.common import WORD, ranked
from attesta.session import written

CYCLE = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 20240117
HASH_BITS = 48
LEVEL_BITS = 12


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _key(source: Column) -> Column:
    """A join key that tells a missing source from every text."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """``sources`` (one row per ``source``) plus ``weight``: the cycle repeated over the sources in code-point order,
    a missing source last."""
    order = [F.col("source").asc_nulls_last()]
    weights = F.array(*[F.lit(w) for w in cycle])
    place = F.pmod(F.col("before_rows"), F.lit(len(cycle))).cast("int") + 1
    return ranked(sources, order, []).withColumn("weight", F.element_at(weights, place)).drop("before_rows")


def water_level(sources: DataFrame, total: float) -> float:
    """The level at which ``min(cap, level * weight)`` over ``sources`` adds up to ``total``.

    Each round clamps the sources whose weighted part exceeds their cap and shares out the rest by weight.  The level
    only rises and the clamped set only grows, so the rounds end; each is one aggregate that returns one row.  If all
    caps together are below ``total`` every source is clamped and the level is infinite.
    """
    level = 0.0
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(F.when(over, F.col("cap")).otherwise(0)).alias("clamped"),
                          F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("open")).first()
        if not row["open"]:
            return float("inf")
        raised = (total - (row["clamped"] or 0)) / row["open"]
        if raised <= level * (1 + 1e-12):
            return level
        level = raised


def targets(sizes: DataFrame, share: float = 1.0, max_epochs: int = MAX_EPOCHS,
            cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """One row per source: ``source_size``, ``weight``, ``target`` words, ``whole`` repetitions of every document and
    ``wanted`` words from one more, fractional repetition."""
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighted = written(cyclic_weights(per_source, cycle).withColumn("cap", F.col("source_size") * max_epochs),
                       "mix-sources")
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(weighted, total * share)
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level))
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (weighted.withColumn("target", F.when(F.col("cap") > 0, target).otherwise(F.lit(0.0)))
            .withColumn("whole", F.least(F.floor(epochs + F.lit(1e-9)), F.lit(max_epochs)).cast("long"))
            .withColumn("wanted", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
            .select(_key(F.col("source")).alias("source_key"), "source_size", "target", "whole", "wanted"))


def _place(doc_id: Column, seed: int) -> Column:
    """A document's place in the seeded order of its source."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 64 - HASH_BITS)


def cut_points(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """``goals`` plus ``cut``: documents placed below it get the fractional repetition.

    The cut is found by refining a histogram: words per source and bin of the place, then again inside the one bin in
    which the wanted number is reached, until a bin is one place.  A source has at most 4096 bins a round however many
    documents it has, and the sums are made in the tasks before the shuffle.  The document at the cut is taken if that
    comes nearer to the wanted number.
    """
    open_goals = goals.select("source_key", "wanted", F.lit(0).cast("long").alias("prefix"),
                              F.lit(0).cast("double").alias("got"))
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        upper = F.shiftrightunsigned("place", shift + LEVEL_BITS)
        bins = (sizes.where("size > 0").join(open_goals.where("wanted > 0"), "source_key")
                .where(upper == F.col("prefix"))
                .groupBy("source_key", "wanted", "got", F.shiftrightunsigned("place", shift).alias("bin"))
                .agg(F.sum("size").alias("words")))
        order = Window.partitionBy("source_key").orderBy("bin")
        running = bins.withColumn("upto", F.col("got") + F.sum("words").over(order))
        reached = running.where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("words") < F.col("wanted")))
        open_goals = written(reached.select("source_key", "wanted", F.col("bin").alias("prefix"),
                                            (F.col("upto") - F.col("words")).alias("got"), "words"), "mix-cut")
    nearer = (F.col("wanted") - F.col("got")) * 2 >= F.col("words")
    cuts = open_goals.select("source_key", (F.col("prefix") + F.when(nearer, 1).otherwise(0)).alias("cut"))
    return goals.join(cuts, "source_key", "left").withColumn("cut", F.coalesce("cut", F.lit(0).cast("long")))


def mix_plan(docs: DataFrame, share: float = 1.0, max_epochs: int = MAX_EPOCHS, cycle: tuple[int, ...] = CYCLE,
             seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Sizes of all documents, and one row per source with target, whole repetitions and cut.

    Rows that repeat a ``doc_id`` share its place, so they are taken or left together; a document without text or
    words has size 0 and adds nothing to its source; a missing source is a source of its own.  An empty table gives
    empty results.
    """
    sizes = written(docs.select("doc_id", "source", _key(F.col("source")).alias("source_key"),
                                word_count(F.col("text")).alias("size"), _place(F.col("doc_id"), seed).alias("place")),
                    "mix-sizes")
    goals = targets(sizes, share, max_epochs, cycle)
    return sizes, written(cut_points(sizes, goals), "mix-goals")


def mixed_sizes(docs: DataFrame, **options) -> DataFrame:
    """Per document its size, its source's size and target, and the words the mix takes of it."""
    sizes, goals = mix_plan(docs, **options)
    taken = F.col("size") * (F.col("whole") + F.when(F.col("place") < F.col("cut"), 1).otherwise(0))
    return (sizes.join(goals, "source_key")
            .select("doc_id", "size", "source_size", "target", taken.alias("taken")))


def mix(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The mixed table: every document as often as the mix takes it, with its own columns.

    Documents of size 0 follow the whole and fractional repetitions of their source like any other.
    """
    _, goals = mix_plan(docs, seed=seed, **options)
    goals = goals.select(F.col("source_key").alias("__mix_key"), F.col("whole").alias("__mix_whole"),
                         F.col("cut").alias("__mix_cut"))
    times = F.col("__mix_whole") + F.when(_place(docs["doc_id"], seed) < F.col("__mix_cut"), 1).otherwise(0)
    joined = docs.withColumn("__mix_key", _key(F.col("source"))).join(goals, "__mix_key")
    return (joined.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(0), times.cast("int"))))
            .select(*[joined[c] for c in docs.columns]))
