"""Message corpora: atoms, sampling, span matching, segmentation and typing metrics."""

from __future__ import annotations

from functools import reduce
from math import ceil, log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import spans as sp
from attesta.plans.scale import Running, lookup_join, never_sent, one_row_flag, running_values, top_k_per_group
from attesta.session import cut_lineage, written


# ---- atoms ------------------------------------------------------------------
def atoms(messages: DataFrame, pattern: str) -> DataFrame:
    """Verbatim spans of whole messages with offsets and hashes; only the piece travels with its row."""
    cut = messages.withColumn("__p", sp.pieces(F.col("text"), pattern)).drop("text")
    # an inner explode would ask for the size of the array first, and so cut every text twice
    rows = cut.withColumn("p", F.explode_outer("__p")).drop("__p").where(F.col("p").isNotNull()).select("*", "p.*").drop("p")
    return rows.withColumn("atom_id", F.concat_ws("#", "message_id", "pos")).withColumn("content_sha256", F.sha2("piece", 256))


def split_integrity(messages: DataFrame, pattern: str) -> DataFrame:
    """Do the children put together give the parent, without a gap?  Checked inside the row."""
    rows = messages.withColumn("p", sp.pieces(F.col("text"), pattern))
    joined = F.array_join(F.transform("p", lambda s: s["piece"]), "")
    gaps = F.size(F.filter(F.zip_with(F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(1))),
                                      F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(1))),
                                      lambda a, b: b["start_at"].isNotNull() & (a["end_at"] != b["start_at"])), lambda x: x))
    return rows.select("message_id", F.size("p").cast("long").alias("children"), (joined == F.col("text")).alias("reconstructs"),
                       gaps.cast("long").alias("gaps"))


def evidence_split(rows: DataFrame, complete: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with full structural evidence, and the exclusion ledger of the others."""
    ok = F.coalesce(complete, F.lit(False))
    return rows.where(ok), rows.where(~ok)


def sample_window(messages: DataFrame, stream: str, order: str, size: int, start: Column) -> DataFrame:
    """The first ``size`` messages of each stream from its start on, in order; no label is looked at."""
    return top_k_per_group(messages.where(start), [stream], [F.col(order).asc(), F.col("message_id").asc()], size, "place")


def without_calibration(rows: DataFrame, calibration: DataFrame, row_key: str) -> DataFrame:
    """Leave out what the calibration set holds, by content hash; very many copies of one text are spread."""
    known = calibration.select(F.sha2("text", 256).alias("__h")).distinct()
    hashed = rows.withColumn("__h", F.sha2("text", 256))
    return lookup_join(hashed, known, ["__h"], [row_key], "left_anti").drop("__h")


# ---- span matching ----------------------------------------------------------
def overlap_pairs(gold: DataFrame, pred: DataFrame, parent: str, threshold: float = 0.5) -> DataFrame:
    """Pairs of spans inside one parent with IoU at least ``threshold``.

    Lengths of such a pair differ by a factor of 1/threshold at most and their starts by no more than
    1/threshold - 1 times the shorter length.  A predicted span gets one bucket by its length class and start;
    a gold span asks the few buckets such a partner can stand in.  The join is an equality on (parent, class,
    bucket), so a parent of any length is spread and no pair is built only to be dropped.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    steps = ceil(log2(1 / threshold)) if threshold < 1 else 0
    reach = max(1, ceil(1 / threshold - 1))
    # whole part of the binary logarithm, exact
    cls = F.length(F.bin(F.col("end_at") - F.col("start_at"))) - 1
    width = F.expr("shiftleft(1L, cls + 1)")
    p = pred.where("end_at > start_at").withColumn("cls", cls).select(
        parent, "cls", F.floor(F.col("start_at") / width).cast("long").alias("bucket"),
        F.col("span_id").alias("pred_id"), F.col("start_at").alias("pred_start"), F.col("end_at").alias("pred_end"))
    around = F.sequence(F.lit(-reach), F.lit(reach))
    g = gold.where("end_at > start_at").withColumn("own", cls).withColumn(
        "cls", F.explode(F.sequence(F.greatest(F.col("own") - steps, F.lit(0)), F.col("own") + steps)))
    g = g.withColumn("step", F.explode(around)).select(
        parent, "cls", (F.floor(F.col("start_at") / width) + F.col("step")).cast("long").alias("bucket"),
        F.col("span_id").alias("gold_id"), F.col("start_at").alias("gold_start"), F.col("end_at").alias("gold_end"))
    pairs = g.join(never_sent(p), [parent, "cls", "bucket"])
    share = sp.iou(F.col("gold_start"), F.col("gold_end"), F.col("pred_start"), F.col("pred_end"))
    return pairs.withColumn("iou", share).where(F.col("iou") >= threshold).drop("cls", "bucket")


def one_to_one(pairs: DataFrame, parent: str, most: int = 100_000) -> DataFrame:
    """Greedy one-to-one matching under the order (IoU down, gold start, pred start, gold id, pred id).

    Pairs can only compete for a span where their ranges overlap.  A sweep over the pairs of a parent by their start
    (running values, so a parent of any length is spread) cuts them into stretches that share no span; each stretch is
    walked on its own, in one pass over sorted rows.  Stretches of more than ``most`` pairs go round by round instead
    (``mutual_best``), which takes any size and gives the same pairs.
    """
    lo, hi = F.least("gold_start", "pred_start"), F.greatest("gold_end", "pred_end")
    ranges = written(pairs.withColumns({"__lo": lo, "__hi": hi}).withColumn("__block", F.shiftright("__lo", 10)), "pairs")
    order, levels = ["__lo", "gold_id", "pred_id"], [["__block"]]
    reach = written(running_values(ranges, [parent], order, {"__reach": Running("max", F.col("__hi"))}, levels, stored=True),
                    "pair-reach")
    begins = F.when(F.col("__reach").isNull() | (F.col("__lo") >= F.col("__reach")), F.col("__lo"))
    cut = written(running_values(reach, [parent], order, {"__stretch": Running("last", begins, inclusive=True)}, levels, stored=True)
                  .drop("__hi", "__block", "__reach"), "pair-stretches")
    key = [parent, "__stretch"]
    large = cut.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*key)
    if not one_row_flag(large):
        return _walked(cut, key).select(*pairs.columns)
    rest = lookup_join(cut, large, key, ["gold_id", "pred_id"], "left_anti")
    long = lookup_join(cut, large, key, ["gold_id", "pred_id"], "left_semi")
    return _walked(rest, key).select(*pairs.columns).unionByName(mutual_best(long, parent).select(*pairs.columns))


def _walked(rows: DataFrame, key: list[str]) -> DataFrame:
    """The greedy walk over each stretch; a task keeps the used spans of one stretch."""
    def walk(batches):
        at, gold, pred = None, set(), set()
        for batch in batches:
            keep = []
            for n, (stretch, g, p) in enumerate(zip(zip(*[batch.column(k).to_pylist() for k in key]),
                                                    batch.column("gold_id").to_pylist(), batch.column("pred_id").to_pylist())):
                if stretch != at:
                    at, gold, pred = stretch, set(), set()
                if g not in gold and p not in pred:
                    gold.add(g)
                    pred.add(p)
                    keep.append(n)
            yield batch.take(pa.array(keep, pa.int64()))

    order = [F.desc("iou"), "gold_start", "pred_start", "gold_id", "pred_id"]
    return rows.repartition(*key).sortWithinPartitions(*key, *order).mapInArrow(walk, rows.schema)


def mutual_best(pairs: DataFrame, parent: str) -> DataFrame:
    """The same matching in rounds, for stretches of any size.

    A pair that comes first for both of its spans is what the greedy walk would take, so each round accepts all
    such pairs at once and drops what they use up.  The first pair of the order always qualifies, so it ends.
    """
    order = F.struct((-F.col("iou")).alias("a"), F.col("gold_start").alias("b"), F.col("pred_start").alias("c"),
                     F.col("gold_id").alias("d"), F.col("pred_id").alias("e"))
    rest = cut_lineage(pairs.withColumn("place", order))
    taken = []
    while one_row_flag(rest):
        best_gold = rest.groupBy(parent, "gold_id").agg(F.min("place").alias("gold_best"))
        best_pred = rest.groupBy(parent, "pred_id").agg(F.min("place").alias("pred_best"))
        accepted = rest.join(best_gold, [parent, "gold_id"]).join(best_pred, [parent, "pred_id"]).where(
            (F.col("place") == F.col("gold_best")) & (F.col("place") == F.col("pred_best"))).select(*rest.columns)
        taken.append(cut_lineage(accepted))
        rest = cut_lineage(rest.join(taken[-1].select(parent, "gold_id"), [parent, "gold_id"], "left_anti")
                           .join(taken[-1].select(parent, "pred_id"), [parent, "pred_id"], "left_anti"))
    return reduce(DataFrame.unionByName, taken, rest).drop("place")


def overlap_counts(left: DataFrame, right: DataFrame, parent: str) -> DataFrame:
    """How many right spans share a character with each left span, without building a pair.

    It is the number of right spans that start before the left one ends, less those that end before it starts.
    """
    parts = []
    for side, point, ask, first, sign in (("starts", "start_at", "end_at", "ask", 1), ("ends", "end_at", "start_at", "point", -1)):
        points = right.where("end_at > start_at").select(
            parent, F.lit(side).alias("side"), F.col(point).alias("at"), F.lit(0 if first == "point" else 1).alias("turn"),
            F.lit(None).cast("string").alias("span_id"), F.lit(1).alias("one"), F.lit(sign).alias("sign"))
        asks = left.where("end_at > start_at").select(
            parent, F.lit(side).alias("side"), F.col(ask).alias("at"), F.lit(0 if first == "ask" else 1).alias("turn"),
            F.col("span_id"), F.lit(0).alias("one"), F.lit(sign).alias("sign"))
        parts += [points, asks]
    merged = reduce(DataFrame.unionByName, parts).withColumn("block", F.shiftright("at", 10))
    counted = running_values(merged, [parent, "side"], ["at", "turn"], {"before": Running("sum", F.col("one"))}, [["block"]],
                             stored=True)
    return counted.where(F.col("span_id").isNotNull()).groupBy(parent, "span_id").agg(
        F.sum(F.coalesce("before", F.lit(0)) * F.col("sign")).cast("long").alias("partners"))


def segmentation_metrics(gold: DataFrame, pred: DataFrame, matched: DataFrame, parent: str) -> DataFrame:
    """Detection, boundary and segmentation figures in one row; splits and merges count raw overlaps."""
    split = overlap_counts(gold, pred, parent)
    wide = overlap_counts(pred, gold, parent).where("partners > 1").select(parent, "span_id")
    merging = pred.join(never_sent(wide), [parent, "span_id"], "left_semi")
    merged = overlap_counts(gold, merging, parent)
    found = matched.agg(F.struct(F.count("*").alias("tp"), F.avg("iou").alias("mean_iou")).alias("m")).scalar()
    n_pred = pred.where("end_at > start_at").agg(F.count("*").alias("n")).scalar()
    under = merged.agg(F.count_if(F.col("partners") > 0).alias("n")).scalar()
    row = split.agg(F.count("*").alias("n_gold"), F.count_if(F.col("partners") > 1).alias("split_gold"))
    row = row.withColumn("m", found).withColumn("n_pred", n_pred).withColumn("merged_gold", under)
    tp, n_gold = F.col("m.tp"), F.col("n_gold")
    return row.select(
        "n_gold", "n_pred", tp.alias("tp"), F.round(F.try_divide(tp, n_gold), 6).alias("recall"),
        F.round(F.try_divide(tp, F.col("n_pred")), 6).alias("precision"),
        F.round(F.try_divide(n_gold - tp, n_gold), 6).alias("missed_rate"), F.round("m.mean_iou", 6).alias("mean_iou"),
        F.round(F.try_divide(F.col("split_gold"), n_gold), 6).alias("over_segmentation"),
        F.round(F.try_divide(F.col("merged_gold"), n_gold), 6).alias("under_segmentation"))


# ---- typing -----------------------------------------------------------------
def confusion(rows: DataFrame, axis: str, gold: str, pred: str, sparse_below: int) -> DataFrame:
    """Long form confusion counts; a gold class with too few rows is not estimable."""
    counts = rows.groupBy(F.lit(axis).alias("axis"), F.col(gold).alias("gold_label"), F.col(pred).alias("pred_label")).agg(
        F.count("*").alias("n"))
    totals = counts.groupBy(F.col("gold_label").alias("label")).agg(F.sum("n").alias("total"))
    status = F.when(F.col("total") < sparse_below, "SPARSE / NOT_ESTIMABLE").otherwise("ESTIMABLE")
    return counts.join(totals, F.col("gold_label").eqNullSafe(F.col("label")), "left").select(
        "axis", "gold_label", "pred_label", "n", status.alias("status"))


def critical_errors(rows: DataFrame, families: dict[str, Column]) -> DataFrame:
    """Counts of each family of critical errors in one pass."""
    return rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in families.items()])


def presence(value: Column) -> Column:
    """PRESENT / NOT_PRESENT / UNKNOWN; a missing annotation never becomes NOT_PRESENT."""
    return F.when(value.isNull(), "UNKNOWN").when(value == 1, "PRESENT").otherwise("NOT_PRESENT")
