"""Span matching against brute force over small random segmentations."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.functions import spans as sp
from attesta.functions.text import FINE_PIECE, PIECE
from attesta.operators import corpus


def random_spans(rng, parents=6, n=25, longest=60):
    return [(f"m{p}", str(i), s, s + rng.randint(1, longest)) for p in range(parents) for i in range(n) for s in [rng.randint(0, 300)]]


def frames(spark, gold, pred):
    schema = "parent string, span_id string, start_at long, end_at long"
    return spark.createDataFrame(gold, schema), spark.createDataFrame(pred, schema)


def brute_pairs(gold, pred, threshold):
    out = {}
    for gp, gi, gs, ge in gold:
        for pp, pi, ps, pe in pred:
            common = min(ge, pe) - max(gs, ps)
            if gp == pp and common > 0:
                share = common / (ge - gs + pe - ps - common)
                if share >= threshold:
                    out[gp, gi, pi] = (share, gs, ps)
    return out


@pytest.mark.parametrize("threshold", [0.5, 0.3, 1.0])
def test_overlap_pairs(spark, threshold):
    rng = random.Random(3)
    gold, pred = random_spans(rng), random_spans(rng)
    got = corpus.overlap_pairs(*frames(spark, gold, pred), "parent", threshold).select("parent", "gold_id", "pred_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_pairs(gold, pred, threshold))


def test_exact_half_is_a_match(spark):
    g, p = frames(spark, [("m", "0", 0, 10), ("m", "1", 100, 108)], [("m", "0", 0, 5), ("m", "1", 100, 116)])
    assert {(r.gold_id, r.pred_id) for r in corpus.overlap_pairs(g, p, "parent").collect()} == {("0", "0"), ("1", "1")}


@pytest.mark.parametrize("most", [0, 5, 100_000])
def test_one_to_one_equals_the_greedy_walk(spark, most):
    """All stretches walked, all in rounds, and long ones in rounds only."""
    rng = random.Random(11)
    gold, pred = random_spans(rng, 4, 40, 30), random_spans(rng, 4, 40, 30)
    pairs = brute_pairs(gold, pred, 0.5)
    walk = sorted((-share, gs, ps, gi, pi, parent) for (parent, gi, pi), (share, gs, ps) in pairs.items())
    used, want = set(), set()
    for _, _, _, gi, pi, parent in walk:
        if ("g", parent, gi) not in used and ("p", parent, pi) not in used:
            used |= {("g", parent, gi), ("p", parent, pi)}
            want.add((parent, gi, pi))
    got = corpus.one_to_one(corpus.overlap_pairs(*frames(spark, gold, pred), "parent"), "parent", most)
    assert {(r.parent, r.gold_id, r.pred_id) for r in got.collect()} == want


def test_overlap_counts(spark):
    rng = random.Random(5)
    gold, pred = random_spans(rng), random_spans(rng, longest=2000)
    got = {(r.parent, r.span_id): r.partners for r in corpus.overlap_counts(*frames(spark, gold, pred), "parent").collect()}
    want = {(gp, gi): sum(gp == pp and ps < ge and pe > gs for pp, _, ps, pe in pred) for gp, gi, gs, ge in gold}
    assert got == want


def test_metrics_of_a_split_and_a_merge(spark):
    gold = [("m", "0", 0, 10), ("m", "1", 10, 20), ("m", "2", 20, 30), ("m", "3", 40, 50)]
    pred = [("m", "0", 0, 6), ("m", "1", 6, 10), ("m", "2", 10, 30)]
    g, p = frames(spark, gold, pred)
    row = corpus.segmentation_metrics(g, p, corpus.one_to_one(corpus.overlap_pairs(g, p, "parent"), "parent"), "parent").first()
    assert (row.n_gold, row.n_pred, row.tp) == (4, 3, 2)
    assert (row.recall, row.precision, row.missed_rate) == (0.5, 0.666667, 0.5)
    assert (row.over_segmentation, row.under_segmentation) == (0.25, 0.5)


def test_pieces_cover_whole_texts_by_code_point(spark):
    text = "Привет, 😀 мир.\nNo end\n.. tail"
    df = spark.createDataFrame([("a", text), ("b", ""), ("c", None)], "message_id string, text string")
    for pattern in (PIECE, FINE_PIECE):
        cut = df.select("message_id", sp.pieces(F.col("text"), pattern).alias("p")).collect()
        found = {r.message_id: r.p for r in cut}
        assert "".join(s.piece for s in found["a"]) == text
        assert all(text[s.start_at:s.end_at] == s.piece for s in found["a"])
        assert found["b"] == [] and found["c"] is None


def test_default_markers(spark):
    df = spark.createDataFrame([("Скажи, если можно, please?",)], "text string")
    hits = df.select(sp.markers(F.col("text"), sp.MARKER_LEXICON).alias("m")).first().m
    assert {h.kind for h in hits} == {"REQUEST_PLEASE", "CONDITIONAL_IF", "OPTIONAL_CAN", "QUESTION_MARK"}
    assert all("Скажи, если можно, please?"[h.start_at:h.end_at] == h.piece for h in hits)


def test_texts_are_cut_once(spark):
    df = spark.createDataFrame([("m", "a. b.")], "message_id string, text string")
    rows = corpus.atoms(df, PIECE)
    plan = rows._sc._jvm.PythonSQLUtils.explainString(rows._jdf.queryExecution(), "simple")
    assert plan.count("ArrowEvalPython") == 1 and rows.count() == 2


def test_pieces_of_one_large_batch(spark):
    """More texts in a batch than are cut at once: missing and empty texts, letters beyond the first plane, no Python rows kept."""
    import re
    texts = [None if n % 7 == 3 else "" if n % 7 == 5 else f"Satz {n}. 𝔘nd é\n" * (n % 4) + "end" for n in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, t string").coalesce(1)
    got = {r.n: r.p for r in rows.select("n", sp.pieces(F.col("t"), r"[^.\n]*[.\n]+|[^.\n]+").alias("p")).collect()}
    for n, t in enumerate(texts):
        want = None if t is None else [(i, m.start(), m.end(), m.group()) for i, m in enumerate(re.finditer(r"[^.\n]*[.\n]+|[^.\n]+", t))]
        assert (got[n] if got[n] is None else [tuple(x) for x in got[n]]) == want
    assert sp.TEXTS_AT_ONCE < len(texts)


def test_stored_spans_are_not_sent_to_the_driver(spark):
    """Stored spans are small as files only: no side of the joins over them is a broadcast."""
    from attesta.session import written
    spans = written(spark.range(400).select((F.col("id") % 7).cast("string").alias("m"), F.col("id").cast("string").alias("span_id"),
                                            (F.col("id") * 5).alias("start_at"), (F.col("id") * 5 + 5).alias("end_at")), "spans")
    pairs = corpus.overlap_pairs(spans, spans, "m")
    counts = corpus.overlap_counts(spans, spans, "m")
    for df in (pairs, counts):
        assert "BroadcastExchange" not in df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    assert pairs.where("gold_id = pred_id").count() == 400 and counts.where("partners = 1").count() == 400
