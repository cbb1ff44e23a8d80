"""Near-duplicate groups against comparing every pair of sets in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.llm import jaccard_join
from attesta.llm.common import documents
from tests_llm_plain import plain_groups


def near_copies(seed, base_words, copies, edits):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(400)}" for _ in range(base_words)]
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rnd.randrange(edits + 1)):
            words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("which", ["fixture", "table", "blocks"])
def test_groups(spark, docs, which, monkeypatch):
    if which == "blocks":
        # components of several blocks, some of them of several groups: all three passes
        monkeypatch.setattr(jaccard_join, "BLOCK", 5)
        texts = near_copies(1, 100, 30, 3) + near_copies(2, 40, 20, 2) + near_copies(3, 12, 12, 1)
        texts += near_copies(4, 300, 25, 9) + ["alone here now", "a b", "a b", ""]
        rows = list(enumerate(texts))
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    else:
        table = (docs if which == "fixture" else documents(spark, "/root/testdata/sf0.01")).where("doc_id is not null")
        rows = [(r.doc_id, r.text) for r in table.collect()]
    got = sorted(tuple(r) for r in jaccard_join.groups(table).collect())
    assert got == plain_groups(rows)
    assert sorted(tuple(r) for r in jaccard_join.groups(table, 5, 80, by="rare").collect()) == plain_groups(rows, 5, 80)


def test_missing_ids_and_empty_table(spark, docs, empty):
    got = jaccard_join.groups(docs)
    assert got.count() == docs.count()
    by_text = {r.doc_id: r.component_id for r in got.collect()}
    assert by_text[-5] == -5
    assert jaccard_join.groups(empty).count() == 0
    assert jaccard_join.groups(empty, by="rare").count() == 0
    assert {r.doc_id: r.component_id for r in jaccard_join.groups(docs, by="rare").collect()} == by_text
    with pytest.raises(ValueError):
        jaccard_join.groups(docs, by="other")
    stays = jaccard_join.one_of_each(docs)
    assert stays.columns == docs.columns
    assert stays.where("doc_id is null").count() == 2


def test_candidates_lose_no_link():
    """Sets at the limit of the similarity share a part hash, at all sizes."""
    import numpy as np

    rnd = np.random.default_rng(7)
    for size in [9, 10, 11, 14, 19, 20, 27, 28, 40, 77, 150, 400]:
        for _ in range(40):
            union = rnd.integers(0, 2**63, size, dtype=np.uint64)
            differ = size - -(-size * 9 // 10)
            cut = rnd.integers(0, differ + 1)
            pair = [np.sort(union[cut:]), np.sort(np.concatenate([union[:cut], union[differ:]]))]
            if 100 * (size - differ) < 90 * size or not differ:
                continue
            grams, upto = np.concatenate(pair), np.cumsum([len(p) for p in pair])
            sigs, ends = jaccard_join.signatures(grams, upto)
            assert set(sigs[:ends[0]].tolist()) & set(sigs[ends[0]:].tolist())


def test_rare_keys_lose_no_link():
    """Sets at the limit of the similarity share as many keys as either needs, whatever the counters hold."""
    import numpy as np
    needed = {size: max(1, -(-size * 8 // 10) // jaccard_join.EXTRA) for size in range(401)}

    rnd = np.random.default_rng(8)
    for size in [5, 6, 9, 10, 19, 40, 77, 150, 400]:
        for _ in range(40):
            levels = rnd.integers(2, 6, 2**jaccard_join.COUNTER_BITS, dtype=np.uint8)
            union = rnd.integers(0, 2**63, size, dtype=np.uint64)
            differ = size - -(-size * 8 // 10)
            cut = rnd.integers(0, differ + 1)
            pair = [np.sort(union[cut:]), np.sort(np.concatenate([union[:cut], union[differ:]]))]
            grams, upto = np.concatenate(pair), np.cumsum([len(p) for p in pair])
            shared = len(set(pair[0].tolist()) & set(pair[1].tolist()))
            if 100 * shared < 80 * (sum(map(len, pair)) - shared):
                continue
            keys, ends = jaccard_join.rare_keys(grams, upto, levels, 80)
            both = set(keys[:ends[0]].tolist()) & set(keys[ends[0]:].tolist())
            assert len(both) >= max(needed[len(p)] for p in pair)


def test_keys_needed(spark):
    """The column agrees with whole-number arithmetic."""
    rows = spark.range(1, 401).select("id", jaccard_join.keys_needed(F.col("id"), 80).alias("needed")).collect()
    assert all(r.needed == max(1, -(-r.id * 8 // 10) // jaccard_join.EXTRA) for r in rows)


@pytest.mark.parametrize("by", ["parts", "rare"])
def test_rows_that_share_or_lack_an_id(spark, by):
    """Each row links by its own text, with and without an id, and only rows that are near copies go."""
    a, b, c = (near_copies(seed, 120, 1, 0)[0] for seed in (11, 12, 13))
    words = [f"v{i}" for i in range(140)]
    chain = [" ".join([f"{'xyz'[k]}{i}" if i < 12 * k else w for i, w in enumerate(words)]) for k in range(2)]
    chain.append(" ".join([*chain[1].split()[:128], *[f"q{i}" for i in range(12)]]))
    rows = [(1, a), (1, b), (2, a + " end"), (2, c), (3, b + " end"), (4, chain[0]), (None, chain[1]), (5, chain[2]),
            (6, a + " last"), (6, a + " last word")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.groups(table, 3, 80, by=by).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [
        (0, 4), (1, 1), (1, 1), (2, 1), (2, 2), (3, 1), (4, 4), (5, 4), (6, 1), (6, 1)]
    stays = [tuple(r) for r in jaccard_join.one_of_each(table, 3, 80, by=by).collect()]
    assert sorted(stays, key=str) == sorted([(1, a), (1, b), (2, c), (4, chain[0]), (None, chain[1])], key=str)


def test_each_set_gives_its_keys_once(spark):
    rows = [(5, 3, [1, 2, 3]), (5, 3, [1, 2, 3]), (6, 2, [1, 9]), (7, 0, []), (7, 0, [])]
    described = spark.createDataFrame([(i, i % 2, *r) for i, r in enumerate(rows)],
                                      "doc_id long, __row long, node long, n_shingles long, sigs array<long>")
    got = sorted(map(tuple, jaccard_join._one_per_node(described).collect()))
    assert got == [(5, 3, [1, 2, 3]), (6, 2, [1, 9]), (7, 0, [])]
