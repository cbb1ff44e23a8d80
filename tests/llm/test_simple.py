"""Mixing, quality rules, sharding and exact dedup against plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from attesta.llm import exact_dedup, mixing, quality, sharding
from attesta.llm.common import documents
from tests_llm_plain import WORD, plain_quality

SF = "/root/testdata/sf0.001"


def collected(df):
    return [r.asDict() for r in df.collect()]


def plain_targets(sizes):
    """Exact water filling by the definition: clamp, share the rest by weight, again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, {s for s in order}
    left = float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 3 * sizes[s] + 1e-9}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("which", ["fixture", "table"])
def test_mixing(spark, docs, which):
    table = docs if which == "fixture" else documents(spark, SF)
    rows = collected(mixing.mixed_sizes(table))
    again = collected(mixing.mixed_sizes(table))
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"])
    assert sorted(rows, key=key) == sorted(again, key=key)
    given = table.select("doc_id", "text", "source").collect()
    assert len(rows) == len(given)
    sizes, largest = defaultdict(int), defaultdict(int)
    by_doc = defaultdict(set)
    for r in given:
        n = len(WORD.findall(r.text or ""))
        sizes[r.source] += n
        by_doc[r.source].add(r.doc_id)
        largest[r.source] = max(largest[r.source], n)
    target = plain_targets(sizes)
    for source, ids in by_doc.items():
        mine = [r for r in rows if r["doc_id"] in ids and r["source_size"] == sizes[source]]
        assert all(r["target"] == pytest.approx(target[source]) for r in mine)
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[source]) <= 2 * largest[source]


def test_mix_keeps_columns(docs, empty):
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    sizes = Counter(r["doc_id"] for r in collected(mixing.mixed_sizes(docs)) if r["taken"])
    copies = Counter(r["doc_id"] for r in collected(mixed))
    assert set(sizes) <= set(copies)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_sizes(empty).count() == 0


@pytest.mark.parametrize("which", ["fixture", "table"])
def test_quality(spark, docs, empty, which):
    table = docs if which == "fixture" else documents(spark, SF)
    got = sorted(([r["doc_id"] is None, r["doc_id"]], {k: r[k] for k in plain_quality("")}, r["kept"])
                 for r in collected(quality.judged(table)) if r["doc_id"] is not None and r["doc_id"] != 1000)
    want = {r.doc_id: plain_quality(r.text) for r in table.collect()}
    for (_, doc_id), counts, kept in got:
        assert counts == want[doc_id], doc_id
        assert not (kept and counts["base_failed"])
    assert quality.judged(empty).count() == 0
    good = quality.keep_good(table)
    assert good.columns == table.columns
    assert good.count() == sum(r["kept"] for r in collected(quality.judged(table)))


def test_quality_keeps_labelled_documents(spark):
    kept = quality.judged(documents(spark, "/root/testdata/sf0.01")).where("n_words >= 20")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    found = {(r.quality, r.kept): r.n for r in kept.join(labels, "doc_id").groupBy("quality", "kept").count()
             .withColumnRenamed("count", "n").collect()}
    assert found.get((1, False), 0) <= 0.02 * found[1, True]
    assert found.get((0, True), 0) <= 0.4 * found[0, False]


@pytest.mark.parametrize("which", ["fixture", "table"])
def test_sharding(spark, docs, which):
    table = docs if which == "fixture" else documents(spark, SF)
    rows = collected(sharding.sharded_sizes(table))
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode()))
                    for r in table.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == texts
    total = sum(r["size"] for r in rows)
    largest = max(r["size"] for r in rows)
    shards = defaultdict(list)
    for r in rows:
        shards[r["shard"]].append(r)
    for of in shards.values():
        assert sorted(r["slot"] for r in of) == list(range(len(of)))
        ids = [r["doc_id"] or 0 for r in sorted(of, key=lambda r: r["slot"])]
        assert ids == sorted(ids)
    if which == "table":
        assert set(shards) == set(range(40))
        assert all(abs(sum(r["size"] for r in of) - total / 40) <= largest + total / 40 * 0.002 for of in shards.values())
    assert sorted(rows, key=str) == sorted(collected(sharding.sharded_sizes(table)), key=str)


def test_sharding_in_pieces(spark, empty):
    """Many small pieces of a shard give the same slots as one; a hot range of keys is cut like any other."""
    table = spark.range(5000).selectExpr("cast(pow(id, 3) as long) as doc_id", "100 + id % 7 as size")
    one = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(table, "doc_id", "size", 5).collect()}
    many = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(table, "doc_id", "size", 5, task_bytes=1000).collect()}
    order = sorted(many, key=many.get)
    assert order == sorted(order) and len(many) == 5000
    assert abs(max(Counter(s for s, _ in many.values()).values()) - 1000) <= 10 and set(one) == set(many)
    assert sharding.sharded_sizes(empty).count() == 0


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("which", ["fixture", "table"])
def test_exact_dedup(spark, docs, empty, which):
    table = docs if which == "fixture" else documents(spark, SF)
    groups = defaultdict(list)
    for r in table.collect():
        groups[lower(r.text)].append(r.doc_id)
    want = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        want.update((i, keep, len(ids), keep is None or i == keep, sha) for i in ids)
    got = exact_dedup.copies(table)
    assert Counter(tuple(r) for r in got.collect()) == want
    stays = exact_dedup.distinct_texts(table)
    assert stays.columns == table.columns
    rows = stays.collect()
    assert sorted(lower(r.text) for r in rows) == sorted(groups)
    for r in rows:
        ids = [i for i in groups[lower(r.text)] if i is not None]
        assert r.doc_id == max(ids, default=None)
    assert exact_dedup.copies(empty).count() == 0 and exact_dedup.distinct_texts(empty).count() == 0


def test_exact_dedup_in_slices(docs, monkeypatch):
    """Many small filter slices give the same rows as one."""
    whole = Counter(tuple(r) for r in exact_dedup.copies(docs).collect())
    monkeypatch.setattr(exact_dedup, "SLICE_WORDS", 3)
    assert Counter(tuple(r) for r in exact_dedup.copies(docs).collect()) == whole
