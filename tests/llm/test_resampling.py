"""Importance resampling: checksums against zlib, the query against its SQL, the draw against plain sorting."""

import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from attesta.llm import check_sql, resampling

COLUMNS = ["doc_id", "n_features", "weight", "score", "rank"]
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_checksums():
    rnd = random.Random(2)
    spans = [bytes(rnd.randrange(256) for _ in range(n))
             for n in [1, 2, 63, 64, 65, 127, 128, 129, 191, 193, 1000, 1, 40_000, 64 * 17, 3]]
    ends = np.cumsum([len(s) + 1 for s in spans]) - 1
    data = np.frombuffer(b" ".join(spans), dtype=np.uint8)
    got = resampling.checksums(data, ends - [len(s) for s in spans], ends)
    assert got.tolist() == [zlib.crc32(s) for s in spans]


@pytest.mark.parametrize("window", [1, 7, 300, 2**20])
def test_words_of_batches(monkeypatch, window):
    monkeypatch.setattr(resampling, "SLICE", window)
    rnd = random.Random(window)
    for _ in range(12):
        texts = [None if rnd.random() < 0.1 else "".join(
            rnd.choice("aBZé9日 .,\n") if rnd.random() < 0.9 else "q" * rnd.choice([1, 64, 65, 129, 900])
            for _ in range(rnd.choice([0, 1, 5, 80]))) for _ in range(rnd.randrange(7))]
        got = [[] for _ in texts]
        for buckets, owners in resampling.hashed_words(pa.array(texts, type=pa.string()), 9973):
            for bucket, owner in zip(buckets.tolist(), owners.tolist()):
                got[owner].append(bucket)
        lowered = [(t or "").translate({c: c + 32 for c in range(65, 91)}) for t in texts]
        assert got == [[zlib.crc32(w.encode()) % 9973 for w in WORDS.findall(t)] for t in lowered]


def by_sql(docs, target):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    con.register("benchmark", target.toArrow())
    found = con.execute(check_sql.RESAMPLING_SQL)
    names = [c[0] for c in found.description]
    return sorted((tuple(row[names.index(c)] for c in COLUMNS) for row in found.fetchall()), key=str)


def drawn(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@pytest.mark.parametrize("which", ["fixture", "table"])
def test_resampling(spark, docs, which):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    table = docs if which == "fixture" else spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert drawn(resampling.resampled(table, target)) == by_sql(table, target)


def test_draw_of_ties(spark):
    """Many rows with one id and one text: ranks without gaps, as many rows as the share says."""
    target = spark.createDataFrame([(1, "b b c")], "item_id long, text string")
    rows = [(7, "a b c " * 9)] * 400 + [(i, f"a {i} " * 12) for i in range(200)] + [(None, "b " * 30), (5, "few words")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = resampling.resampled(table, target, share=50).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert len(got) == 602 and ranks == list(range(1, 301))
    worst = min((r.score, ) for r in got if r["rank"] is not None)
    assert all(r["rank"] is not None for r in got if r.n_features >= 20 and (r.score, ) > worst)


def test_empty(spark, docs, empty):
    target = spark.createDataFrame([], "item_id long, text string")
    assert drawn(resampling.resampled(empty, target)) == []
    assert resampling.resampled(docs, target).count() == docs.count()
