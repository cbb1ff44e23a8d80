"""Word hashes against cutting texts in plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest

from attesta.llm import wordhash


@pytest.mark.parametrize("block", [7, 64, 2**20])
def test_words(block, monkeypatch):
    monkeypatch.setattr(wordhash, "BLOCK", block)
    rnd = random.Random(block)
    texts = [None, "", " ", "a", "x" * 200] + [
        "".join(rnd.choice(["a", "B", "b", "é", " ", "\n", "\x1c", "zz", "\x0b"]) for _ in range(rnd.randrange(60)))
        for _ in range(200)] + [None, "end"]
    column = pa.array(["skipped", *texts])[1:]
    hashes, upto = wordhash.words(column)
    assert list(upto) == list(np.cumsum([len((t or "").encode().split()) for t in texts]))
    of = {}
    for h, w in zip(hashes.tolist(), [w for t in texts for w in (t or "").encode().lower().split()]):
        assert of.setdefault(w, h) == h
    assert len(set(of.values())) == len(of)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 16, 50])
def test_ngrams(n):
    rnd = random.Random(n)
    h = np.array([rnd.randrange(4) for _ in range(300)], np.uint64)
    grams = wordhash.ngrams(h, n)
    assert len(grams) == 301 - n
    of = {}
    for i, g in enumerate(grams.tolist()):
        assert of.setdefault(tuple(h[i:i + n].tolist()), g) == g
    assert len(set(of.values())) == len(of) and len(wordhash.ngrams(h[:n - 1], n)) == 0
