"""Token store and piece segmentation against the libraries, plain dynamic programming and exact round trips."""

import json
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from attesta.llm import pieces, token_store
from attesta.llm.common import documents, tokenizer_file

SF = "/root/testdata/sf0.001"
BPE = tokenizer_file("byte_bpe_50k.json")
MODEL = tokenizer_file("piece_bpe_32k.model")


def plain_ids(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    return [e.ids + [0] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("which", ["fixture", "table"])
def test_token_store(spark, docs, empty, which, monkeypatch, tmp_path):
    table = docs if which == "fixture" else documents(spark, SF)
    if which == "fixture":
        monkeypatch.setattr(token_store, "PART_BYTES", 20_000)
        monkeypatch.setattr(token_store, "SEGMENT_BYTES", 3_000)
    rows = table.select("doc_id", "text").collect()
    ids = plain_ids([r.text or "" for r in rows])
    want = Counter((r.doc_id, len(i), zlib.crc32(np.asarray(i, "<u4").tobytes())) for r, i in zip(rows, ids))
    path = str(tmp_path / "store")
    token_store.write_store(table, path, BPE)
    got = sorted(token_store.read_digests(spark, path).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert order == sorted(order)
    asked = [r.doc_id for r in rows if r.doc_id is not None][:3]
    few = {r.doc_id: r.ids for r in token_store.read_ids(spark, path, asked).collect()}
    assert set(few) == set(asked)
    assert all(few[r.doc_id] == i for r, i in zip(rows, ids) if r.doc_id in asked and r.doc_id != 1000)
    if which == "fixture":
        assert token_store.stored_digests(empty, BPE).count() == 0


def test_word_cut_equals_whole_text():
    rnd = random.Random(3)
    alphabet = ["a", "B", "'s", " ", "  ", "\n", "\t", "é", "1", "!", "\x1c", " ", "　", "日", "<|endoftext|>"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(2000)]
    bpe = token_store.ByteBpe.of(BPE)
    assert [list(np.frombuffer(i, "<u4")) + [0] for i in bpe.encode_all(texts)] == plain_ids(texts)


def whole_text_ids(text):
    """One sweep over the whole text, without cuts or chunks."""
    model = pieces.Pieces.of(MODEL)
    full = " " + text
    best, came = model.sweep(full, 0, len(full), 0)
    return best[-1], list(np.frombuffer(model.trace(full, came, 0, len(full)), "<i4"))


def score(ids):
    model = pieces.Pieces.of(MODEL)
    of = {i: model.score[p] for p, i in model.id.items()}
    return sum(of.get(i, 0) for i in ids)


TEXTS = ["The quick  brown fox", "a▁b ▁", "   ", "日本語 のテキスト", "x" * 40, "-" * 37 + " " * 21 + "\n\n=" * 9,
         "Gever eine der chäte mit achgeber, geßber ö der enpfeinung", "\U0001f600 ok", "<s> </s> <unk> <0x41>"]


def test_segmentation_is_the_library_lattice():
    """Same lattice and scores in the library's own Viterbi (the model's type switched, nothing trained)."""
    import sentencepiece

    raw = open(MODEL, "rb").read()
    bpe_type = b"tok_v0\x18\x02"
    if raw.count(bpe_type) != 1:
        pytest.skip("model file without the expected type field")
    viterbi = sentencepiece.SentencePieceProcessor(model_proto=raw.replace(bpe_type, b"tok_v0\x18\x01"))
    model = pieces.Pieces.of(MODEL)
    for word in "The quick brown fox enpfeinung chäte achgeber thwhtion oftionnten representation".split():
        assert list(np.frombuffer(model.encode_all([word])[0], "<i4")) == viterbi.encode(word)


def test_many_at_once(spark):
    """Stretches swept together give what each gives alone."""
    model = pieces.Pieces.of(MODEL)
    texts = [r.text for r in documents(spark, SF).limit(40).collect()]
    stretches = list({x for t in texts for x in pieces._RUN.findall(" " + t)} | {" 日本é", " 日本x", "  a", " ▁b"})
    assert model.solve_many(stretches) == {x: model.solve(x) for x in stretches}


@pytest.mark.parametrize("chunk", [5, 17, 64])
def test_chunks_equal_whole(spark, chunk, monkeypatch):
    monkeypatch.setattr(pieces, "FAN", 3)
    rnd = random.Random(chunk)
    texts = TEXTS + ["".join(rnd.choice("ab e the in\n-日") for _ in range(rnd.randrange(1, 300))) for _ in range(30)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pieces.Pieces.of(MODEL)
    for r in pieces.encode(table, MODEL, chunk).collect():
        best, ids = whole_text_ids(r.text)
        assert model.decode(r.ids) == r.text
        assert score(r.ids) == score(ids), r.text
        assert list(np.frombuffer(model.encode_all([r.text])[0], "<i4")) == ids


@pytest.mark.parametrize("which", ["fixture", "table"])
def test_round_trip(spark, docs, empty, which):
    table = docs if which == "fixture" else documents(spark, SF)
    rows = pieces.encoded_and_checked(table, MODEL, chunk=1000).collect()
    assert len(rows) == table.count() and all(r.round_trip for r in rows)
    texts = {r.doc_id: r.text for r in table.collect()}
    for r in rows:
        text = texts.get(r.doc_id)
        if r.doc_id is not None and r.doc_id != 1000:
            assert (r.ids is None) == (text is None) and r.n_tokens == len(r.ids or [])
            if text:
                assert score(r.ids) == score(whole_text_ids(text)[1])
    encoded = pieces.encode(docs, MODEL)
    assert encoded.columns == [*docs.columns, "ids"]
    assert all(r.decoded == r.text for r in pieces.decode(encoded, MODEL).collect())
    assert pieces.encoded_and_checked(empty, MODEL).count() == 0


def test_new_words_are_merged_many_at_a_time():
    calls = []

    class Model:
        def __init__(self, model):
            self.model = model

        def tokenize(self, text):
            calls.append(text)
            return self.model.tokenize(text)

    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer, self.model = tokenizer, Model(tokenizer.model)

        def encode(self, text, **more):
            calls.append(text)
            return self.tokenizer.encode(text, **more)

    bpe = token_store.ByteBpe(BPE)
    library = bpe.tokenizer
    letters = "abcdefgh"
    words = [a + b + c + d + e for a in letters for b in letters for c in letters for d in "aé" for e in ("", ".", "ing,")]
    texts = [" ".join(words[i:i + 300]) + ".\n" + "\n".join(words[i:i + 30]) for i in range(0, len(words), 300)]
    texts += ["a\n\nb", "\nab cd", "ab ", "  a  b\n c", "don't\nit's", "a.\n", "a" + "!" * 9 + " b!!!!!!!!! c",
              "ª º µ × ab×", "日本 語。\nab", "a\u0301b c", "a\tb\r\nc", "<|endoftext|> ab", "ab .\ncd", "", "\n", "x\u00a0\ny"]
    bpe.tokenizer = Counting(library)
    found = bpe.encode_all(texts)
    assert found == [np.asarray(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert len(calls) < len(words) / 3
    assert bpe.encode_all(texts) == found


def test_vocabularies_that_join_a_letter_and_a_space_are_told(tmp_path):
    model = {"vocab": {"a": 0, "\u0120": 1, "a\u0120": 2, "\u0120a": 3}, "merges": [["\u0120", "a"]]}
    file = tmp_path / "vocabulary.json"
    for merges, apart in (([["\u0120", "a"]], True), ([["a", "\u0120"]], False), ([["\u0120\u00c2\u0142", "\u0120"]], True)):
        file.write_text(json.dumps({"model": model | {"merges": merges}}))
        told, starts = token_store._space_stays_apart(str(file))
        assert (told, starts.tolist()) == (apart, [False, True, False, True])
