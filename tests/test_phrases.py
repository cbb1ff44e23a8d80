"""One automaton for many phrases against one pattern after the other; redaction inside nested values."""

import random
import re

import pytest
from pyspark.sql import functions as F

from attesta.functions import phrases as ph
from attesta.functions import spans as sp
from attesta.functions import text as tx
from attesta.operators.search_index import INTENTS, intents_of

WORDS = ["let's", "let", "us", "if", "IF", "Если", "если", "потому", "что", "can", "canned", "may", "?", "always", "скажите", "скажи", "давай",
         "давайте", "ёлка", "only", "x_if", "if2", "é", "пожалуйста"]


def some_texts(n, seed=4):
    rng = random.Random(seed)
    return ["".join(rng.choice(WORDS) + rng.choice([" ", " ", ", ", ".", "", "\n"]) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_markers_equal_patterns():
    table = tuple(ph.lexicon_phrases(ph.MARKER_PHRASES))
    seen = set()
    for text in some_texts(400):
        want = sorted((m.start(), kind, m.end()) for kind, p in sp.MARKER_LEXICON.items() for m in re.finditer(p, text))
        got = sorted((s, kind, e) for kind, s, e in ph.hits(text, table))
        assert got == want, text
        seen |= {kind for _, kind, _ in got}
    assert seen == set(ph.MARKER_PHRASES)


def test_cues_equal_patterns(spark):
    words = ["who", "whose", "кто", "кто,", "хочу", "goal", "ungoal", "почему", "now", "known", "неизвестно", "уже", "уже ", "done", "where to look",
             "source", "resource", "different", "next", "nextly", "дальше"]
    rng = random.Random(9)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 5))) for _ in range(300)] + ["", None]
    cues = [p for n, (cue, _, _) in enumerate(INTENTS) for p in ph.cue_phrases(str(n), cue)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", intents_of(F.col("t")).alias("want"), ph.phrase_kinds(F.col("t"), cues).alias("got")).collect()
    for r in rows:
        assert r.got == [str(n) for n, yes in enumerate(r.want) if yes], r.t
    assert {k for r in rows for k in r.got} == {str(n) for n in range(len(INTENTS))}


def test_offsets_are_those_of_the_text(spark):
    text = "😀 İ If — a.b? IF"
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    rows = df.select(ph.phrase_hits(F.col("t"), ph.lexicon_phrases(ph.MARKER_PHRASES)).alias("h")).collect()
    assert [(h.kind, h.piece) for h in rows[0].h] == [("CONDITIONAL_IF", "If"), ("QUESTION_MARK", "?"), ("CONDITIONAL_IF", "IF")]
    assert all(text[h.start_at:h.end_at] == h.piece for h in rows[0].h)
    assert rows[1].h == [] and rows[2].h is None


def test_letters_with_a_longer_lower_case_stand_for_themselves():
    assert list(ph.hits("İf if", tuple(ph.lexicon_phrases(ph.MARKER_PHRASES)))) == [("CONDITIONAL_IF", 3, 5)]


def test_longest_of_a_kind_counts_and_long_lists_work():
    table = (ph.Phrase("K", "ab", "", ""), ph.Phrase("K", "abc", "", ""), ph.Phrase("K", "ca", "", ""), ph.Phrase("L", "b", "", ""))
    assert list(ph.hits("abcab", table)) == [("K", 0, 3), ("L", 1, 2), ("K", 3, 5), ("L", 4, 5)]
    names = tuple(ph.private_phrases(f"name {i:05d}" for i in range(20000)))
    assert list(ph.hits("of NAME 19999 and docs.google.com/x, DOCS.GOOGLE.COM/x", names)) == [("LISTED_WORD", 3, 13), ("PRIVATE_URL", 18, 34)]
    assert list(ph.hits("anything", ())) == []


def test_empty_phrase_is_refused():
    with pytest.raises(ValueError):
        ph.phrase_hits(F.lit("x"), [ph.Phrase("K", "")])


def redact(value):
    if isinstance(value, str):
        while (s := value.find("[S]")) >= 0 and (e := value.find("[E]", s + 3)) >= 0:
            value = value[:s] + "$#\\" + value[e + 3:]
        return value
    if isinstance(value, list):
        return [redact(x) for x in value]
    if isinstance(value, dict):
        return {k: redact(x) for k, x in value.items()}
    return value


def test_redaction_reaches_every_nested_string(spark):
    rng = random.Random(2)

    def text():
        return None if rng.random() < 0.1 else "".join(rng.choice(["[S]", "[E]", "a", "\n", "[S", "ж"]) for _ in range(rng.randint(0, 8)))

    schema = ("id long, t string, parts array<struct<role string, lines array<string>, n int>>, "
              "meta map<string,struct<body string, tags map<string,string>>>")
    rows = [(i, text(), None if i % 7 == 0 else [(text(), [text() for _ in range(3)], i), None],
             {"[S]k[E]": (text(), {"a": text()}), "b": None} if i % 5 else None) for i in range(60)]
    df = spark.createDataFrame(rows, schema)
    got = tx.redacted_frame(df, "[S]", "[E]", "$#\\")
    assert got.schema.simpleString() == df.schema.simpleString()
    want = {r.id: redact(r.asDict(recursive=True)) for r in df.collect()}
    assert {r.id: r.asDict(recursive=True) for r in got.collect()} == want


def test_block_alone_becomes_empty(spark):
    rows = [("B", ""), ("x\n\nB", "x"), ("x\n\nB\n\nB", "x"), ("\n\nB", ""), ("xB", "xB"), ("B\n\nB", "B"), ("", ""), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string")
    assert all(r.got == r.want for r in df.select("want", tx.without_block(F.col("t"), "B").alias("got")).collect())
