"""Language identification: held-out accuracy, whole texts, and the awkward rows."""

import zlib

import pytest

from attesta.llm import language

SCHEMA = "doc_id long, text string, lang string, source string, best string, lead string, n long, hash long, window string"


def is_held_out(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def table(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def test_held_out_accuracy(table):
    given = {r.doc_id: r for r in table.collect()}
    got = language.predicted(table).collect()
    assert sorted(r.doc_id for r in got) == sorted(given)
    assert all(r.held_out == is_held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    tested = [r for r in got if r.held_out and given[r.doc_id].text]
    right = [r for r in tested if r.lang_pred == given[r.doc_id].lang]
    assert len(tested) > 150 and len(right) >= 0.97 * len(tested)
    sure = [r for r in tested if not r.rejected]
    assert len(sure) >= 0.95 * len(tested)
    assert sum(r.lang_pred == given[r.doc_id].lang for r in sure) >= 0.98 * len(sure)


def test_only_training_rows_count(spark, table):
    """Other labels of held-out rows, other ids order, other sources: the same model."""
    first = language.train(table)
    other = table.withColumn("lang", language.F.when(language.held_out(language.F.col("doc_id")), "xx")
                             .otherwise(language.F.col("lang"))).withColumn("source", language.F.lit("s")).repartition(5)
    assert language.train(other) == first
    assert all(0 < len(d) <= language.DICTIONARY_BYTES for d in first.values())


def test_bounded_sample(spark):
    """Copies count once; a language with few texts gives several windows of each."""
    ids = [i for i in range(9000) if not is_held_out(i)]
    rows = [(i, "the same words again " * 30, "en") for i in ids[:3000]]
    rows += [(i, f"andere worte nummer {i} " * 3, "de") for i in ids[3000:6000]] + [(ids[6000], "mots " * 90, "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = language.sample(docs, windows=50).collect()
    count = {lang: sum(r.lang == lang for r in got) for lang in ("en", "de", "fr")}
    assert count == {"en": 50, "de": 50, "fr": 50}
    assert len({r.hash for r in got if r.lang == "de"}) == 50 and len({r.hash for r in got if r.lang == "en"}) == 1
    assert {r.lang for r in language.sample(docs, windows=50, languages=1).collect()} == {"de"}


def test_whole_texts_and_rejection():
    """What stands far behind the first part decides too, and an even mixture has a narrow lead."""
    dictionaries = {"a": b" alle achten auf das wetter" * 50, "b": b" every otter swims up the river" * 50}
    made = language.encoders(dictionaries)
    a, b = "alle achten auf das wetter. ", "Every otter, swims up the river! "
    text = a * 10 + b * 80_000
    found = language.sizes(text, made)
    assert len(text) > 2 * language.PART_CHARS and found["b"] < found["a"]
    assert language.normalised("Ä1ß_ \x00!x\n") == "ä ß x".encode()


def test_awkward_rows(spark, docs, empty):
    given = docs.collect()
    got = language.predicted(docs).collect()
    assert len(got) == len(given)
    letters = {r.doc_id: any(c.isalpha() for c in r.text or "") for r in given if r.doc_id is not None}
    assert all((r.lang_pred == "und") != letters[r.doc_id] for r in got if r.doc_id is not None)
    assert all(r.score == 0 and r.rejected for r in got if r.lang_pred == "und")
    assert language.predicted(empty).count() == 0
    unlabelled = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in language.predicted(unlabelled).collect()] == [(1, is_held_out(1), "und", 0.0, True)]
    extra = spark.createDataFrame([(i, "words of a text " * 5, "en", "s", "x", "y", 1, 2, "w") for i in range(9)], SCHEMA)
    assert {r.lang_pred for r in language.predicted(extra).collect()} == {"en"}
