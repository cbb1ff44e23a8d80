"""Repeated passages by sparse suffix arrays.

Of all suffixes of a text only those are retained that start at a minimiser: the word where, in some stretch of
``MIN_WORDS`` words, the smallest hash of ``GRAM`` words begins.  Which positions are retained depends on the words
alone, and every stretch of ``MIN_WORDS`` words holds one, at the same place in equal stretches; about one word in
eighteen starts a retained suffix.

Suffixes are ordered by the hash of their first ``GRAM`` words, and equal neighbours in that order are matches.  Only
suffixes with a match in another document are extended: every stretch that was assigned to such a suffix (so many
words to its left, the rest to its right) is compared with the other stretches in the same way.  Stretches that are found
again in another document and overlap or touch are one passage, so a passage is as long as its words go on being
repeated, and no repeated passage of ``MIN_WORDS`` words or more is missed.

Comparing neighbours is a count per hash, made in the tasks before the shuffle, so a passage that a third of all
documents share is one row per task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm import wordhash
from attesta.llm.common import matched, slices
from attesta.llm.exact_dedup import BITS_PER_ROW, SLICE_WORDS, _signature
from attesta.session import written

MIN_WORDS = 50
GRAM = 16


def suffixes(column: pa.Array, least: int = MIN_WORDS, gram: int = GRAM):
    """Per retained suffix of each row: row, its key, the first stretch assigned to it (place of its first word in
    the row), and the hashes of its stretches, which follow each other; these as one array with ends."""
    h, upto = wordhash.words(column)
    begin = np.append(0, upto[:-1]) if len(upto) else upto
    stretch = wordhash.ngrams(h, least)
    rows = np.repeat(np.arange(len(upto)), np.diff(upto, prepend=0))[:len(stretch)]
    start = np.flatnonzero(np.arange(len(stretch)) + least <= upto[rows]) if len(stretch) else np.zeros(0, np.int64)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none, none.view(np.uint64), none
    keys = wordhash.ngrams(h, gram)
    window = np.lib.stride_tricks.sliding_window_view(keys, least - gram + 1)
    place = start + np.concatenate([window[start[i:i + 65536]].argmin(1) for i in range(0, len(start), 65536)])
    new = np.ones(len(start), bool)
    new[1:] = (place[1:] != place[:-1]) | (rows[start[1:]] != rows[start[:-1]])
    first = np.flatnonzero(new)
    of = rows[start[first]]
    return of, keys[place[first]], start[first] - begin[of], stretch[start], np.append(first[1:], len(start))


def _scan(docs: DataFrame, emit, schema: str) -> DataFrame:
    """``emit(idents, suffixes)`` over slices of texts; documents without an id are documents of their own."""
    own = F.lit(-2**62) + F.monotonically_increasing_id()

    def run(batches):
        for batch in slices(batches):
            found = suffixes(batch.column("text"))
            if len(found[0]):
                yield emit(batch.column("ident").to_numpy(), found)

    return docs.select(F.coalesce(F.col("doc_id").cast("long"), own).alias("ident"), "text").mapInArrow(run, schema)


def _neighbours(batch_keys: np.ndarray, idents: np.ndarray):
    """Each key of a slice once, with the smallest and largest document that has it."""
    order = np.lexsort((idents, batch_keys))
    keys, ids = batch_keys[order], idents[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    last = np.append(first[1:], len(keys)) - 1
    return pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(ids[first]), pa.array(ids[last])],
                                      ["key", "low", "high"])


def _in_two_documents(keys: DataFrame) -> DataFrame:
    """Keys that at least two documents have, with the smallest of these."""
    return keys.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"),
                                   F.count("*").alias("n")).where("low < high")


def _passages(places: Column, least: int) -> Column:
    """Merged stretches out of sorted marks (twice the place of the first word, plus 1 if an earlier document has the
    stretch)."""
    def merged(marks):
        at = F.transform(marks, lambda m: F.shiftright(m, 1))

        def ends(a):
            begins = F.filter(a, lambda p, i: (i == 0) | (p > F.get(a, i - 1) + least))
            stops = F.filter(a, lambda p, i: (i == F.size(a) - 1) | (F.get(a, i + 1) > p + least))
            return F.zip_with(begins, stops, lambda b, e: F.struct(b.alias("start_word"), (e + least).alias("end_word")))
        return F.element_at(F.transform(F.array(at), ends), 1)

    return F.element_at(F.transform(F.array(places), merged), 1)


def repeated_spans(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """One row per passage of at least ``least`` words that another document holds too: ``doc_id, start_word,
    end_word`` (words of the text, end excluded), ``first_words`` (stretches of it that no smaller id has).

    Words are compared with A-Z in lower case.  Rows that repeat an id are one document (its passages are the union);
    a missing, empty or short text has none; an empty table gives no rows.  A row without an id is a document of its
    own and its passages have a missing ``doc_id``.
    """
    def keys_only(idents, found):
        return _neighbours(found[1], idents[found[0]])

    matches = written(_in_two_documents(_scan(docs, keys_only, "key long, low long, high long")).select(
        F.col("key").alias("__key")), "suffix-matches")
    # a filter of bounded size over the matched keys; what it lets through wrongly is unique and drops out below
    size = min(SLICE_WORDS, max(1, -(-matches.count() * BITS_PER_ROW // 64)))
    word, mine = F.pmod(F.xxhash64("__key"), F.lit(size)), _signature(F.col("__key"))
    bits = matches.groupBy(word.alias("__word")).agg(F.bit_or(mine).alias("__bits"))

    def with_stretches(idents, found):
        rows, keys, first, stretch, ends = found
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)),
                                         pa.array(stretch.view(np.int64)))
        return pa.RecordBatch.from_arrays(
            [pa.array(idents[rows]), pa.array(keys.view(np.int64)), pa.array(first.astype(np.int32)), lists],
            ["ident", "__key", "first", "stretches"])

    scan = _scan(docs, with_stretches, "ident long, __key long, first int, stretches array<long>")
    extended = (scan.withColumn("__word", word).join(F.broadcast(bits), "__word")
                .where(F.col("__bits").bitwiseAND(mine) == mine)
                .select("ident", "first", F.posexplode("stretches").alias("n", "key"))
                .select("ident", (F.col("first") + F.col("n")).alias("place"), "key"))
    again = written(_in_two_documents(extended.select("key", F.col("ident").alias("low"), F.col("ident").alias("high")))
                    .select("key", "low", "n"), "repeated-stretches")
    total = again.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    mark = F.col("place") * 2 + F.when(F.col("low") < F.col("ident"), 1).otherwise(0)
    marks = (matched(extended, again, "key", "n", total).where("low is not null").groupBy("ident")
             .agg(F.sort_array(F.collect_list(mark)).alias("marks")))
    spans = marks.select("ident", "marks", F.explode(_passages(F.col("marks"), least)).alias("span"))
    inside = F.filter("marks", lambda m: (m % 2 == 0) & F.shiftright(m, 1).between(
        F.col("span.start_word"), F.col("span.end_word") - least))
    doc_id = F.when(F.col("ident") >= -2**61, F.col("ident"))
    return spans.select(doc_id.alias("doc_id"), F.col("span.start_word").alias("start_word"),
                        F.col("span.end_word").alias("end_word"), F.size(inside).alias("first_words"))
