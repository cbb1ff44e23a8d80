"""Exact dedup by two-pass Bloom filtering: only rows whose hash may be repeated are shuffled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import ascii_lower, matched
from attesta.session import scratch_path, written

BITS_PER_ROW = 16
# one slice of the filter: 2^20 words of 64 bits; a slice's broadcast never has more rows than that
SLICE_WORDS = 2**20


def text_key(text: Column) -> Column:
    """SHA-256 (lower-case hex) of the text with A-Z in lower case; a missing text counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def _signature(key: Column) -> Column:
    """Three of 64 bits, from a hash other than the one that picks the word."""
    h = F.xxhash64(F.lit(7), key)
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"),
                            F.shiftrightunsigned(h, s).bitwiseAND(F.lit(63)).cast("int")) for s in (0, 20, 40)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def repeated_bits(keys: DataFrame, words: int) -> DataFrame:
    """The second filter: per 64-bit word the bits that at least two rows set in the first one.

    A word gets about four rows.  Rows with the same signature are counted in the tasks before the shuffle, so a hash
    that a third of all rows share is one row per task; a word never collects more than its distinct signatures.
    """
    word = F.pmod(F.xxhash64("__key"), F.lit(words))
    marks = keys.select(word.alias("__word"), _signature(F.col("__key")).alias("__bits"))
    counted = marks.groupBy("__word", "__bits").agg(F.count("*").alias("n"))
    per_word = counted.groupBy("__word").agg(F.collect_list(F.struct("__bits", "n")).alias("marks"))
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("once"), zero.alias("twice"))

    def add(state, mark):
        again = state["once"].bitwiseAND(mark["__bits"])
        alone = F.when(mark["n"] > 1, mark["__bits"]).otherwise(zero)
        return F.struct(state["once"].bitwiseOR(mark["__bits"]).alias("once"),
                        state["twice"].bitwiseOR(again).bitwiseOR(alone).alias("twice"))

    twice = F.aggregate("marks", start, add, lambda state: state["twice"])
    return per_word.select("__word", twice.alias("__twice")).where("__twice != 0")


def _slice(words: int) -> Column:
    return F.expr(f"pmod(xxhash64(__key), {words}L) div {SLICE_WORDS}").cast("int")


def sliced_keys(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """The narrow table (``doc_id``, ``__key``), stored by hash slice; number of filter words; number of rows."""
    keys = written(docs.select("doc_id", text_key(F.col("text")).alias("__key")), "text-keys")
    total = keys.count()
    words = max(1, -(-total * BITS_PER_ROW // 64))
    if words <= SLICE_WORDS:
        return keys.withColumn("__slice", F.lit(0)), words, total
    path = scratch_path(docs.sparkSession, "text-key-slices")
    keys.withColumn("__slice", _slice(words)).write.partitionBy("__slice").parquet(path)
    return docs.sparkSession.read.parquet(path), words, total


def flagged_keys(keys: DataFrame, words: int) -> DataFrame:
    """``keys`` plus ``__maybe``: false only for keys that no other row has.

    Pass one stores the filter, pass two tests every row against its word.  The filter is taken slice by slice, each
    against the stored rows of that slice alone, so a broadcast never exceeds ``SLICE_WORDS`` rows of 16 bytes.
    """
    bits = written(repeated_bits(keys, words).withColumn("__slice", F.expr(f"__word div {SLICE_WORDS}").cast("int")),
                   "bloom")
    mine = _signature(F.col("__key"))
    hit = F.coalesce(F.col("__twice").bitwiseAND(mine) == mine, F.lit(False))
    tested = []
    for n in range(-(-words // SLICE_WORDS)):
        filter_words = bits.where(F.col("__slice") == n).select("__word", "__twice")
        rows = keys.where(F.col("__slice") == n).withColumn("__word", F.pmod(F.xxhash64("__key"), F.lit(words)))
        tested.append(rows.join(F.broadcast(filter_words), "__word", "left")
                      .select("doc_id", "__key", hit.alias("__maybe")))
    return reduce(DataFrame.unionByName, tested)


def _groups(flagged: DataFrame) -> DataFrame:
    """Keys that at least two rows have, with the row that stays; counted in the tasks before the shuffle."""
    return written(flagged.where("__maybe").groupBy("__key")
                   .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
                   .where("group_size > 1"), "copies")


def _kept() -> Column:
    same = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False))
    return F.col("group_size").isNull() | F.col("keep_id").isNull() | same


def copies(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are read once and never moved; of the narrow rows only those with a possibly repeated hash are counted and
    joined, the rest pass straight through as groups of one.  The row with the largest ``doc_id`` stays.  Rows that
    repeat both ``doc_id`` and text are all marked kept (``distinct_texts`` leaves one); where no row of a group has
    a ``doc_id`` all count as kept with ``keep_id`` missing.  An empty table gives no rows.
    """
    keys, words, total = sliced_keys(docs)
    flagged = flagged_keys(keys, words)
    groups = _groups(flagged)
    one = F.lit(1).cast("long")
    single = flagged.where("not __maybe").withColumns({"keep_id": F.col("doc_id"), "group_size": one})
    suspects = matched(flagged.where("__maybe"), groups, "__key", "group_size", total)
    suspects = suspects.withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id"))
                                   .otherwise(F.col("keep_id")))
    rows = single.unionByName(suspects).withColumn("kept", _kept())
    return rows.select("doc_id", "keep_id", F.coalesce("group_size", one).alias("group_size"), "kept",
                       F.col("__key").alias("text_sha256"))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns: of equal texts the row with the largest ``doc_id``.

    Groups are found on the narrow table as in ``copies``.  A filter of the repeated hashes (at most ``SLICE_WORDS``
    words) then lets every other document pass in one scan of the texts; only documents that hit it are moved.  Rows
    equal in text and ``doc_id`` leave one.
    """
    keys, words, total = sliced_keys(docs)
    groups = _groups(flagged_keys(keys, words))
    size = min(SLICE_WORDS, max(1, -(-groups.count() * BITS_PER_ROW // 64)))
    word = F.pmod(F.xxhash64("__key"), F.lit(size))
    mine = _signature(F.col("__key"))
    bits = groups.groupBy(word.alias("__word")).agg(F.bit_or(mine).alias("__bits"))
    found = groups.select("__key", F.col("keep_id").alias("__keep"), F.col("group_size").alias("__size"))
    keyed = docs.withColumn("__key", text_key(F.col("text"))).withColumn("__word", word)
    tested = keyed.join(F.broadcast(bits), "__word", "left").withColumn(
        "__maybe", F.coalesce(F.col("__bits").bitwiseAND(mine) == mine, F.lit(False))).drop("__word", "__bits")
    suspects = matched(tested.where("__maybe"), found, "__key", "__size", total)
    stays = suspects.where("__size is null or __keep is null or doc_id = __keep")
    alone = stays.where("__size is null")
    one = stays.where("__size is not null").dropDuplicates(["__key"])
    return (tested.where("not __maybe").select(*docs.columns)
            .unionByName(alone.select(*docs.columns)).unionByName(one.select(*docs.columns)))
