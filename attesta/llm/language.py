"""Language identification by compression: the language whose dictionary leaves a text smallest.

Each learned language has a raw-content dictionary of text windows.  A text is normalised (lower case, runs of anything
but letters as one blank) and compressed, chunk by chunk, once with each dictionary; the sizes add up over all chunks,
so whole texts count and a long text does not become its own dictionary.  A short block that gains nothing is stored as
it is and would hide what matched, so every chunk ends in a run of zero bytes, which makes the encoder code it.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# the sample that a model is fitted on: at most so many windows of so many characters for each of so many languages
WINDOWS, WINDOW_CHARS, LANGUAGES = 1400, 100, 200
DICTIONARY_BYTES = 2**17
CHUNK, PART_CHARS = 2048, 2**20
PADDING = b" " + bytes(64)
NARROW = 0.01          # least relative lead over the runner-up; what has less is rejected
UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept for testing: CRC-32 of its id as text modulo 5 is 0 (so too without an id)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def normalised(text: str) -> bytes:
    return NOT_LETTERS.sub(" ", text.lower()).strip().encode()


# ---- fitting ---------------------------------------------------------------------------------------------------

def sample(docs: DataFrame, windows: int = WINDOWS, languages: int = LANGUAGES) -> DataFrame:
    """``lang, hash, nth, window``: at most ``windows`` windows of different texts for each of the ``languages`` most
    frequent languages.

    How many different texts a language has is estimated first; only texts whose hash is below the share needed (with
    room for the estimate) go on, so neither a frequent language nor a text that repeats moves more than the sample.
    Where a language has few texts, each gives several windows.  The same rows give the same sample.
    """
    text = F.col("text")
    rows = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & text.rlike(r"\p{L}")).select(
        "lang", "text", F.xxhash64("text").alias("hash"))
    sizes = (rows.groupBy("lang").agg(F.approx_count_distinct("hash").alias("n"))
             .orderBy(F.desc("n"), "lang").limit(languages))
    # 2^31 steps of the hash; 1.5: more than the error of the estimate and of the draw
    chosen = (rows.join(F.broadcast(sizes), "lang")
              .where(F.shiftrightunsigned("hash", 33) < F.least(F.lit(1.0), 1.5 * windows / F.col("n")) * 2.0**31))
    each = F.ceil(F.lit(float(windows)) / F.col("n")).cast("int")
    room = F.greatest(F.length("text") - WINDOW_CHARS, F.lit(0)) + 1
    cut = (chosen.dropDuplicates(["lang", "hash"])
           .select("lang", "hash", "text", room.alias("room"), F.explode(F.sequence(F.lit(1), each)).alias("nth"))
           .select("lang", "hash", "nth", F.expr(
               f"substr(text, cast(pmod(xxhash64(hash, nth), room) as int) + 1, {WINDOW_CHARS})").alias("window")))
    order = Window.partitionBy("lang").orderBy("nth", "hash")
    return cut.withColumn("place", F.row_number().over(order)).where(F.col("place") <= windows).drop("place")


def train(docs: DataFrame, windows: int = WINDOWS, languages: int = LANGUAGES) -> dict[str, bytes]:
    """A dictionary for each language, out of the text and ``lang`` of documents that are not held out.

    The result is bounded (``languages`` times ``DICTIONARY_BYTES``), whatever the input; it is put together on the
    driver and goes with the tasks."""
    found: dict[str, list[bytes]] = {}
    for row in sorted(sample(docs, windows, languages).collect(), key=lambda r: (r.lang, r.nth, r.hash)):
        found.setdefault(row.lang, []).append(normalised(row.window))
    return {lang: (b" ".join(parts) + b" ")[:DICTIONARY_BYTES] for lang, parts in found.items()}


# ---- predicting ------------------------------------------------------------------------------------------------

def encoders(dictionaries: dict[str, bytes]) -> dict[str, zstandard.ZstdCompressor]:
    """Compressors that find matches of three bytes and write nothing but the blocks."""
    parameters = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, strategy=zstandard.STRATEGY_GREEDY, min_match=3, search_log=3,
        hash_log=16, chain_log=16, window_log=18, write_content_size=False, write_checksum=False, write_dict_id=False)
    made = {}
    for lang, content in sorted(dictionaries.items()):
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=parameters)
        made[lang] = zstandard.ZstdCompressor(dict_data=dictionary, compression_params=parameters)
    return made


def sizes(text: str, made: dict[str, zstandard.ZstdCompressor]) -> dict[str, int]:
    """Bytes that a whole text takes with each dictionary."""
    total = dict.fromkeys(made, 0)
    for at in range(0, len(text), PART_CHARS):
        part = normalised(text[at:at + PART_CHARS])
        for start in range(0, len(part), CHUNK):
            chunk = b" " + part[start:start + CHUNK] + PADDING
            for lang, encoder in made.items():
                total[lang] += len(encoder.compress(chunk))
    return total


def _identified(dictionaries: dict[str, bytes]):
    def work(batches):
        made = encoders(dictionaries)
        for batch in batches:
            best, second, lead = [], [], []
            for text, letters in zip(batch.column("text"), batch.column("letters")):
                found = sizes(text.as_py(), made) if letters.as_py() else {}
                order = sorted(found, key=lambda lang: (found[lang], lang))
                best.append(order[0] if order else None)
                second.append(order[1] if len(order) > 1 else None)
                lead.append(1 - found[order[0]] / found[order[1]] if len(order) > 1 else float(len(order)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(best, pa.string()), pa.array(second, pa.string()),
                 pa.array(lead, pa.float64())], ["doc_id", "best", "second", "lead"])
    return work


def identified(docs: DataFrame, dictionaries: dict[str, bytes], narrow: float = NARROW) -> DataFrame:
    """``doc_id, best, second, lead, lang``: the two nearest languages, by how much of the runner-up's size the best one
    is smaller, and the verdict: ``und`` where the lead is under ``narrow``.

    A text that is missing or has no letter, and any text where nothing was learned, has no best language, a lead of 0
    and ``und``; with one learned language the lead is 1.  Equal sizes go to the smaller name.  Texts are read once and
    not moved.  Nothing but the text counts.
    """
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) if dictionaries else F.lit(False)
    found = docs.select("doc_id", "text", letters.alias("letters")).mapInArrow(
        _identified(dictionaries),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, best string, second string, lead double")
    sure = F.col("best").isNotNull() & (F.col("lead") >= narrow)
    return found.withColumn("lang", F.when(sure, F.col("best")).otherwise(UNKNOWN))


def predicted(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every document, with a model of those not held out.

    ``lang_pred`` is the nearest language even where the lead is narrow (``rejected`` says so); ``und`` only stands for
    texts without letters.  ``score`` is the lead."""
    found = identified(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"),
                        F.coalesce("best", F.lit(UNKNOWN)).alias("lang_pred"), F.col("lead").alias("score"),
                        (F.col("lang") == UNKNOWN).alias("rejected"))
