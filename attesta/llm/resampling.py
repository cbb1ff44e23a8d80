"""Importance resampling towards a target: documents drawn by how much likelier the target makes their words.

Features are the words of a text, hashed into buckets by CRC-32.  Checksums of all words of a batch come from one pass
over its bytes: a CRC is linear, so a byte's contribution depends only on its value and its distance from the end of
its word, and is read from a table; the contributions of a word are XORed together, and a constant for its length puts
in what the start value adds.  Words longer than the table are cut into blocks from their end, and the blocks' values
are folded pairwise, each left one first moved on by the length of the right one.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import ranked
from attesta.session import written

BUCKETS = 10_000
LEAST_WORDS, SHARE = 20, 10        # of the documents with so many words, SHARE per cent are drawn
SEED = 2024
REACH = 64                         # distances from the end of a word that the table holds
SLICE = 2**20                      # bytes taken through numpy at a time; a longer text is taken in several windows
POLYNOMIAL = 0xEDB88320            # of CRC-32, reversed (fixed value)


# ---- checksums of many byte spans ------------------------------------------------------------------------------

@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(contribution of each byte at each distance from the end, constant for each length up to ``REACH``)."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1).astype(np.uint32)
    by_distance = [step]
    for _ in range(REACH - 1):
        last = by_distance[-1]
        by_distance.append((last >> np.uint32(8)) ^ step[last & np.uint32(255)])
    lengths = np.array([zlib.crc32(bytes(n)) for n in range(REACH + 1)], dtype=np.uint32)
    return np.concatenate(by_distance), lengths


def _moved(values: np.ndarray, images: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit values, given the images of the 32 single bits."""
    out = np.zeros_like(values)
    for bit in range(32):
        out ^= np.where((values >> np.uint32(bit)) & np.uint32(1), images[bit], np.uint32(0))
    return out


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of ``data[start:end]`` for every span; spans are ascending, apart and not empty."""
    table, constants = tables()
    lengths = ends - starts
    if not len(starts):
        return np.zeros(0, dtype=np.uint32)
    # spans as blocks of at most REACH bytes, counted from their ends
    blocks = -(-lengths // REACH)
    owner = np.repeat(np.arange(len(starts)), blocks)
    first_block = np.cumsum(blocks) - blocks
    after = blocks[owner] - 1 - (np.arange(len(owner)) - first_block[owner])
    block_ends = ends[owner] - after * REACH
    block_starts = np.maximum(block_ends - REACH, starts[owner])
    sizes = block_ends - block_starts
    offsets = np.cumsum(sizes) - sizes
    where = np.arange(int(sizes.sum())) + np.repeat(block_starts - offsets, sizes)
    distance = np.repeat(block_ends - 1, sizes) - where
    values = np.bitwise_xor.reduceat(table[distance * 256 + data[where]], offsets)
    if len(values) == len(starts):
        return values ^ constants[lengths]
    return _folded(values, blocks) ^ _constants(lengths)


def _folded(values: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """The blocks of every span folded into one value, pairs at a time; ``blocks`` is their number for each span."""
    one = np.uint32(1) << np.arange(32, dtype=np.uint32)
    images = _advance(REACH, one)
    while blocks.max() > 1:
        odd = (blocks % 2 == 1) & (blocks > 1)
        values = np.insert(values, (np.cumsum(blocks) - blocks)[odd], np.uint32(0))  # nothing ahead of the first block
        blocks = blocks + odd
        first = np.cumsum(blocks) - blocks
        alone = blocks == 1
        left = np.repeat(first, blocks // 2) + 2 * (np.arange(int((blocks // 2).sum()))
                                                   - np.repeat(np.cumsum(blocks // 2) - blocks // 2, blocks // 2))
        pairs = _moved(values[left], images) ^ values[left + 1]
        halved = np.where(alone, 1, blocks // 2)
        out = np.empty(int(halved.sum()), dtype=np.uint32)
        at = np.cumsum(halved) - halved
        out[at[alone]] = values[first[alone]]
        taken = np.ones(len(out), dtype=bool)
        taken[at[alone]] = False
        out[taken] = pairs
        values, blocks = out, halved
        images = _moved(images, images)
    return values


def _advance(n: int, values: np.ndarray) -> np.ndarray:
    """What values become when ``n`` zero bytes follow."""
    step = tables()[0][:256]
    for _ in range(n):
        values = (values >> np.uint32(8)) ^ step[values & np.uint32(255)]
    return values


def _constants(lengths: np.ndarray) -> np.ndarray:
    """What the start value and the final complement add for each length: the checksum of so many zero bytes."""
    table = tables()[1]
    out = table[np.minimum(lengths, REACH)]
    different = np.unique(lengths[lengths > REACH])
    if len(different):
        long = lengths > REACH
        found = np.full(len(different), 0xFFFFFFFF, dtype=np.uint32)
        images = _advance(1, np.uint32(1) << np.arange(32, dtype=np.uint32))
        for bit in range(int(different.max()).bit_length()):
            on = (different >> bit) & 1 == 1
            found[on] = _moved(found[on], images)
            images = _moved(images, images)
        out[long] = (found ^ np.uint32(0xFFFFFFFF))[np.searchsorted(different, lengths[long])]
    return out


# ---- words of Arrow batches ------------------------------------------------------------------------------------

@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """(each byte with A-Z in lower case, whether it then belongs to a word): digits, a-z and all beyond ASCII."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    word = np.zeros(256, dtype=bool)
    word[48:58] = word[65:91] = word[97:123] = word[128:] = True
    return lower, word


def hashed_words(texts: pa.Array, buckets: int):
    """Yields (bucket of every word, text it belongs to) of a string array, in slices of about ``SLICE`` bytes."""
    wide = texts.cast(pa.large_binary())
    offsets = np.frombuffer(wide.buffers()[1], dtype=np.int64)[wide.offset:wide.offset + len(wide) + 1]
    if not len(wide) or wide.buffers()[2] is None:
        return
    data = np.frombuffer(wide.buffers()[2], dtype=np.uint8)
    lower, is_word = _classes()
    at = int(offsets[0])
    while at < offsets[-1]:
        end = min(at + SLICE, int(offsets[-1]))
        # a window ends where a word does, or a text: at a byte that is no word's, or at an offset
        while end < offsets[-1] and is_word[data[end]] and is_word[data[end - 1]]:
            limit = int(offsets[np.searchsorted(offsets, end, side="left")])
            tail = np.flatnonzero(~is_word[data[end:min(limit, end + SLICE)]])
            end = min(limit, end + SLICE) if not len(tail) else end + int(tail[0])
            if end == limit:
                break
        window = data[at:end]
        member = is_word[window]
        edges = np.zeros(len(window) + 1, dtype=bool)
        edges[(offsets[(offsets >= at) & (offsets <= end)] - at)] = True
        before = np.concatenate(([False], member[:-1]))
        follows = np.concatenate((member[1:], [False]))
        starts = np.flatnonzero(member & (~before | edges[:-1]))
        ends = np.flatnonzero(member & (~follows | edges[1:])) + 1
        owner = np.searchsorted(offsets, starts + at, side="right") - 1
        yield (checksums(lower[window], starts, ends) % np.uint32(buckets)).astype(np.int64), owner
        at = end


def _counted(column: str, buckets: int):
    def work(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for bucket, _ in hashed_words(batch.column(column), buckets):
                total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])
    return work


def _weighed(gains: np.ndarray):
    """``gains``: one 64-bit integer for each bucket."""
    def work(batches):
        for batch in batches:
            weight = np.zeros(batch.num_rows, dtype=np.int64)
            size = np.zeros(batch.num_rows, dtype=np.int64)
            for bucket, owner in hashed_words(batch.column("text"), len(gains)):
                if len(owner):
                    first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                    weight[owner[first]] += np.add.reduceat(gains[bucket], first)
                    size[owner[first]] += np.diff(np.concatenate((first, [len(owner)])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(weight)],
                                             ["doc_id", "n_features", "weight"])
    return work


# ---- the operator ----------------------------------------------------------------------------------------------

def bucket_counts(texts: DataFrame, column: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n`` of all words of a table; a task sends at most one row for each bucket."""
    counts = texts.select(column).mapInArrow(_counted(column, buckets), "bucket int, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """What a word of each bucket adds to a weight: the log ratio of its smoothed share in ``target`` and in ``docs``,
    in thousandths, rounded down.  The result has ``buckets`` numbers whatever the input, so it goes over the driver
    and with the tasks."""
    both = bucket_counts(docs, buckets=buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")) \
        .unionByName(bucket_counts(target, buckets=buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    source, aim = np.zeros(buckets), np.zeros(buckets)
    for row in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():
        source[row.bucket], aim[row.bucket] = row.s, row.t
    ratio = ((aim + 1) * (source.sum() + buckets)) / ((source + 1) * (aim.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths out of the first 32 bits of SHA-256 of ``seed:doc_id``; a missing id counts as ''."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_features, weight`` of every document; texts are read twice and never moved."""
    return docs.select("doc_id", "text").mapInArrow(
        _weighed(gains(docs, target, buckets)),
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS,
              buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every document with ``n_features, weight, score`` and its ``rank`` among the drawn ones (null: not drawn).

    Of the documents with at least ``least_words`` words the ``share`` per cent with the highest score are drawn, ties
    to the smaller ``doc_id`` (a missing one last).  Missing, empty and wordless texts have no features and weight 0.
    Rows that share id and score take ranks next to each other, in no stated order.  Only rows of four numbers are
    moved: a histogram of the scores finds where the draw ends, and what is drawn is ranked by ranges.  An empty
    ``target`` or ``docs`` gives weights all the same, as counts of 0 are smoothed.
    """
    scored = written(weights(docs, target, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
                     .withColumn("__nth", F.monotonically_increasing_id()), "resampling")
    able = scored.where(F.col("n_features") >= least_words)
    most = share * able.count() // 100
    bound = _score_at(able, most)
    inside = (F.col("n_features") >= least_words) & (F.col("score") >= F.lit(bound))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("__nth")]
    first = (ranked(scored.where(inside), order, [])
             .withColumn("rank", F.when(F.col("before_rows") < most, F.col("before_rows") + 1)))
    rest = scored.where(~inside).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return first.select(*columns).unionByName(rest.select(*columns))


def _score_at(able: DataFrame, most: int) -> int:
    """The greatest score such that at least ``most`` rows have it or a higher one, to within a histogram's cell.

    Three histograms of 4096 cells, each inside a cell of the one before: a task sends a row for each cell."""
    ends = able.agg(F.min("score").alias("low"), F.max("score").alias("high")).first()
    if ends.low is None or most == 0:
        return 2**62
    low, high, above = ends.low, ends.high, 0
    for _ in range(3):
        width = max(1, -(-(high - low + 1) // 4096))
        inside = able.where(F.col("score").between(low, high))
        cells = {r.cell: r["count"] for r in inside.groupBy(
            F.expr(f"(score - ({low}L)) div {width}L").alias("cell")).count().collect()}
        for cell in sorted(cells, reverse=True):
            if above + cells[cell] >= most:
                break
            above += cells[cell]
        low, high = low + cell * width, min(high, low + (cell + 1) * width - 1)
        if width == 1:
            break
    return low
