"""SentencePiece encoding and decoding: best segmentation by a max-plus parallel scan.

A text is cut into pieces of the vocabulary so that the sum of their scores is largest (the Viterbi segmentation over
the model's pieces and scores, found exactly on integers; of equal sums the one with the longest last piece).  As in
the library, a space is put before a text, blanks are part of pieces, and a character without a piece becomes its UTF-8
bytes.  No piece holds a blank after another character, so every path cuts before a blank that follows one; between
such cuts each distinct stretch is solved once per worker.

A text longer than ``CHUNK`` characters is split into chunks of that size, wherever they fall.  A state at a chunk
boundary is the number of characters between the last cut and the boundary.  Each chunk yields the matrix of best sums
from entry state to exit state; matrices are combined associatively (max-plus products, ``FAN`` at a time, level by
level), the states at all boundaries follow from the top down, and every chunk is then backtraced on its own.  A
document is one row, so its chunks are read where the document is; only states and matrices are exchanged.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import partitions, runs, slices
from attesta.session import written

CHUNK = 16384
FAN = 256
CACHE = 150_000
NEVER = -(2**60)
# scores below this (the model's marks for pieces and characters to avoid) are raised to it: a piece of up to 16
# characters still loses to any cover by ordinary pieces, and sums of long texts stay within 64 bits
FLOOR = -1_000_000
_RUN = re.compile(r" +[^ ]*")
KEY_BASE = 0x5851F42D4C957F2D
TABLE_BITS = 18


SPREADS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _slot(keys: np.ndarray, spread: int) -> np.ndarray:
    return ((keys * np.uint64(spread)) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


class Pieces:
    """Vocabulary of one worker, with blanks as plain spaces."""

    _loaded: dict[str, Pieces] = {}

    def __init__(self, file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        self.score: dict[str, int] = {}
        self.id: dict[str, int] = {}
        self.byte = [0] * 256
        self.bytes_of: list[bytes] = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte[value] = i
                self.bytes_of.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b"")
            else:
                plain = piece.replace("▁", " ")
                self.score[plain] = max(int(model.get_score(i)), FLOOR)
                self.id[plain] = i
                self.bytes_of.append(plain.encode())
        if any(" " in p.lstrip(" ") for p in self.score):
            raise ValueError("a piece holds a blank after another character")
        self.longest = max(map(len, self.score))
        self.tree: dict = {}
        for piece, value in self.score.items():
            node = self.tree
            for character in piece:
                node = node.setdefault(character, {})
            node[""] = value
        self.known: dict[str, bytes] = {}
        self.fresh: dict[str, bytes] = {}
        self.piece_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.piece_sizes = np.array([len(b) for b in self.bytes_of], np.int64)
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes
        self._table()

    @classmethod
    def of(cls, file: str) -> Pieces:
        if file not in cls._loaded:
            cls._loaded[file] = cls(file)
        return cls._loaded[file]

    def sweep(self, text: str, start: int, stop: int, beyond: int) -> tuple[list[int], list[int]]:
        """Best sums of paths from a cut at ``start`` to every place up to ``stop``, and where the last piece began;
        both by distance from ``start``.  The first piece must end after ``beyond``."""
        size = stop - start
        best, came = [NEVER] * (size + 1), [-1] * (size + 1)
        best[0] = 0
        least = beyond - start
        for at in range(size):
            so_far = best[at]
            if so_far == NEVER:
                continue
            node, end = self.tree, at
            for character in text[start + at:min(start + at + self.longest, stop)]:
                node = node.get(character)
                if node is None:
                    break
                end += 1
                gain = node.get("")
                if gain is not None and so_far + gain > best[end] and (at or end > least):
                    best[end], came[end] = so_far + gain, at
            if text[start + at] not in self.score and so_far + FLOOR - 10 > best[at + 1] and (at or at + 1 > least):
                best[at + 1], came[at + 1] = so_far + FLOOR - 10, at
        return best, came

    def trace(self, text: str, came: list[int], start: int, stop: int) -> bytes:
        """Ids of the best path's pieces; ``came`` comes from a sweep that began at ``start``."""
        found, at = [], stop - start
        while at > 0:
            begin = came[at]
            piece = text[start + begin:start + at]
            i = self.id.get(piece)
            if i is None:
                found += [self.byte[b] for b in reversed(piece.encode())]
            else:
                found.append(i)
            at = begin
        found.reverse()
        return struct.pack(f"<{len(found)}i", *found)

    def solve(self, stretch: str) -> bytes:
        """Ids of a stretch that begins and ends at certain cuts."""
        _, came = self.sweep(stretch, 0, len(stretch), 0)
        return self.trace(stretch, came, 0, len(stretch))

    def _table(self):
        """Open table of the vocabulary for whole arrays: polynomial keys, and the row of scores and ids."""
        pieces = list(self.id)
        keys = np.array([self._key(p) for p in pieces], np.uint64)
        # what finds its slot taken goes to the next table, by another spread
        tables, left = [], np.arange(len(pieces))
        for spread in SPREADS:
            slots = np.full(2**TABLE_BITS, -1, np.int64)
            at = _slot(keys[left], spread)
            slots[at[::-1]] = left[::-1]
            tables.append((spread, slots))
            left = left[slots[at] != left]
        if len(left):
            raise ValueError("the vocabulary is too large for its tables")
        scores = np.array([self.score[p] for p in pieces] + [NEVER], np.int64)
        ids = np.array([self.id[p] for p in pieces] + [0], np.int32)
        self.table = keys, tables, scores, ids

    @staticmethod
    def _key(piece: str) -> int:
        key = 0
        for character in piece:
            key = (key * KEY_BASE + ord(character) + 1) % 2**64
        return key

    def _rows(self, keys: np.ndarray) -> np.ndarray:
        """Vocabulary row of every key, -1 where there is none."""
        known, tables, _, _ = self.table
        rows = np.full(keys.shape, -1, np.int64)
        for spread, slots in tables:
            row = slots[_slot(keys, spread)]
            np.copyto(rows, row, where=(row >= 0) & (known[row] == keys))
        return rows

    def solve_many(self, stretches: list[str]) -> dict[str, bytes]:
        """``solve`` for many stretches: those of one length are swept together, place by place."""
        out: dict[str, bytes] = {}
        by_length: dict[int, list[str]] = {}
        for x in stretches:
            by_length.setdefault(len(x), []).append(x)
        for size, group in by_length.items():
            if size > 40 or len(group) < 2 * min(size, self.longest):
                out.update((x, self.solve(x)) for x in group)
                continue
            codes = np.frombuffer("".join(group).encode("utf-32-le"), np.uint32).reshape(-1, size).astype(np.uint64)
            codes += np.uint64(1)
            rows, keys = [], np.zeros_like(codes)
            for length in range(1, min(size, self.longest) + 1):
                keys = keys[:, :size - length + 1] * np.uint64(KEY_BASE) + codes[:, length - 1:]
                rows.append(self._rows(keys))
            scores, ids = self.table[2], self.table[3]
            best = np.full((len(group), size + 1), NEVER, np.int64)
            came = np.zeros((len(group), size + 1), np.int64)
            best[:, 0] = 0
            for end in range(1, size + 1):
                for length in range(min(end, self.longest), 0, -1):
                    total = best[:, end - length] + scores[rows[length - 1][:, end - length]]
                    better = total > best[:, end]
                    best[better, end] = total[better]
                    came[better, end] = length
            complete = (rows[0] >= 0).all(1)
            place, every = np.full(len(group), size), np.arange(len(group))
            found = np.zeros((len(group), size), np.int32)
            used = np.zeros(len(group), np.int64)
            while (place * complete).any():
                on = complete & (place > 0)
                who, end = every[on], place[on]
                length = came[who, end]
                begin = end - length
                row = np.zeros(len(who), np.int64)
                for n in np.unique(length):
                    of = length == n
                    row[of] = rows[n - 1][who[of], begin[of]]
                used[who] += 1
                found[who, size - used[who]] = ids[row]
                place[who] = begin
            for x, sure, ids_of, n in zip(group, complete.tolist(), found, used.tolist()):
                out[x] = ids_of[size - n:].tobytes() if sure else self.solve(x)
        return out

    def learn(self, stretches: set[str]) -> None:
        """Solve what is not known yet; the first ``CACHE`` stretches stay known, others until the next call."""
        self.fresh = self.solve_many(list(stretches.difference(self.known)))
        if len(self.known) < CACHE:
            self.known.update(list(self.fresh.items())[:CACHE - len(self.known)])

    def of_stretch(self, stretch: str) -> bytes:
        return self.known.get(stretch) or self.fresh.get(stretch) or self.solve(stretch)

    def encode_all(self, texts: list[str | None]) -> list[bytes | None]:
        """Ids of whole texts as little-endian 32-bit integers."""
        cut = [_RUN.findall(" " + t) if t else [] for t in texts]
        self.learn(set().union(*cut))
        known, fresh = self.known, self.fresh
        return [None if t is None else b"".join([known[x] if x in known else fresh[x] for x in runs_of])
                for t, runs_of in zip(texts, cut)]

    def decode(self, ids) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in ids])[1:].decode()

    def decode_many(self, blobs: list[bytes]) -> list[bytes]:
        """Bytes that each array of ids stands for, with the blank before the text; whole arrays at a time."""
        ids = np.frombuffer(b"".join(blobs), "<i4")
        parts, sizes_of = [], self.piece_sizes[ids]
        for at in range(0, len(ids), 2**18):
            sizes = sizes_of[at:at + 2**18]
            ends = np.cumsum(sizes)
            shift = self.piece_starts[ids[at:at + 2**18]] - (ends - sizes)
            parts.append(self.piece_bytes[np.repeat(shift, sizes) + np.arange(ends[-1])].tobytes())
        data = b"".join(parts)
        bounds = np.concatenate(([0], np.cumsum(sizes_of)))[np.cumsum([0, *[len(b) // 4 for b in blobs]])].tolist()
        return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    # chunks: ``full`` is the chunk with up to ``longest - 1`` characters before it, ``off`` of them

    def _certain(self, full: str, off: int) -> list[int]:
        """First and last certain cut inside a chunk."""
        cuts = [m.start() for m in _RUN.finditer(full)
                if m.start() >= off and (m.start() > 0 or off == 0) and (m.start() == 0 or full[m.start() - 1] != " ")]
        return [cuts[0], cuts[-1]] if cuts else []

    def matrix(self, full: str, off: int) -> np.ndarray:
        """Best sums from every entry state to every exit state.  What lies between the first and the last certain
        cut adds the same to all of them and is left out."""
        size, end = self.longest, len(full)
        out = np.full((size, size), NEVER, np.int64)
        cuts = self._certain(full, off)
        entries = range(min(size - 1, off) + 1)
        if not cuts:
            for s in entries:
                best, _ = self.sweep(full, off - s, end, off if s else off - s)
                for t in range(min(size - 1, end - off + s) + 1):
                    place = end - t
                    if place > off or place == off - s:
                        out[s, t] = best[place - off + s]
            return out
        first, last = cuts
        head = [NEVER] * size
        for s in entries:
            if first > off or s == 0:
                head[s] = self.sweep(full, off - s, first, off if s else off - s)[0][-1]
        tail, _ = self.sweep(full, last, end, last)
        for t in range(min(size - 1, end - last) + 1):
            for s in entries:
                if head[s] > NEVER and tail[end - t - last] > NEVER:
                    out[s, t] = head[s] + tail[end - t - last]
        return out

    def chunk_ids(self, full: str, off: int, entry: int, leave: int) -> bytes:
        """Ids of the pieces that end inside a chunk, for known boundary states."""
        start, stop = off - entry, len(full) - leave
        cuts = self._certain(full, off)
        if not cuts:
            _, came = self.sweep(full, start, stop, off if entry else start)
            return self.trace(full, came, start, stop)
        first, last = cuts
        _, came = self.sweep(full, start, first, off if entry else start)
        head = self.trace(full, came, start, first)
        middle = [self.of_stretch(x) for x in _RUN.findall(full, first, last)]
        _, came = self.sweep(full, last, stop, last)
        return b"".join([head, *middle, self.trace(full, came, last, stop)])


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two transfer matrices: best way through both, over the state between them."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(1), NEVER)


def boundary_states(matrices: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """States between consecutive matrices on a best path from ``entry`` to ``leave``, ends included."""
    vector = np.full(len(matrices[0]), NEVER, np.int64)
    vector[entry] = 0
    vectors = [vector]
    for m in matrices:
        vectors.append(np.maximum((vectors[-1][:, None] + m).max(0), NEVER))
    states = [leave]
    for v, m in zip(reversed(vectors[:-1]), reversed(matrices)):
        states.append(int(np.argmax(v + m[:, states[-1]])))
    return states[::-1]


def _matrix(blob: bytes) -> np.ndarray:
    values = np.frombuffer(blob, np.int64)
    side = int(len(values) ** 0.5)
    return values.reshape(side, side)


def _chunks(text: str, chunk: int, behind: int):
    """Each chunk with the characters before it that a piece can reach back to, and how many those are."""
    text = " " + text
    for at in range(0, len(text), chunk):
        off = min(behind, at)
        yield text[at - off:at + chunk], off


def _scan(matrices: DataFrame) -> DataFrame:
    """``row, idx, entry, leave``: the boundary states of every chunk, by levels of ``FAN`` matrices."""
    parts = partitions(matrices.sparkSession)

    def combine(batches):
        for (row, block), group in runs(batches, ["row", "block"], ["m"]):
            product = _matrix(group[0][0])
            for (blob,) in group[1:]:
                product = max_plus(product, _matrix(blob))
            yield pa.RecordBatch.from_arrays([pa.array([row]), pa.array([block]), pa.array([product.tobytes()])],
                                             ["row", "idx", "m"])

    def resolve(batches):
        for (row, _), group in runs(batches, ["row", "block"], ["idx", "m", "entry", "leave"]):
            states = boundary_states([_matrix(g[1]) for g in group], group[0][2], group[0][3])
            yield pa.RecordBatch.from_arrays(
                [pa.array([row] * len(group)), pa.array([g[0] for g in group]), pa.array(states[:-1]),
                 pa.array(states[1:])], ["row", "idx", "entry", "leave"])

    def grouped(df):
        return df.repartition(parts, "row", "block").sortWithinPartitions("row", "block", "idx")

    block = F.expr(f"idx div {FAN}")
    levels = [matrices]
    while (levels[-1].agg(F.max("idx")).first()[0] or 0) > 0:
        products = grouped(levels[-1].withColumn("block", block)).mapInArrow(combine, "row long, idx long, m binary")
        levels.append(written(products, "piece-products"))
    zero = F.lit(0).cast("long")
    states = levels[-1].select("row", "idx", zero.alias("entry"), zero.alias("leave"))
    for level in reversed(levels[:-1]):
        inner = level.withColumn("block", block).join(states.withColumnRenamed("idx", "block"), ["row", "block"])
        states = grouped(inner).mapInArrow(resolve, "row long, idx long, entry long, leave long")
    return states


def encode(docs: DataFrame, file: str, chunk: int = CHUNK, check: bool = False) -> DataFrame:
    """``docs`` plus ``ids`` (array<int>); with ``check`` also ``round_trip``, whether the ids decode to exactly the
    text (compared where they are made), and without the text.  A missing text has missing ids, an empty one none.  Rows are encoded each
    on its own, whatever their ids; an empty table gives no rows."""
    columns = [c for c in docs.columns if c != "ids"]
    docs = docs.select(*columns)
    is_long = F.coalesce(F.length("text") > chunk, F.lit(False))

    given = [c for c in columns if c != "text"] if check else columns

    def finished(batch, texts, found, model):
        extra = [_int_lists(found)]
        if check:
            back = model.decode_many([i or b"" for i in found])
            extra.append(pa.array([(t is None) if i is None else b == (" " + t).encode() if t else not b
                                   for i, b, t in zip(found, back, texts)], pa.bool_()))
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in given], *extra],
                                          [*given, "ids", *(["round_trip"] if check else [])])

    def short(batches):
        pieces = Pieces.of(file)
        for batch in slices(batches, most=2**20, rows=256):
            texts = batch.column("text").to_pylist()
            yield finished(batch, texts, pieces.encode_all(texts), pieces)

    result = docs.select(*given).withColumn("ids", F.lit(None).cast("array<int>"))
    schema = (result.withColumn("round_trip", F.lit(None).cast("boolean")) if check else result).schema
    plain = docs.where(~is_long).mapInArrow(short, schema)

    # stored with row numbers of its own: ids of documents may be missing or repeated
    long_texts = written(docs.where(is_long).withColumn("__row", F.monotonically_increasing_id()), "long-texts")

    def transfer(batches):
        model = Pieces.of(file)
        for batch in slices(batches):
            for row, text in zip(batch.column("__row").to_pylist(), batch.column("text").to_pylist()):
                blobs = [model.matrix(*c).tobytes() for c in _chunks(text, chunk, model.longest - 1)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(blobs)), pa.array(range(len(blobs)), pa.int64()),
                     pa.array(blobs, pa.binary())], ["row", "idx", "m"])

    def back(batches):
        model = Pieces.of(file)
        for batch in slices(batches, most=2**20, rows=256):
            found, texts = [], batch.column("text").to_pylist()
            model.learn(set().union(*[_RUN.findall(" " + t) for t in texts]))
            for text, states in zip(texts, batch.column("__states").to_pylist()):
                cut = _chunks(text, chunk, model.longest - 1)
                found.append(b"".join([model.chunk_ids(*c, s["entry"], s["leave"]) for c, s in zip(cut, states)]))
            yield finished(batch, texts, found, model)

    matrices = written(long_texts.select("__row", "text").mapInArrow(transfer, "row long, idx long, m binary"),
                       "piece-matrices")
    # two small numbers per chunk of the document
    states = _scan(matrices).groupBy(F.col("row").alias("__row")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "entry", "leave"))).alias("__states"))
    return plain.unionByName(long_texts.join(states, "__row").mapInArrow(back, schema))


def _int_lists(blobs: list[bytes | None]) -> pa.Array:
    sizes = [0 if b is None else len(b) // 4 for b in blobs]
    ends = np.cumsum([0, *sizes]).astype(np.int32)
    values = np.frombuffer(b"".join(b or b"" for b in blobs), "<i4")
    missing = pa.array([b is None for b in blobs], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()), mask=missing)


def decode(encoded: DataFrame, file: str, into: str = "decoded") -> DataFrame:
    """``encoded`` plus the texts that ``ids`` stand for; missing ids give a missing text."""
    schema = encoded.withColumn(into, F.lit(None).cast("string")).schema

    def run(batches):
        pieces = Pieces.of(file)
        for batch in slices(batches, "ids"):
            texts = [None if ids is None else pieces.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             [*batch.schema.names, into])

    return encoded.mapInArrow(run, schema)


def encoded_and_checked(docs: DataFrame, file: str, chunk: int = CHUNK) -> DataFrame:
    """Per document its ids and whether they decode to exactly its text."""
    checked = encode(docs.select("doc_id", "text"), file, chunk, check=True)
    return checked.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids",
                          "round_trip")
