"""Token ids as binary files: one compressed frame per document, a shared zstandard dictionary, an offset index.

A store is a folder with two Parquet tables.  ``dictionary`` holds one row: the dictionary and its hash.  ``segments``
holds the documents in ascending ``doc_id`` order, about a megabyte of frames to a row: ``payload`` is the frames one
after the other, ``doc_ids``, ``n_tokens`` and ``offsets`` (one more entry than documents) are the index, and
``dict_hash`` names the dictionary without which the frames cannot be read.  A frame is the ids of one document as
little-endian unsigned 32-bit integers, end id included, compressed on its own, so one short document is read without
its neighbours.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.common import halving, ranked, slices
from attesta.llm.sharding import split_points
from attesta.session import scratch_path, written

END_ID = 0
PART_BYTES = 4 * 2**20        # text of one sorted run
SEGMENT_BYTES = 2**20         # payload of one row
SAMPLE_DOCS = 2000            # documents the dictionary is trained on, at most ...
SAMPLE_BYTES = 8192           # ... and bytes of ids of each
DICTIONARY_BYTES = 32768
LEVEL = 1
CACHE = 500_000               # words a worker remembers
CALL = 256                    # words merged in one call of the model
SPACE = "\u0120"              # a space in the alphabet of a byte-level vocabulary

# in byte-level BPE a space followed by a non-space always starts a new piece, so the stretches between such spaces
# are encoded on their own, each distinct one once
_LOOSE_SPACE = re.compile(r" (?!\S)")
_GAP = re.compile(r" (?=\S)")

# letters with or without marks after them are two pieces whatever follows
_MARKS = ".,;:!?"
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]{0,8})")
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")

SEGMENTS = ("part int, segment int, first_doc_id long, last_doc_id long, doc_ids array<long>, n_tokens array<long>, "
            "offsets array<long>, tokens long, dict_hash string, payload binary")


def _stretches(text: str) -> list[str]:
    """The text cut before the spaces that start a piece, without those spaces.

    Where spaces and line breaks are the only blanks and none stands beside another, a line break is a piece of its own;
    there a stretch also begins at each."""
    if (text.replace("\n", "").isprintable() and not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text)
            and not text.endswith((" ", "\n")) and not text.startswith("\n")):
        return text.replace("\n", " \n").split(" ")
    return _GAP.split(text) if _LOOSE_SPACE.search(text) else text.split(" ")


def _byte_alphabet() -> dict[str, str]:
    """The character that stands for each byte in a byte-level vocabulary (a fixed rule of such vocabularies):
    printable Latin-1 characters stand for themselves, the others follow from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): chr(b) for b in printable} | {chr(b): chr(0x100 + i) for i, b in enumerate(others)}


def _space_stays_apart(file: str) -> tuple[bool, np.ndarray]:
    """Whether no merge joins the end of a letter (ASCII, or two bytes from 0xC3 on) with a space after it, and of every id
    whether it begins with a space."""
    with open(file, encoding="utf-8") as text:
        model = json.load(text)["model"]
    starts = np.zeros(max(model["vocab"].values()) + 1, bool)
    starts[[i for t, i in model["vocab"].items() if t.startswith(SPACE)]] = True
    if any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
        return False, starts
    real = {c: ord(b) for b, c in _byte_alphabet().items()}
    for merge in model["merges"]:
        left, right = merge.split(" ") if isinstance(merge, str) else merge
        if right.startswith(SPACE):
            end = [real[c] for c in left[-2:]]
            if chr(end[-1]).isalpha() and end[-1] < 128 or 128 <= end[-1] < 192 and (len(end) == 1 or end[0] == 0xC3):
                return False, starts
    return True, starts


class ByteBpe:
    """The tokenizer of one worker, with a bounded memory of encoded words."""

    _loaded: dict[str, ByteBpe] = {}

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        # strings that the file turns into one id wherever they stand in a text
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}
        self.alphabet = str.maketrans(_byte_alphabet())
        self.apart, self.starts = _space_stays_apart(file)

    @classmethod
    def of(cls, file: str) -> ByteBpe:
        if file not in cls._loaded:
            cls._loaded[file] = cls(file)
        return cls._loaded[file]

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _mapped(self, letters: str) -> str:
        """Letters in the alphabet of the vocabulary (ASCII ones stand for themselves)."""
        return letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.alphabet)

    def _pieces(self, words: list[str]) -> list[bytes]:
        """Ids of each of ``words``, letters in the alphabet of the vocabulary, with a space before it.

        A word is one piece of the pre-tokenizer, so only the merges are left.  Where no merge of the vocabulary joins a
        letter with a space after it, many words are merged in one call and cut before each space."""
        if not self.apart:
            return [self._letters(SPACE + w) for w in words]
        out = []
        for at in range(0, len(words), CALL):
            some = words[at:at + CALL]
            ids = np.array([t.id for t in self.tokenizer.model.tokenize(SPACE + SPACE.join(some))], "<u4")
            cuts = (np.flatnonzero(self.starts[ids]) * 4).tolist()
            joined = ids.tobytes()
            out += map(joined.__getitem__, map(slice, cuts, [*cuts[1:], len(joined)]))
        return out

    def _letters(self, mapped: str) -> bytes:
        """Ids of one piece."""
        ids = [t.id for t in self.tokenizer.model.tokenize(mapped)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, with a space before it; plain ones together."""
        cores = self.cores
        own = [word.rstrip(_MARKS) for word in words]
        fresh = [letters for letters in set(own).difference(cores) if _LATIN.fullmatch(letters)]
        cores.update(zip(fresh, self._pieces([self._mapped(letters) for letters in fresh])))
        out = []
        for word, letters in zip(words, own):
            ids, marks = cores.get(letters), word[len(letters):]
            if ids is None or len(marks) > 8:
                ids = self._word(word)
            elif marks:
                ids += self._mark(marks)
            out.append(ids)
        for letters in fresh[max(0, CACHE // 2 - len(cores) + len(fresh)):]:
            del cores[letters]
        return out

    def _word(self, word: str, before: str = " ") -> bytes:
        """Ids of a word with ``before`` (a space or nothing) before it; a line break that begins it stands for the space."""
        if word.startswith("\n") and before:
            return self._mark("\n") + self._word(word[1:], "")
        plain = _PLAIN.fullmatch(word)
        if not plain:
            return self._ids(before + word)
        mapped = (SPACE if before else "") + self._mapped(plain[1])
        return self._letters(mapped) + (self._mark(plain[2]) if plain[2] else b"")

    def _mark(self, marks: str) -> bytes:
        found = self.marks.get(marks)
        if found is None:
            found = self.marks[marks] = self._ids(marks)
        return found

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, without an end id.

        The first words a worker meets are remembered, up to ``CACHE``; others are encoded once for these texts.  A text
        that holds an added token's string goes through the library as a whole.
        """
        special = {n: self._ids(t) for n, t in enumerate(texts) if any(a in t for a in self.added)}
        if special:
            rest = iter(self.encode_all([t for n, t in enumerate(texts) if n not in special]))
            return [special[n] if n in special else next(rest) for n in range(len(texts))]
        cut = [_stretches(t) for t in texts]
        heads = [self._word(words.pop(0), "") for words in cut]
        known = self.known
        fresh = list(set().union(*cut).difference(known))
        known.update(zip(fresh, self._words(fresh)))
        out = [head + b"".join(map(known.__getitem__, words)) for head, words in zip(heads, cut)]
        room = max(0, CACHE - len(known) + len(fresh))
        for w in fresh[room:]:
            del known[w]
        for w in fresh[:room]:
            if len(w) > 64:
                del known[w]
        return out


def _dictionary(samples: list[bytes]) -> bytes:
    """A dictionary out of serialized id arrays; none if they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def dictionary_hash(dictionary: bytes) -> str:
    return hashlib.sha256(dictionary).hexdigest()


def _as_dict(dictionary: bytes):
    """The dictionary, digested once instead of for every document."""
    if not dictionary:
        return None
    shared = zstandard.ZstdCompressionDict(dictionary)
    shared.precompute_compress(level=LEVEL)
    return shared


def _encoded(docs: DataFrame, file: str, finish, schema: str) -> DataFrame:
    """``doc_id`` and what ``finish()`` makes of the lists of serialized ids, end id included; in one pass."""
    end = np.asarray([END_ID], "<u4").tobytes()
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        bpe, make = ByteBpe.of(file), finish()
        for batch in slices(batches, most=2**22, rows=1024):
            ids = [i + end for i in bpe.encode_all([t or "" for t in batch.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *make(ids)], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def write_store(docs: DataFrame, path: str, file: str) -> None:
    """Encode all ``docs`` and write them in ascending ``doc_id`` order.

    A first scan of ids and lengths gives the runs (exact byte splits of the id range); texts are encoded where they
    are read, and only compressed frames are moved, once, to the run they belong to.  A task holds one segment at a
    time.  A missing text is an empty one (its frame is the end id); documents without an id come first; rows that
    repeat an id follow each other, ordered by their frames.  An empty table gives a store without segments.
    """
    spark = docs.sparkSession
    sizes = written(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-2**63)).alias("key"),
                                (F.octet_length(F.coalesce("text", F.lit(""))) + 16).cast("long").alias("size")),
                    "token-sizes")
    total, count = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    parts = max(1, -(-total // PART_BYTES))
    points = split_points(sizes, "key", "size", parts, tolerance=0.05)

    share = min(1.0, SAMPLE_DOCS / max(count, 1))
    place = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id")), F.lit(2**30))
    sample = docs.where(place < int(share * 2**30)).limit(2 * SAMPLE_DOCS)
    heads = _encoded(sample, file, lambda: lambda ids: [pa.array([i[:SAMPLE_BYTES] for i in ids], pa.binary())],
                     "doc_id long, ids binary")
    ids = sorted(bytes(r["ids"]) for r in heads.select("ids").collect())
    dictionary = _dictionary(ids)
    name = dictionary_hash(dictionary)
    spark.createDataFrame([(name, bytearray(dictionary))], "dict_hash string, dictionary binary") \
        .coalesce(1).write.parquet(f"{path}/dictionary")

    def compress():
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=_as_dict(dictionary))
        return lambda ids: [pa.array([len(i) // 4 for i in ids], pa.int64()),
                            pa.array([packer.compress(i) for i in ids], pa.binary())]

    def pack(batches):
        part, number, rows, held = None, 0, [], 0

        def row():
            ends = np.cumsum([0, *[len(f) for _, _, f in rows]]).tolist()
            given = [d for d, _, _ in rows if d is not None]
            return {"part": part, "segment": number, "first_doc_id": min(given, default=None),
                    "last_doc_id": max(given, default=None), "doc_ids": [d for d, _, _ in rows],
                    "n_tokens": [n for _, n, _ in rows], "offsets": ends, "tokens": sum(n for _, n, _ in rows),
                    "dict_hash": name, "payload": b"".join(f for _, _, f in rows)}

        for batch in slices(batches, "frame", most=2**20):
            for p, d, n, f in zip(*[batch.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "frame")]):
                if rows and (p != part or held + len(f) > SEGMENT_BYTES):
                    yield pa.RecordBatch.from_pylist([row()], schema=_SEGMENT_SCHEMA)
                    number, rows, held = (number + 1 if p == part else 0), [], 0
                part = p
                rows.append((d, n, f))
                held += len(f)
        if rows:
            yield pa.RecordBatch.from_pylist([row()], schema=_SEGMENT_SCHEMA)

    frames = _encoded(docs, file, compress, "doc_id long, n_tokens long, frame binary")
    key = F.coalesce(F.col("doc_id"), F.lit(-2**63))
    (frames.withColumn("part", halving(key, points)).repartition(parts, "part")
     .sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "frame")
     .mapInArrow(pack, SEGMENTS).write.parquet(f"{path}/segments"))


_SEGMENT_SCHEMA = pa.schema([
    ("part", pa.int32()), ("segment", pa.int32()), ("first_doc_id", pa.int64()), ("last_doc_id", pa.int64()),
    ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())),
    ("tokens", pa.int64()), ("dict_hash", pa.string()), ("payload", pa.binary())])


def _store_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary = bytes(row["dictionary"])
    if dictionary_hash(dictionary) != row["dict_hash"]:
        raise ValueError(f"{path}: the dictionary does not match its hash")
    return row["dict_hash"], dictionary


def _frames(batch, name, unpacker):
    """(part, segment, doc_id, tokens before it in the segment, n_tokens, serialized ids) of a batch of segments."""
    columns = ("part", "segment", "doc_ids", "n_tokens", "offsets", "dict_hash", "payload")
    for p, s, docs, counts, ends, named, payload in zip(*[batch.column(c).to_pylist() for c in columns]):
        if named != name:
            raise ValueError(f"segment {p}/{s} needs dictionary {named}")
        before = 0
        for d, n, lo, hi in zip(docs, counts, ends, ends[1:]):
            ids = unpacker.decompress(payload[lo:hi], max_output_size=4 * n)
            yield p, s, d, before, n, ids
            before += n


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a store, from its files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``,
    ``ids_crc32``."""
    name, dictionary = _store_dictionary(spark, path)
    segments = spark.read.parquet(f"{path}/segments")

    def digest(batches):
        unpacker = zstandard.ZstdDecompressor(dict_data=_as_dict(dictionary))
        for batch in slices(batches, "payload"):
            rows = [(p, s, d, b, n, zlib.crc32(ids)) for p, s, d, b, n, ids in _frames(batch, name, unpacker)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), *[pa.int64()] * 4))],
                ["part", "segment", "doc_id", "before", "n_tokens", "ids_crc32"])

    rows = segments.select("part", "segment", "doc_ids", "n_tokens", "offsets", "dict_hash", "payload").mapInArrow(
        digest, "part int, segment int, doc_id long, before long, n_tokens long, ids_crc32 long")
    starts = ranked(segments.select("part", "segment", "tokens"), [F.col("part"), F.col("segment")], ["tokens"])
    return (rows.join(starts.select("part", "segment", "before_tokens"), ["part", "segment"])
            .select("doc_id", (F.col("before_tokens") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"))


def read_ids(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """``doc_id`` and its ids.  With ``doc_ids`` only segments whose id range can hold one are read, and only the
    asked frames of those are unpacked."""
    name, dictionary = _store_dictionary(spark, path)
    segments = spark.read.parquet(f"{path}/segments")
    wanted = None if doc_ids is None else set(doc_ids)
    if wanted is not None:
        asked = F.array(*[F.lit(d).cast("long") for d in sorted(wanted)])
        segments = segments.where(F.exists(asked, lambda d: d.between(F.col("first_doc_id"), F.col("last_doc_id"))))

    def unpack(batches):
        unpacker = zstandard.ZstdDecompressor(dict_data=_as_dict(dictionary))
        for batch in batches:
            for docs, counts, ends, named, payload in zip(*[batch.column(c).to_pylist() for c in (
                    "doc_ids", "n_tokens", "offsets", "dict_hash", "payload")]):
                if named != name:
                    raise ValueError(f"a segment needs dictionary {named}")
                for d, n, lo, hi in zip(docs, counts, ends, ends[1:]):
                    if wanted is None or d in wanted:
                        ids = np.frombuffer(unpacker.decompress(payload[lo:hi], max_output_size=4 * n), "<u4")
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([d], pa.int64()), pa.array([ids.astype("i8")], pa.list_(pa.int64()))],
                            ["doc_id", "ids"])

    return segments.mapInArrow(unpack, "doc_id long, ids array<long>")


def stored_digests(docs: DataFrame, file: str) -> DataFrame:
    """Write a store of all ``docs`` below the shared folder and read its files back."""
    path = scratch_path(docs.sparkSession, "token-store")
    write_store(docs, path, file)
    return read_digests(docs.sparkSession, path)
