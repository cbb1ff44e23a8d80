"""N-gram Jaccard join with a prefix tree.

Documents are sets of distinct word n-grams; two link when their Jaccard similarity is at least ``least`` per cent.

1. Every set is hashed; equal sets are one node.
2. Candidates: sets that can link differ in at most (sum of sizes) * (100 - least) / (100 + least) n-grams.  The n-grams
   of a set are dealt by hash into more parts than that, so linked sets agree in whole parts.  Nodes that share a part
   (the hash of all n-grams in it) are candidates; sizes are grouped in classes, and a set near the upper end of its
   class is dealt for the next class too.  No link is lost (see ``signatures``).  Below 90 per cent parts get so small
   that common n-grams alone make candidates; there (``by="rare"``) a set gives its rarest n-grams instead, in a global
   order by counted frequency, and linked sets share several of those (see ``rare_keys``).  A set that shares fewer
   keys than any link needs goes, and with it its keys, round after round (see ``_peeled``).
3. Candidate components are joined by a prefix tree: sets in a common global order (frequent n-grams first) are stored
   in a compressed trie; each set walks it once, sharing the overlap counted on common prefixes, and leaves a subtree
   as soon as the lengths that remain cannot reach the similarity, or when it is already linked to all of it.
4. A component beyond ``BLOCK`` sets is cut into blocks: within blocks first, then one set of each found group, and
   last every set outside the largest group against all blocks.  Pairs that are already in one group are left out;
   all others are compared, so no link between groups is lost.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm import wordhash
from attesta.llm.common import matched, partitions, runs, slices
from attesta.llm.components import components
from attesta.llm.exact_dedup import BITS_PER_ROW, SLICE_WORDS, _signature
from attesta.session import written

N = 3
LEAST = 90         # per cent
RATIO = 1.4        # of the size classes
SPARE = 2          # parts beyond the number of differences, plus one
BLOCK = 256        # sets of one prefix tree
BLOCK_BYTES = 32 * 2**20
COUNTER_BITS = 23  # frequencies are counted in 2^23 counters whatever the input: 8 MB go to the driver and the tasks
COUNTER_SLICE = 2**17
EXTRA = 10         # one key in so many n-grams beyond those that a linked set may lack
PEELS = 3          # rounds in which sets with too few shared keys go (any number is right; more leave fewer candidates)


def size_classes(most: int, least: int = LEAST) -> np.ndarray:
    """Lower ends of the size classes up to beyond ``most``."""
    lows = [1]
    while lows[-1] <= most * 100 // least + 1:
        lows.append(max(lows[-1] + 1, int(np.ceil(lows[-1] * RATIO))))
    return np.array([*lows, lows[-1] * 2 + 2])


def shingle_sets(column: pa.Array, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each row, row after row, and their number up to and with each row.  A row with
    fewer words has its whole sequence as its only one; a row without words has none."""
    h, upto = wordhash.words(column)
    lengths = np.diff(upto, prepend=0)
    rows = np.repeat(np.arange(len(upto)), lengths)
    grams = wordhash.ngrams(h, n)
    inside = np.arange(len(grams)) + n <= upto[rows[:len(grams)]] if len(grams) else np.zeros(0, bool)
    grams, of = grams[inside], rows[:len(inside)][inside]
    short = np.flatnonzero((lengths > 0) & (lengths < n))
    whole = []
    for r in short.tolist():
        value = np.uint64(lengths[r])
        for x in h[upto[r] - lengths[r]:upto[r]]:
            value = wordhash.join(np.array([value]), np.array([x]))[0]
        whole.append(value)
    grams = np.concatenate([grams, np.array(whole, np.uint64)])
    of = np.concatenate([of, short])
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    return grams[new], np.bincount(of[new], minlength=len(upto)).cumsum()


def _sums(groups: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """A hash of the values of each group, whatever their order (exact sums of their halves)."""
    low = np.bincount(groups, (values & np.uint64(0xFFFFFFFF)).astype(float), count)
    high = np.bincount(groups, (values >> np.uint64(32)).astype(float), count)
    return wordhash.join(low.astype(np.uint64), high.astype(np.uint64))


def signatures(grams: np.ndarray, upto: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Part hashes of all sets, and their number up to and with each set.

    In a class whose sets have at most ``r`` members, linked sets differ in at most d = 2 r (100 - least) / (100 + least)
    members; with d + 1 + SPARE parts at least 1 + SPARE parts agree.  A set with at most SPARE empty parts leaves
    those out: the parts that agree are then not all empty.  A set with more of them gives the empty ones too.
    Classes with d = 0 hold equal sets only and need no parts.
    """
    sizes = np.diff(upto, prepend=0)
    lows = size_classes(int(sizes.max(initial=1)), least)
    own = np.searchsorted(lows, sizes, "right") - 1
    rows = np.repeat(np.arange(len(sizes)), sizes)
    values = wordhash.mix(grams + np.uint64(0x5851F42D4C957F2D))
    dealt = wordhash.mix(grams ^ np.uint64(0x2127599BF4325C37))
    found, owner = [], []
    for step in (0, 1):
        tag = np.maximum(own, 0) + step
        most = lows[tag + 1] - 1
        differ = 2 * most * (100 - least) // (100 + least)
        use = (sizes > 0) & (differ > 0)
        if step:
            use &= sizes * 100 // least >= lows[tag]
        parts = np.where(use, differ + 1 + SPARE, 0)
        first = np.concatenate([[0], parts.cumsum()])
        on = use[rows]
        part = (dealt[on] % parts[rows[on]].astype(np.uint64)).astype(np.int64)
        group = first[rows[on]] + part
        total = int(first[-1])
        members = np.bincount(group, minlength=total)
        of = np.repeat(np.arange(len(sizes)), parts)
        empty = np.bincount(of[members == 0], minlength=len(sizes))
        given = (members > 0) | (empty[of] > SPARE)
        place = np.arange(total) - first[of]
        name = wordhash.join(tag[of].astype(np.uint64), place.astype(np.uint64))
        found.append(wordhash.join(name, _sums(group, values[on], total))[given])
        owner.append(of[given])
    owner_all = np.concatenate(owner)
    order = np.argsort(owner_all, kind="stable")
    return np.concatenate(found)[order], np.bincount(owner_all, minlength=len(sizes)).cumsum()


def _slots(grams: np.ndarray) -> np.ndarray:
    return (wordhash.mix(grams) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def frequency_levels(docs: DataFrame, n: int) -> np.ndarray:
    """How often the n-grams of each counter occur in all documents, as ascending levels in one byte (exact up to 191).

    Each task counts its own rows, the counters are added up in slices, and only the 2^COUNTER_BITS levels are fetched.
    N-grams that share a counter get the same level: the order stays the same for all sets, so nothing is lost; with
    far more distinct n-grams than counters the order of rare ones gets less exact, and candidates more.
    """
    def count(batches):
        total = np.zeros(2**COUNTER_BITS, np.uint32)
        for batch in slices(batches):
            slots, counts = np.unique(_slots(shingle_sets(batch.column("text"), n)[0]), return_counts=True)
            total[slots] += counts.astype(np.uint32)
        for at in range(0, len(total), COUNTER_SLICE):
            part = total[at:at + COUNTER_SLICE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array(
                    [zlib.compress(part.tobytes(), 1)], pa.binary())], ["at", "counts"])

    def add(batches):
        last, total = None, None
        for batch in batches:
            for at, counts in zip(batch.column("at").to_pylist(), batch.column("counts").to_pylist()):
                if at != last:
                    if total is not None:
                        yield level(last, total)
                    last, total = at, np.zeros(COUNTER_SLICE, np.uint64)
                total += np.frombuffer(zlib.decompress(counts), np.uint32)
        if total is not None:
            yield level(last, total)

    def level(at, total):
        high = np.minimum(255, 192 + 4 * np.log2(np.maximum(total, 192) / 192))
        levels = np.where(total < 192, total, high).astype(np.uint8)
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([levels.tobytes()], pa.binary())],
                                          ["at", "levels"])

    counted = docs.select("text").mapInArrow(count, "at int, counts binary")
    found = (counted.repartition(partitions(docs.sparkSession), "at").sortWithinPartitions("at")
             .mapInArrow(add, "at int, levels binary").collect())
    levels = np.zeros(2**COUNTER_BITS, np.uint8)
    for row in found:
        levels[row["at"]:row["at"] + COUNTER_SLICE] = np.frombuffer(row["levels"], np.uint8)
    return levels


def rare_keys(grams: np.ndarray, upto: np.ndarray, levels: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """The rarest n-grams of each set, and their number up to and with each set.

    Linked sets have at least ``least`` per cent of either set in common.  So a set lacks at most size - ceil(size *
    least / 100) of its partner's, and with all n-grams in one order, the first k that both have are among the first
    size - ceil(size * least / 100) + k of each.  A set gives k = size / EXTRA, at least 1; both share the smaller k, and
    the partner has at least ``least`` per cent of the size (see ``keys_needed``).  N-grams whose counter stands at 1
    are in no other row and are left out.
    """
    sizes = np.diff(upto, prepend=0)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    rank = levels[_slots(grams)]
    order = np.lexsort((rank, rows))
    place = np.arange(len(grams)) - (upto - sizes)[rows]
    first = sizes - -(-least * sizes // 100) + np.maximum(1, sizes // EXTRA)
    keep = (place < first[rows]) & (rank[order] > 1)
    return grams[order][keep], np.bincount(rows[keep], minlength=len(sizes)).cumsum()


def keys_needed(size, least: int):
    """How many of its rare keys a set (a column of sizes) shares with each set that it links to, at least."""
    return F.greatest(F.lit(1), F.floor(F.ceil(size * least / 100) / EXTRA)).cast("long")


def set_nodes(grams: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """One 64-bit number per set, the same for equal sets."""
    sizes = np.diff(upto, prepend=0)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    return wordhash.join(_sums(rows, wordhash.mix(grams), len(sizes)), sizes.astype(np.uint64)).view(np.int64)


class _Tree:
    """Compressed trie of sets (ascending ranks); leaves out what a walk cannot use."""

    __slots__ = ("tokens", "last", "children", "ends", "members", "least", "most")

    def __init__(self, seqs, ids, depth):
        shared = len(seqs[ids[0]])
        if len(ids) > 1:
            a, b = seqs[ids[0]], seqs[ids[-1]]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[depth:n] != b[depth:n])
            shared = depth + int(differ[0]) if len(differ) else n
        of = seqs[ids[0]]
        self.tokens = of[depth:shared].tolist()
        self.last = int(of[shared - 1]) if shared else -1
        self.members = ids
        sizes = [len(seqs[i]) for i in ids]
        self.least, self.most = min(sizes), max(sizes)
        self.ends = [i for i in ids if len(seqs[i]) == shared]
        self.children = []


def build(seqs: list[np.ndarray], ids: list[int]) -> _Tree:
    """The trie over ``seqs[i]`` for ``ids``, which come in lexicographic order."""
    root = _Tree(seqs, ids, 0)
    todo = [(root, len(root.tokens))]
    while todo:
        node, depth = todo.pop()
        group: list[int] = []
        for i in [*(i for i in node.members if len(seqs[i]) > depth), None]:
            if group and (i is None or seqs[i][depth] != seqs[group[0]][depth]):
                child = _Tree(seqs, group, depth)
                node.children.append(child)
                todo.append((child, depth + len(child.tokens)))
                group = []
            if i is not None:
                group.append(i)
    return root


class Groups:
    """Union-find over positions."""

    def __init__(self, labels: list[int]):
        first: dict[int, int] = {}
        self.up = [first.setdefault(x, i) for i, x in enumerate(labels)]

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def link(self, i: int, j: int) -> None:
        self.up[self.root(i)] = self.root(j)


def link_sets(sets: list[np.ndarray], labels: list[int], stored: list[int], asking: list[int],
              least: int = LEAST) -> Groups:
    """Groups after linking each of ``asking`` with what it links to among ``stored`` (positions in ``sets``); equal
    ``labels`` are one group from the start and not compared."""
    groups = Groups(labels)
    everything = np.concatenate(sets)
    tokens, at, counts = np.unique(everything, return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.uint32)
    rank[np.lexsort((tokens, -counts))] = np.arange(len(tokens))
    cuts = np.cumsum([len(s) for s in sets])[:-1]
    seqs = [np.sort(r) for r in np.split(rank[at], cuts)]
    tree = build(seqs, sorted(stored, key=lambda i: seqs[i].astype(">u4").tobytes()))
    for q in asking:
        own, ordered, size = set(seqs[q].tolist()), seqs[q].tolist(), len(seqs[q])
        todo = [(tree, 0, 0)]
        while todo:
            node, overlap, depth = todo.pop()
            mine = groups.root(q)
            if all(groups.root(i) == mine for i in node.members):
                continue
            overlap += len(own.intersection(node.tokens))
            depth += len(node.tokens)
            # what the stored sets have lost so far, and what this set has passed without a match
            missed = depth - overlap
            passed = bisect_right(ordered, node.last) - overlap
            if (100 * node.most < least * size + (100 + least) * missed or least * node.least > 100 * size
                    or (100 + least) * (size - passed) < least * (size + node.least)):
                continue
            for i in node.ends:
                if 100 * overlap >= least * (size + len(seqs[i]) - overlap):
                    groups.link(q, i)
            todo += [(child, overlap, depth) for child in node.children]
    return groups


def _sets_of(texts: list, nodes: list[int], n: int) -> tuple[list[np.ndarray], list[int]]:
    """Sets of the texts that have the expected node."""
    grams, upto = shingle_sets(pa.array(texts, pa.large_string()), n)
    found = set_nodes(grams, upto)
    sets = np.split(grams, upto[:-1])
    keep = [i for i, node in enumerate(nodes) if found[i] == node]
    return [sets[i] for i in keep], keep


def _in_blocks(rows: DataFrame, n: int, least: int) -> DataFrame:
    """Links found inside each (``comp``, ``block``) of ``rows`` (``node, label, text``): ``a, b``."""
    def join(batches):
        for _, group in runs(slices(batches), ["comp", "block"], ["node", "label", "text"]):
            sets, keep = _sets_of([g[2] for g in group], [g[0] for g in group], n)
            one = list({group[i][0]: at for at, i in enumerate(keep)}.values())   # equal rows have equal sets
            sets, keep = [sets[at] for at in one], [keep[at] for at in one]
            if len(sets) < 2:
                continue
            nodes = [group[i][0] for i in keep]
            every = list(range(len(sets)))
            found = link_sets(sets, [group[i][1] for i in keep], every, every, least)
            yield _links(nodes, found)

    parts = partitions(rows.sparkSession)
    return (rows.repartition(parts, "comp", "block").sortWithinPartitions("comp", "block", "node")
            .mapInArrow(join, "a long, b long"))


def _across(rows: DataFrame, n: int, least: int) -> DataFrame:
    """Links between the asking and the stored sets of each (``comp``, ``block``, ``chunk``)."""
    def join(batches):
        for _, group in runs(slices(batches), ["comp", "block", "chunk"], ["node", "label", "text", "asks"]):
            sets, keep = _sets_of([g[2] for g in group], [g[0] for g in group], n)
            asks = [group[i][3] for i in keep]
            if not sets or all(asks) or not any(asks):
                continue
            found = link_sets(sets, [group[i][1] for i in keep], [i for i, a in enumerate(asks) if not a],
                              [i for i, a in enumerate(asks) if a], least)
            yield _links([group[i][0] for i in keep], found)

    parts = partitions(rows.sparkSession)
    return (rows.repartition(parts, "comp", "block", "chunk")
            .sortWithinPartitions("comp", "block", "chunk", "asks", "node").mapInArrow(join, "a long, b long"))


def _links(nodes: list[int], found: Groups) -> pa.RecordBatch:
    """Each member to the first of its group: as many links as members."""
    roots = [found.root(i) for i in range(len(nodes))]
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([nodes[r] for r in roots], pa.int64())],
                                      ["a", "b"])


def _blocked(rows: DataFrame) -> DataFrame:
    """``rows`` plus the number of ``blocks`` of their component and the ``block`` of each."""
    sizes = rows.groupBy("comp").agg(F.ceil(F.greatest(
        F.count("*") / BLOCK, F.sum(F.octet_length("text")) / BLOCK_BYTES)).cast("int").alias("blocks"))
    return (rows.join(sizes, "comp")
            .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))


def _row_key():
    """What tells rows apart that share an id or have none: a hash of id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def _described(docs: DataFrame, n: int, least: int, by: str) -> DataFrame:
    if by not in ("parts", "rare"):
        raise ValueError(f"unknown candidate keys {by}")
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs, n)) if by == "rare" else None

    def describe(batches):
        for batch in slices(batches):
            grams, upto = shingle_sets(batch.column("text"), n)
            if levels is None:
                sigs, ends = signatures(grams, upto, least)
            else:
                sigs, ends = rare_keys(grams, upto, levels.value, least)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)),
                                             pa.array(sigs.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("__row"), pa.array(np.diff(upto, prepend=0).astype(np.int64)),
                 pa.array(set_nodes(grams, upto)), lists], ["doc_id", "__row", "n_shingles", "node", "sigs"])

    return written(docs.select(F.col("doc_id").cast("long"), _row_key().alias("__row"), "text").mapInArrow(
        describe, "doc_id long, __row long, n_shingles long, node long, sigs array<long>"), "shingle-sets")


def _with_leaders(keys: DataFrame, once: bool = False) -> DataFrame:
    """The rows of ``keys`` (``node, sig`` and more) whose key is in several nodes, plus the ``leader`` of the key.

    Where each (``node, sig``) is there ``once``, their number tells whether there are several nodes: the largest node
    of each key need not move."""
    several = [] if once else [F.max("node").alias("other")]
    shared = keys.groupBy("sig").agg(F.min("node").alias("leader"), F.count("*").alias("n"), *several)
    shared = written(shared.where("n > 1" if once else "leader <> other").select("sig", "leader", "n"), "shared-parts")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return matched(keys, shared, "sig", "n", total).where("leader is not null").drop("n")


def _peeled(keys: DataFrame) -> DataFrame:
    """``keys`` (each once) with leaders after ``PEELS`` rounds in which nodes with fewer shared keys than they ``need`` go.

    A set shares the keys it needs with each set that it links to, and so does its partner: neither goes in any round,
    and the keys they share stay.  Sets that have only a passage in common mostly go.
    """
    keys = written(_with_leaders(keys, once=True).drop("leader"), "shared-keys")
    for _ in range(PEELS):
        enough = keys.groupBy("node").agg(F.count("*").alias("has"), F.first("need").alias("need")).where("has >= need")
        keys = written(_with_leaders(keys.join(enough.select("node"), "node", "left_semi"), once=True), "peeled-keys")
        keys, led = keys.drop("leader"), keys
    return led


def _one_per_node(described: DataFrame) -> DataFrame:
    """``node, n_shingles, sigs`` once for each set: only sets that several rows have are moved, not the keys of all."""
    again = written(described.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "repeated-sets")
    several = described.join(again, "node", "left_semi").groupBy("node").agg(
        F.first("n_shingles").alias("n_shingles"), F.first("sigs").alias("sigs"))
    return described.join(again, "node", "left_anti").select("node", "n_shingles", "sigs").unionByName(several)


def _star_links(led: DataFrame) -> DataFrame:
    """Links (``a, b``) that connect what shares a key: each node with the smallest of its leaders, and that one with its
    other leaders.  In a group of copies that share many keys these are about as many as its nodes, not its keys."""
    nodes = led.groupBy("node").agg(F.collect_set("leader").alias("leaders"))
    ends = nodes.select(F.array_min("leaders").alias("b"), F.explode(F.array_union("leaders", F.array("node"))).alias("a"))
    return ends.where("a <> b").select("a", "b")


def _candidate_texts(docs: DataFrame, described: DataFrame, least: int, by: str) -> DataFrame:
    """``comp, node, label, text`` of one document per node that shares enough parts with other nodes."""
    if by == "rare":
        led = _peeled(_one_per_node(described).select("node", keys_needed(F.col("n_shingles"), least).alias("need"),
                                       F.explode("sigs").alias("sig")))
    else:
        led = _with_leaders(described.select("node", F.explode("sigs").alias("sig")))
    comps = components(_star_links(led))
    first = described.groupBy("node").agg(F.min("__row").alias("__key"))
    chosen = written(first.join(comps, "node").select("node", F.col("label").alias("comp"), "__key"), "chosen")
    # a filter of the chosen rows, of bounded size, keeps most other texts out of the exchange
    size = min(SLICE_WORDS, max(1, -(-chosen.count() * BITS_PER_ROW // 64)))
    word, mine = F.pmod(F.xxhash64("__key"), F.lit(size)), _signature(F.col("__key"))
    bits = chosen.groupBy(word.alias("__word")).agg(F.bit_or(mine).alias("__bits"))
    texts = (docs.select(_row_key().alias("__key"), "text").withColumn("__word", word)
             .join(F.broadcast(bits), "__word").where(F.col("__bits").bitwiseAND(mine) == mine)
             .select("__key", "text"))
    return written(texts.join(chosen, "__key").select("comp", "node", F.col("node").alias("label"), "text"),
                   "candidate-texts")


def _relabelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    labels = components(links)
    joined = rows.drop("label").join(labels, "node", "left")
    return joined.withColumn("label", F.coalesce("label", "node"))


def links(texts: DataFrame, n: int = N, least: int = LEAST) -> DataFrame:
    """Links that connect all candidates (``comp, node, label, text``) that link, ``a, b``."""
    rows = written(_blocked(texts), "blocked-texts")
    found = written(_in_blocks(rows, n, least), "set-links")
    split = rows.where("blocks > 1").drop("blocks", "block")
    if split.limit(1).count() == 0:
        return found
    # one set of each group, until those of a component fit one block
    while True:
        current = written(_relabelled(split, found), "split-texts")
        first = current.groupBy("comp", "label").agg(F.min("node").alias("node"))
        heads = written(_blocked(current.join(first, ["comp", "label", "node"])), "group-heads")
        before = first.count()
        found = written(found.unionByName(_in_blocks(heads, n, least)), "set-links")
        after = _relabelled(split, found).select("comp", "label").distinct().count()
        if after == before or heads.where("blocks > 1").limit(1).count() == 0:
            break
    # every set outside the largest group of its component against all sets of it
    current = written(_relabelled(split, found), "split-texts")
    sizes = current.groupBy("comp", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("comp").agg(F.max_by("label", F.struct("n", "label")).alias("main"),
                                        F.count("*").alias("labels")).where("labels > 1")
    open_ = current.join(largest.select("comp", "main"), "comp")
    stored = _blocked(open_.drop("main"))
    asking = _blocked(open_.where("label <> main").drop("main")).withColumnsRenamed(
        {"block": "chunk", "blocks": "chunks"})
    chunks = asking.select("comp", "chunks").distinct()
    blocks = stored.select("comp", "blocks").distinct()
    every = [F.lit(False).alias("asks"), "comp", "block", "chunk", "node", "label", "text"]
    left = stored.join(chunks, "comp").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    right = asking.join(blocks, "comp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = left.select(*every).unionByName(right.select(F.lit(True).alias("asks"), *every[1:]))
    return found.unionByName(written(_across(pairs, n, least), "set-links"))


def _components(docs: DataFrame, n: int, least: int, by: str) -> DataFrame:
    """Per row ``doc_id, __row, n_shingles`` and of its group, if that has several rows, the row ``first`` with the
    smallest id."""
    described = _described(docs, n, least, by)
    labels = components(links(_candidate_texts(docs, described, least, by), n, least))
    copies = described.groupBy("node").agg(F.count("*").alias("n"))
    named = written(labels.join(copies, "node"), "node-labels")
    rows = described.select("doc_id", "__row", "n_shingles", "node")
    labelled = matched(rows, named, "node", "n", described.count()).withColumn("label", F.coalesce("label", "node"))
    labelled = written(labelled.select("doc_id", "__row", "n_shingles", "label"), "set-labels")
    total = labelled.count()
    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "__row"))
    per_label = written(labelled.where("n_shingles > 0").groupBy("label").agg(
        F.min(own).alias("first"), F.count("*").alias("n")).where("n > 1"), "set-groups")
    named = matched(labelled, per_label, "label", "n", total)
    return named.select("doc_id", "__row", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("first")).alias("first"))


def groups(docs: DataFrame, n: int = N, least: int = LEAST, by: str = "parts") -> DataFrame:
    """Per document ``doc_id, n_shingles, component_id`` (the smallest id reachable by links).  ``by`` names the keys
    that make candidates, "parts" or "rare"; the result is the same.

    A document without words is linked with nothing.  Rows that repeat an id and rows without one are joined each by
    its own text; the component is missing where no linked row has an id.  An empty table gives no rows.
    """
    rows = _components(docs, n, least, by)
    return rows.select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = N, least: int = LEAST, by: str = "parts") -> DataFrame:
    """The documents that stay: of each group the one with the smallest id; documents without an id or words stay.
    Rows that repeat an id are judged each by its own text; rows equal in id and text stay or go together."""
    gone = _components(docs, n, least, by).where(
        (F.col("first.doc_id") < F.col("doc_id"))
        | ((F.col("first.doc_id") == F.col("doc_id")) & (F.col("first.__row") != F.col("__row"))))
    gone = gone.select(F.col("__row").alias("__gone")).distinct()
    return docs.join(gone, _row_key() == F.col("__gone"), "left_anti")
