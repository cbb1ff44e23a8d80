"""Repair of the turn structure of conversations by the cheapest edits.

A repaired conversation is empty or an optional system turn followed by user and assistant in turn.  A dynamic program
over (row, state) gives the cost to go; the arcs that reach it form a graph, whose arcs are ranked by the least audit
of 1, 2, 4, ... edits that starts with them (prefix doubling).  The path is read off the doubled pointers.

Rows are range-partitioned in the order of their conversations, so a task finds nearly all of its conversations whole
and finishes them.  What crosses the edge of a partition, or is longer than a block, is cut into blocks of bounded
size: each block gives a 4 x 4 matrix of least costs, the matrices (not the rows) are scanned for the costs to go at
the blocks' ends, every block is solved on its own for each state it may be entered in, and a second scan of four
numbers a block tells the state it is entered in.  So one conversation may hold any share of all rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from attesta.llm.common import partitions
from attesta.session import written

BLOCK_ROWS, BLOCK_BYTES = 4096, 2**22      # most of one conversation that a task holds
BATCH_ROWS, BATCH_BYTES = 8192, 2**23      # whole conversations solved together
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
MUST_GO, CUT_OFF = 1, 2

# states: nothing yet, after system, after user, after assistant; a conversation may end in the first and the last
END = np.array([0, 2 * INSERT, INSERT, 0], dtype=np.int64)
ROLE = ["user", "user", "assistant", "user"]
TURN = np.array([2, 2, 3, 2])              # the state after the role that may follow
INITIALS = {"s": 0, "u": 1, "a": 2}
# state after keeping a row with this initial (s, u, a, other) in each state; 4: not allowed
MOVE = np.array([[1, 2, 4, 4], [4, 2, 4, 4], [4, 4, 3, 4], [4, 2, 4, 4]])
LABELS = b"\0DIKR"                         # in ASCII order; the first one marks the end of a path
FAR = 2**60
BLANKS = " \t\n\x0b\f\r"


# ---- costs and paths of many fragments at once -----------------------------------------------------------------

def cost_to_go(codes: np.ndarray, sizes: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """Least cost from before each row (and from the end) of every fragment in each state, with ``tails`` at the ends.

    ``codes`` holds a byte for each row: its role's initial plus four times its fault.  A fragment of n rows has n + 1
    layers; inserts before a row belong to its layer, those at the end to the tail.
    """
    first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    base = first + np.arange(len(sizes))
    cost = np.full((int(sizes.sum()) + len(sizes), 4), FAR, dtype=np.int64)
    cost[base + sizes] = tails
    longest_first = np.argsort(-sizes, kind="stable")
    ordered = sizes[longest_first]
    for at in range(int(ordered[0]) - 1 if len(ordered) else -1, -1, -1):
        live = longest_first[:np.searchsorted(-ordered, -at, side="left")]
        code, after = codes[first[live] + at], cost[base[live] + at + 1]
        here = np.minimum(after + DELETE, _kept(code, after))
        here = np.minimum(here, _reroled(code, after))
        here[:, 2], here[:, 3] = (np.minimum(here[:, 2], here[:, 3] + INSERT),
                                  np.minimum(here[:, 3], here[:, 2] + INSERT))
        here[:, :2] = np.minimum(here[:, :2], here[:, 2:3] + INSERT)
        cost[base[live] + at] = np.minimum(here, FAR)
    return cost


def _extra(code: np.ndarray) -> np.ndarray:
    fault = code >> 2
    return np.where(fault == MUST_GO, FAR, np.where(fault == CUT_OFF, TRUNCATED, 0))[:, None]


def _kept(code: np.ndarray, after: np.ndarray) -> np.ndarray:
    padded = np.concatenate([after, np.full((len(after), 1), FAR)], axis=1)
    return np.take_along_axis(padded, MOVE.T[code & 3], axis=1) + _extra(code)


def _reroled(code: np.ndarray, after: np.ndarray) -> np.ndarray:
    return after[:, TURN] + REROLE + _extra(code)


def least_paths(codes: np.ndarray, sizes: np.ndarray, tails: np.ndarray, last: np.ndarray, entry: np.ndarray):
    """(cost, audit, state at the end) of every fragment entered in state ``entry``: of its cheapest edits the ASCII
    least.  ``last`` says which fragments end their conversation, where inserts may close it.

    From one node every label leads to one node (keeping and re-roling each have one outcome), so two paths of equal
    cost with equal audits are the same path, and no audit is the beginning of another.
    """
    cost = cost_to_go(codes, sizes, tails)
    layers = np.arange(len(cost))
    base = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    ends = np.zeros(len(cost), dtype=bool)
    ends[base + sizes] = True
    inner = layers[~ends]
    after = cost[inner + 1]
    node = inner[:, None] * 4 + np.arange(4)
    below = (inner + 1)[:, None] * 4
    found = [(1, node, below + np.arange(4), after + DELETE), (3, node, below + MOVE.T[codes & 3], _kept(codes, after)),
             (4, node, np.broadcast_to(below + TURN, node.shape), _reroled(codes, after)),
             (2, node, np.broadcast_to(inner[:, None] * 4 + TURN, node.shape), cost[inner][:, TURN] + INSERT)]
    source, label, target = [], [], []
    for code, start, to, price in found:
        best = price == cost[inner]
        source.append(start[best])
        target.append(to[best])
        label.append(np.full(int(best.sum()), code))
    closing = (base + sizes)[last] * 4
    for state in range(4):
        inserts = closing if state in (1, 2) else closing[:0]
        stop = (base + sizes) * 4 + state
        if state in (1, 2):
            stop = np.setdiff1d(stop, inserts + state)
        source += [inserts + state, stop]
        target += [inserts + TURN[state], stop]
        label += [np.full(len(inserts), 2), np.zeros(len(stop), dtype=int)]
    source, label, target = (np.concatenate(x).astype(np.int64) for x in (source, label, target))
    order = np.lexsort((label, source))
    source, label, target = source[order], label[order], target[order]
    first = np.searchsorted(source, np.arange(len(cost) * 4))
    rank, jumps = label, [first[target]]
    while label[jumps[-1]].any():
        rank = np.unique(rank * (rank.max() + 1) + rank[jumps[-1]], return_inverse=True)[1]
        jumps.append(jumps[-1][jumps[-1]])
    root = base * 4 + entry
    by_rank = np.lexsort((rank, source))
    start = by_rank[np.searchsorted(source[by_rank], root)]
    at, length = start, (label[start] != 0).astype(np.int64)
    for k in range(len(jumps) - 1, -1, -1):
        on = label[jumps[k][at]] != 0
        at, length = np.where(on, jumps[k][at], at), length + (on.astype(np.int64) << k)
    bounds = np.concatenate(([0], np.cumsum(length)))
    owner = np.repeat(np.arange(len(sizes)), length)
    place, arc = np.arange(len(owner)) - bounds[:-1][owner], start[owner]
    for k, jump in enumerate(jumps):
        arc = np.where((place >> k) & 1, jump[arc], arc)
    letters = np.frombuffer(LABELS, dtype=np.uint8)[label[arc]].tobytes().decode()
    audits = [letters[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    return cost.reshape(-1)[root], audits, target[at] % 4


def replay(audit: str, state: int, roles: list[str], texts: list[str]) -> list[str]:
    """The repaired ``role:text`` lines that an audit makes of the rows."""
    lines, rows = [], zip(roles, texts)
    for edit in audit:
        role, text = (ROLE[state], "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        lines.append(f"{ROLE[state] if edit == 'R' else role}:{text}")
        state = int(MOVE[state, _initial(role)] if edit == "K" else TURN[state])
    return lines


def _initial(role: str) -> int:
    return INITIALS.get(role[:1], 3)


# ---- rows of one fragment --------------------------------------------------------------------------------------

class Fragment:
    """Rows of one conversation in their order, with the counts that the report needs."""

    def __init__(self, key, seen: set | None = None):
        self.key, self.seen = key, seen if seen is not None else set()
        self.rows, self.codes, self.bytes = [], bytearray(), 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None

    def add(self, row: dict) -> None:
        self.rows.append(row)
        self.bytes += len(row.get("text") or "") * 4
        if row["fault"] is None:           # a dropped row only says that its conversation exists
            return
        mark, fault = (row["role"], row["text_key"]), row["fault"]
        if row["fault"] == "blank":
            self.blank, code = self.blank + 1, MUST_GO
        elif mark in self.seen:
            self.duplicate, code = self.duplicate + 1, MUST_GO
        else:
            code = CUT_OFF if fault == "truncated" else 0
            self.truncated += fault == "truncated"
        self.seen.add(mark)
        code = code * 4 + _initial(row["role"])
        if self.codes:
            self.illegal += not legal(self.codes[-1] & 3, code & 3)
        self.codes.append(code)
        if row["turn"] is not None:
            self.turns += row["turn"] != self.high
            self.low = row["turn"] if self.low is None else self.low
            self.high = row["turn"]

    def counts(self) -> dict:
        return {"blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
                "illegal": self.illegal, "turns": self.turns, "low": self.low, "high": self.high,
                "first": self.codes[0] & 3 if self.codes else None, "last": self.codes[-1] & 3 if self.codes else None}


def legal(before: int, after: int) -> bool:
    return (before, after) in ((0, 1), (1, 2), (2, 1))


def gaps(low, high, turns) -> int:
    return 0 if low is None else high - low + 1 - turns


def _arrays(fragments: list[Fragment]):
    codes = np.frombuffer(b"".join(bytes(f.codes) for f in fragments), dtype=np.uint8).astype(np.int64)
    return codes, np.array([len(f.codes) for f in fragments], dtype=np.int64)


def _rows(batches) -> Iterator[dict]:
    for batch in batches:
        for row in batch.to_pylist():
            yield row


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


COUNTS = "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long"


def _solve(fragments: list[Fragment]) -> list[dict]:
    """Whole conversations: counts, cost, audit and the repaired text."""
    codes, sizes = _arrays(fragments)
    n = len(fragments)
    cost, audits, _ = least_paths(codes, sizes, np.tile(END, (n, 1)), np.ones(n, dtype=bool), np.zeros(n, dtype=int))
    out = []
    for fragment, price, audit in zip(fragments, cost, audits):
        live = [r for r in fragment.rows if r["fault"] is not None]
        lines = replay(audit, 0, [r["role"] for r in live], [r["text"] for r in live])
        counts = fragment.counts()
        out.append({"conv_id": fragment.key, "whole": True, "cost": int(price), "audit": audit,
                    "repaired": "\n".join(lines), "n_lines": len(lines),
                    **{c: counts[c] for c in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")}})
    return out


def _first_pass(schema: pa.Schema, block_rows: int, block_bytes: int):
    """Partitions of rows in order -> whole conversations solved, and the rows of all others with their blocks."""
    def work(batches):
        ready, held, size, n_rows = [], None, 0, 0
        block, cut = 0, True               # cut: what is held may go on elsewhere, as a partition's first one does

        def edge_rows():
            nonlocal block
            block += 1
            return _batch([{**r, "whole": False, "block": block, "at": n} for n, r in enumerate(held.rows)], schema)

        for row in _rows(batches):
            if held is not None and row["conv_id"] != held.key:
                if cut:
                    yield edge_rows()
                else:
                    ready.append(held)
                    size, n_rows = size + held.bytes, n_rows + len(held.rows)
                held, cut = None, False
                if n_rows >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield _batch(_solve(ready), schema)
                    ready, size, n_rows = [], 0, 0
            elif held is not None and (len(held.rows) >= block_rows or held.bytes >= block_bytes):
                yield edge_rows()
                held, cut = None, True
            if held is None:
                held = Fragment(row["conv_id"])
            held.add(row)
        if held is not None:
            yield edge_rows()
        if ready:
            yield _batch(_solve(ready), schema)
    return work


def _runs(batches, name: str) -> Iterator[tuple[object, Iterator[dict]]]:
    """Rows of a sorted partition by runs of equal ``name``; a run is passed on row by row."""
    return groupby(_rows(batches), key=lambda row: row[name])


# ---- conversations cut into blocks -----------------------------------------------------------------------------

def _blocks(schema: pa.Schema):
    """Rows of each block (and, ahead of them, what earlier blocks of its conversation have said) -> codes, counts
    and the least costs from each state to each state."""
    def work(batches):
        ready: list[tuple[Fragment, int, int]] = []

        def solved():
            codes, sizes = _arrays([f for f, _, _ in ready])
            one = np.where(np.eye(4, dtype=bool), 0, FAR)
            starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
            to = np.stack([cost_to_go(codes, sizes, np.tile(one[e], (len(ready), 1)))[starts] for e in range(4)], axis=2)
            return _batch([{"conv_id": f.key, "part": p, "block": b, "codes": bytes(f.codes),
                            "costs": to[n].reshape(-1).tolist(), **f.counts()} for n, (f, p, b) in enumerate(ready)],
                          schema)

        for (part, block), rows in _grouped(batches):
            seen: set = set()
            fragment = None
            for row in rows:
                if row["at"] < 0:
                    seen.add((row["role"], row["text_key"]))
                    continue
                fragment = fragment or Fragment(row["conv_id"], seen)
                fragment.add(row)
            fragment.rows.clear()
            fragment.seen = set()
            ready.append((fragment, part, block))
            if sum(len(f.codes) for f, _, _ in ready) > BATCH_ROWS:
                yield solved()
                ready.clear()
        if ready:
            yield solved()
    return work


def _grouped(batches):
    return groupby(_rows(batches), key=lambda row: (row["part"], row["block"]))


def _scan_back(schema: pa.Schema):
    """Blocks of a conversation from its end: the costs to go at the end of each."""
    def work(batches):
        for _, rows in _runs(batches, "conv_id"):
            tail, out, last = END, [], True
            for row in rows:
                out.append({"part": row["part"], "block": row["block"], "tail": tail.tolist(), "closes": last})
                tail = np.minimum((np.array(row["costs"]).reshape(4, 4) + tail).min(axis=1), FAR)
                last = False
                if len(out) >= 1000:
                    yield _batch(out, schema)
                    out = []
            if out:
                yield _batch(out, schema)
    return work


def _solve_blocks(schema: pa.Schema):
    """Every block with its costs to go: audit, cost and exit state for each state that it may be entered in."""
    def work(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4):
                rows = batch.slice(at, 4).to_pylist()
                sizes = np.array([len(r["codes"]) for r in rows], dtype=np.int64)
                codes = np.frombuffer(b"".join(r["codes"] for r in rows), dtype=np.uint8).astype(np.int64)
                tails, last = np.array([r["tail"] for r in rows]), np.array([r["closes"] for r in rows])
                by_state = [least_paths(codes, sizes, tails, last, np.full(len(rows), s)) for s in range(4)]
                yield _batch([{"conv_id": r["conv_id"], "part": r["part"], "block": r["block"],
                               "price": [int(by_state[s][0][n]) for s in range(4)],
                               "audits": [by_state[s][1][n] for s in range(4)],
                               "exits": [int(by_state[s][2][n]) for s in range(4)]} for n, r in enumerate(rows)], schema)
    return work


def _scan_on(schema: pa.Schema):
    """Blocks of a conversation from its beginning: the state in which each is entered."""
    def work(batches):
        for _, rows in _runs(batches, "conv_id"):
            state, out, begins = 0, [], True
            for row in rows:
                out.append({"part": row["part"], "block": row["block"], "entry": state, "begins": begins})
                state, begins = row["exits"][state], False
                if len(out) >= 1000:
                    yield _batch(out, schema)
                    out = []
            if out:
                yield _batch(out, schema)
    return work


def _write_blocks(schema: pa.Schema):
    """The audit of each block (ahead) and its rows -> its repaired lines."""
    def work(batches):
        for (part, block), rows in _grouped(batches):
            head = next(rows)
            live = [r for r in rows if r["fault"] is not None]
            lines = replay(head["audit"], head["entry"], [r["role"] for r in live], [r["text"] for r in live])
            yield _batch([{"part": part, "block": block, "repaired": "\n".join(lines), "n_lines": len(lines)}], schema)
    return work


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _pieces(edge: DataFrame, conv: str) -> DataFrame:
    """What ``_solve`` gives, one row for each block, for conversations that are cut into blocks."""
    spark = edge.sparkSession
    n = partitions(spark)
    place = ["part", "block"]

    def step(df: DataFrame, by: list[str], order: list, make, ddl: str) -> DataFrame:
        return (df.repartition(n, *by).sortWithinPartitions(*by, *order)
                .mapInArrow(make(_arrow(ddl)), ddl))

    said = edge.where("fault is not null").select("conv_id", "role", "text_key", *place).distinct()
    mark = ["conv_id", "role", "text_key"]
    firsts = (said.groupBy(*mark).agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("n"))
              .where("n > 1").withColumnsRenamed({c: f"__{c}" for c in mark}))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in mark]
    before = (said.join(firsts, same).where(F.struct(*place) != F.col("first"))
              .select(*mark, *place, F.lit(-1).cast("long").alias("at")))
    narrow = edge.select(*mark, *place, "at", "turn", "fault").unionByName(before, allowMissingColumns=True)
    blocks = written(step(narrow, place, ["at"], _blocks, f"conv_id {conv}, part int, block int, codes binary, costs array<long>, "
                          f"first long, last long, {COUNTS}"), "conversation-blocks")
    tails = step(blocks.select("conv_id", *place, "costs"), ["conv_id"], [F.desc("part"), F.desc("block")], _scan_back,
                 "part int, block int, tail array<long>, closes boolean")
    ddl = f"conv_id {conv}, part int, block int, price array<long>, audits array<string>, exits array<int>"
    solved = written(blocks.select("conv_id", *place, "codes").join(tails, place)
                     .mapInArrow(_solve_blocks(_arrow(ddl)), ddl), "conversation-paths")
    entries = step(solved.select("conv_id", *place, "exits"), ["conv_id"], place, _scan_on,
                   "part int, block int, entry int, begins boolean")
    chosen = written(solved.join(entries, place).select(
        "conv_id", *place, "entry", F.element_at("audits", F.col("entry") + 1).alias("audit"),
        F.when(F.col("begins"), F.element_at("price", F.col("entry") + 1)).alias("cost")), "conversation-edits")
    heads = chosen.select(*place, "entry", "audit", F.lit(-1).cast("long").alias("at"))
    lines = step(edge.select(*place, "at", "fault", "role", "text").unionByName(heads, allowMissingColumns=True),
                 place, ["at"], _write_blocks, "part int, block int, repaired string, n_lines int")
    return written(blocks.drop("codes", "costs").join(chosen.drop("conv_id"), place).join(lines, place),
                   "conversation-pieces")


# ---- the operator ----------------------------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row (it stays with ``dropped``),
    1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the user's.  Missing values count as one blank
    wherever they stand as text."""
    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), shown("role").alias("role"),
                                shown("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") < 2, F.lit("")).when(F.col("code") == 2, F.translate("text", ".!?", ""))
    times = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       text.otherwise(F.col("text")).alias("text"), (F.col("code") == 0).alias("dropped"), times.alias("copy")
                       ).drop("copy")


def repaired(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``rows`` (conv_id, turn, role, text and, if there, ``dropped``) -> repaired conversations in pieces.

    One row for each conversation (``whole``), or for each block of one that was cut: ``conv_id, part, block, whole``,
    the counts of faults, ``cost`` (on the first piece), ``audit``, ``repaired`` (lines ``role:text``) and ``n_lines``;
    pieces follow each other by (part, block).  Rows are taken by turn, missing turns first, rows of one turn by role and
    then by the SHA-256 of their text; missing roles and texts count as one blank.  The rows of a missing conv_id are one
    conversation.  An empty table gives no rows; a conversation with dropped rows only gives an empty one.
    """
    spark = rows.sparkSession
    conv = rows.schema["conv_id"].dataType.simpleString()
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (F.when(dropped, F.lit(None).cast("string")).when(bare == "", "blank")
             .when(F.right(bare, F.lit(1)).isin(".", "!", "?"), "none").otherwise("truncated"))
    given = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                        F.coalesce("text", F.lit(" ")).alias("text"), dropped.alias("dropped"))
    keyed = given.select("conv_id", "turn", "role", "text", fault.alias("fault"),
                         F.unhex(F.sha2("text", 256)).alias("text_key"), F.monotonically_increasing_id().alias("nth"))
    # equal rows are told apart by their number, so that any share of all rows may be equal
    order = ["conv_id", "turn", "role", "text_key", "nth"]
    dealt = (keyed.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).drop("nth")
             .withColumn("part", F.spark_partition_id()))
    ddl = (f"conv_id {conv}, part int, block int, at long, whole boolean, turn long, role string, text string, "
           f"fault string, text_key binary, cost long, audit string, repaired string, n_lines int, {COUNTS}")
    passed = written(dealt.mapInArrow(_first_pass(_arrow(ddl), block_rows, block_bytes), ddl), "conversations")
    whole = passed.where("whole").select("conv_id", "part", "block", "whole", *[c.split()[0] for c in COUNTS.split(", ")],
                                         F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"),
                                         "cost", "audit", "repaired", "n_lines")
    edge = passed.where("not whole").select("conv_id", "part", "block", "at", "turn", "role", "text", "fault", "text_key")
    cut = _pieces(edge, conv).withColumn("whole", F.lit(False)).drop("entry")
    return whole.unionByName(cut.select(*whole.columns))


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _joined(schema: pa.Schema):
    """Pieces of a conversation in order -> its report; the digest is carried on from piece to piece."""
    def work(batches):
        for conv_id, rows in _runs(batches, "conv_id"):
            out = {"conv_id": conv_id, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0}
            digest, audit, lines, turns, low, high, last = hashlib.sha256(), [], 0, 0, None, None, None
            for row in rows:
                for c in ("blank", "duplicate", "truncated", "illegal", "cost"):
                    out[c] += row[c] or 0
                if row["first"] is not None:
                    out["illegal"] += last is not None and not legal(last, row["first"])
                    last = row["last"]
                if row["low"] is not None:
                    turns += row["turns"] - (row["low"] == high)
                    low, high = row["low"] if low is None else low, row["high"]
                audit.append(row["audit"])
                if row["n_lines"]:
                    digest.update((("\n" if lines else "") + row["repaired"]).encode())
                    lines += row["n_lines"]
            yield _batch([{**out, "gaps": gaps(low, high, turns), "audit": "".join(audit),
                           "repaired_sha256": digest.hexdigest()}], schema)
    return work


def report(pieces: DataFrame) -> DataFrame:
    """One row per conversation of ``repaired``: counts, cost, the whole audit, and the SHA-256 of the repaired text.

    A digest is made in the order of the text, so the pieces of one conversation pass through one task, a piece at a
    time.  Whole conversations stay where they are."""
    conv = pieces.schema["conv_id"].dataType.simpleString()
    ddl = f"conv_id {conv}, {REPORT}"
    names = [c.split()[0] for c in ddl.split(", ")]
    gap = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0).cast("long"))
    whole = (pieces.where("whole").withColumn("gaps", gap).withColumn("repaired_sha256", F.sha2("repaired", 256))
             .select(*names))
    cut = (pieces.where("not whole").repartition(partitions(pieces.sparkSession), "conv_id")
           .sortWithinPartitions("conv_id", "part", "block").mapInArrow(_joined(_arrow(ddl)), ddl))
    return whole.unionByName(cut)


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """The report on all conversations after ``damaged`` and ``repaired``."""
    return report(repaired(damaged(conversations)))
