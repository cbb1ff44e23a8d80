"""Repair of conversations against the recursive SQL and against all edit sequences of short conversations."""

import itertools
import random

import duckdb
import numpy as np
import pytest

from attesta.llm import check_sql, conversations

SCHEMA = "conv_id long, turn long, role string, text string, part string, audit string, dropped string"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def rows():
    """Wild roles, no roles, turns, texts or ids, empty and very long texts, ties, equal rows, one long conversation."""
    rnd = random.Random(13)
    roles = ["user"] * 6 + ["assistant"] * 6 + ["system", "sage", "tool", "", None, "User", "ünder"]
    texts = [None, "", " \n\t", "one.", "two!  \n", "three", "four.\x1c", "fünf?", "six .", "." * 3000 + "x" * 100000]
    out = []
    for conv in [*range(60), None, -7]:
        for turn in range(rnd.choice([1, 1, 2, 3, 5, 9, 30])):
            turn = rnd.choice([turn, turn, turn, turn + 4, None])
            for _ in range(rnd.choice([1, 1, 1, 2, 3])):
                text = rnd.choice(texts[:-1]) if rnd.random() < 0.5 else f"text {rnd.randrange(9**9)}."
                out.append((conv, turn, rnd.choice(roles), text))
    out += [(500, turn, rnd.choice(roles), rnd.choice([f"t{turn % 90}.", f"u{turn}"])) for turn in range(700)]
    out += [(500, 3, "user", "equal.")] * 300 + [(501, 1, "user", texts[-1]), (501, 2, "assistant", "x" * 9)]
    return [(*r, "own", "own", "own") for r in out]


def wanted(table):
    con = duckdb.connect()
    con.register("conversations", table.select("conv_id", "turn", "role", "text").toArrow())
    found = con.execute(check_sql.REPAIR_SQL)
    names = [c[0] for c in found.description]
    return sorted(([row[names.index(c)] for c in COLUMNS] for row in found.fetchall()), key=str)


def reported(df):
    return sorted(([r[c] for c in COLUMNS] for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def chats(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.mark.parametrize("block_rows", [1, 3, 50, 4096])
def test_report(chats, block_rows):
    pieces = conversations.repaired(conversations.damaged(chats), block_rows=block_rows)
    assert reported(conversations.report(pieces)) == wanted(chats)


def test_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    assert reported(conversations.damaged_and_repaired(table)) == wanted(table)


def test_empty(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert reported(conversations.damaged_and_repaired(nothing)) == []


def test_given_rows(spark):
    """Without planted damage, extra columns or not: the repaired lines themselves."""
    given = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c."), (2, 0, "tool", "")],
                                  "conv_id long, turn int, role string, text string")
    got = {1: ("", []), 2: ("", [])}
    for r in conversations.repaired(given).orderBy("conv_id", "part", "block").collect():
        audit, lines = got[r.conv_id]
        got[r.conv_id] = (audit + r.audit, lines + ([r.repaired] if r.n_lines else []))
    assert {k: (audit, "\n".join(lines)) for k, (audit, lines) in got.items()} == {
        1: ("DKK", "user:b.\nassistant:c."), 2: ("D", "")}


def every_repair(codes):
    """All edit sequences with at most two inserts in a row, by the rules of the edits alone."""
    found = []
    for edits in itertools.product(*[["".join(p) for n in range(3) for p in itertools.product("I", repeat=n)]] * (len(codes) + 1),
                                   *["DKR"] * len(codes)):
        inserts, kept = edits[:len(codes) + 1], edits[len(codes) + 1:]
        audit = "".join(i + k for i, k in zip(inserts, kept)) + inserts[-1]
        state, cost, at = 0, 0, 0
        for edit in audit:
            if edit == "I":
                cost, state = cost + 5, (2, 2, 3, 2)[state]
                continue
            code, at = codes[at], at + 1
            if edit == "D":
                cost += 2
                continue
            target = int(conversations.MOVE[state, code & 3]) if edit == "K" else (2, 2, 3, 2)[state]
            if code >> 2 == 1 or target == 4:
                cost = None
                break
            cost, state = cost + (edit == "R") + 5 * (code >> 2 == 2), target
        if cost is not None and state in (0, 3):
            found.append((cost, audit))
    return min(found)


def test_paths_are_least():
    rnd = random.Random(3)
    cases = [[rnd.randrange(12) for _ in range(rnd.randrange(5))] for _ in range(60)]
    sizes = np.array([len(c) for c in cases])
    cost, audits, _ = conversations.least_paths(
        np.array([x for c in cases for x in c], dtype=np.int64), sizes, np.tile(conversations.END, (len(cases), 1)),
        np.ones(len(cases), dtype=bool), np.zeros(len(cases), dtype=int))
    assert [(int(c), a) for c, a in zip(cost, audits)] == [every_repair(c) for c in cases]
