"""Folding of patches against a loop over one item after the other, and rules over small record graphs."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import patches as pt
from attesta.operators import record_graph as rg

FIELDS = ["status", "status_note", "next_action"]


def brute(items, patches):
    state = {i[0]: dict(zip([*FIELDS, "archived_at"], i[1:])) for i in items}
    out = {}
    for work_id, seq, at, kind, patch in sorted(patches, key=lambda p: p[1]):
        code = None
        if work_id not in state:
            code = "NOT_FOUND"
        elif kind == "UPDATE" and patch is None:
            code = "NOT_A_PATCH"
        elif kind == "UPDATE" and "non_canon" in patch:
            code = "NON_CANON_INVARIANT"
        elif kind == "UPDATE" and set(patch) - set(FIELDS):
            code = "UNKNOWN_FIELD"
        elif kind == "UPDATE" and "status" in patch and patch["status"] not in ("OPEN", "BLOCKED"):
            code = "UNKNOWN_STATUS"
        if code:
            out[work_id, seq] = ("REFUSED", code, None)
            continue
        before = dict(state[work_id])
        if kind == "UPDATE":
            state[work_id].update(patch)
        elif before["archived_at"] is None:
            state[work_id]["archived_at"] = at
        after = state[work_id]
        changed = sorted(f for f in after if after[f] != before[f])
        out[work_id, seq] = ("NO_OP" if not changed else f"{kind}_ITEM", None, (changed, before, dict(after)))
    return out, state


def some(rng):
    kind = rng.choice(["UPDATE"] * 5 + ["ARCHIVE"])
    names = rng.sample([*FIELDS, *FIELDS, "non_canon", "colour"], rng.randint(0, 2)) if rng.random() < 0.95 else None
    patch = None if names is None else {n: rng.choice(["OPEN", "BLOCKED", "OPEN", None]) for n in names}
    return kind, patch


@pytest.mark.parametrize("seed", [1, 2])
def test_fold_equals_loop(spark, monkeypatch, seed):
    monkeypatch.setattr(pt, "BLOCK", 4)
    monkeypatch.setattr(pt, "SUPERBLOCK", 16)
    rng = random.Random(seed)
    items = [(f"w{i}", "OPEN", None if i % 2 else "n", "a", "2020-01-01" if i == 3 else None) for i in range(6)]
    # half of all patches are of one item, and one item is unknown
    patches = [("w0" if rng.random() < 0.5 else f"w{rng.randint(0, 6)}", seq, f"2024-02-{seq % 28 + 1:02d}", *some(rng)) for seq in range(150)]
    item_rows = spark.createDataFrame(items, "work_id string, status string, status_note string, next_action string, archived_at string")
    patch_rows = spark.createDataFrame(patches, "work_id string, seq long, at string, kind string, patch map<string,string>")
    folded = pt.fold_patches(item_rows, patch_rows, FIELDS, {"status": ["OPEN", "BLOCKED"]})
    want, state = brute(items, patches)
    got = {(r.work_id, r.seq): (r.outcome, r.code, None if r.before is None else (list(r.changed), r.before.asDict(), r.after.asDict()))
           for r in folded.collect()}
    assert got == want
    assert {o for o, _, _ in want.values()} == {"REFUSED", "NO_OP", "UPDATE_ITEM", "ARCHIVE_ITEM"}
    now = {r.work_id: {f: r[f] for f in [*FIELDS, "archived_at"]} for r in pt.patched_items(item_rows, folded).collect()}
    assert now == state
    log = pt.change_rows(folded, "USER")
    assert log.count() == sum(o.endswith("_ITEM") for o, _, _ in want.values())
    cleared = log.where("get_json_object(after_json, '$.status_note') IS NULL AND get_json_object(before_json, '$.status_note') IS NOT NULL")
    assert cleared.count() > 0


def test_no_patches_and_no_items(spark):
    items = spark.createDataFrame([("w", "OPEN", None)], "work_id string, status string, archived_at string")
    patches = spark.createDataFrame([], "work_id string, seq long, at string, kind string, patch map<string,string>")
    folded = pt.fold_patches(items, patches)
    assert folded.count() == 0 and pt.patched_items(items, folded).collect() == items.collect()
    one = spark.createDataFrame([("w", 1, "d", "UPDATE", {"status": "BLOCKED"})], patches.schema)
    assert [r.code for r in pt.fold_patches(items.where("false"), one).collect()] == ["NOT_FOUND"]


GRAPH = "id string, supersedes string, superseded_by string, related_to array<string>, provenance string, known_kind string"


def findings(spark, rows):
    rules = rg.provenance_rules(["USER", "DOC"], "USER", "USER_STATEMENT")
    return sorted((r.rule, r.key) for r in rg.graph_violations(spark.createDataFrame(rows, GRAPH), rules).collect())


def test_graph_rules(spark):
    clean = [("a", None, "b", ["b", None], "DOC", "X"), ("b", "a", None, None, "USER", "USER_STATEMENT"), ("z", None, None, [], "DOC", None)]
    assert findings(spark, clean) == []
    assert findings(spark, clean[:0]) == []
    assert findings(spark, [("a", None, "b", None, "DOC", "X"), ("b", None, None, None, "DOC", "X")]) == [("SUCCESSOR_DOES_NOT_SAY_SO", "a")]
    assert findings(spark, [("a", None, None, None, "DOC", "X"), ("b", "a", None, None, "DOC", "X")]) == [("PREDECESSOR_DOES_NOT_SAY_SO", "b")]
    assert findings(spark, [("a", "q", "p", ["r"], "DOC", "X")]) == [
        ("RELATED_TO_MISSING", "a"), ("SUPERSEDED_BY_MISSING", "a"), ("SUPERSEDES_MISSING", "a")]
    assert findings(spark, [("a", None, None, None, None, "X"), ("a", None, None, None, "USER", "X"), ("b", None, None, None, "DOC", "USER_STATEMENT")]) == [
        ("DUPLICATE_ID", "a"), ("UNKNOWN_PROVENANCE", "a"), ("USER_PROVENANCE_OF_OTHER_SOURCE", "a"), ("USER_SOURCE_WITH_OTHER_PROVENANCE", "b")]


def test_cycles_of_records(spark):
    ring = [(f"r{i}", f"r{(i - 1) % 4}", f"r{(i + 1) % 4}", None, "DOC", "X") for i in range(4)]
    tail = [("t", None, "r0", None, "DOC", "X"), ("s", "s", "s", None, "DOC", "X")]
    got = {r.id: r.length for r in rg.supersession_cycles(spark.createDataFrame(ring + tail, GRAPH)).collect()}
    assert got == {"r0": 4, "r1": 4, "r2": 4, "r3": 4, "s": 1}


def test_stored_records_are_not_sent_to_the_driver(spark):
    """Millions of stored ids are a few megabytes as files only: they are not a broadcast."""
    from attesta.session import written
    rows = written(spark.createDataFrame([("a", None, "b", ["q"], "DOC", "X"), ("b", None, None, None, "DOC", "X")], GRAPH), "records")
    for df in (rg.lost_references(rows), rg.one_sided_supersession(rows)):
        assert "BroadcastExchange" not in df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
        assert df.count() == 1
