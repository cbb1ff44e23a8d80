"""The composed import on small bundles: every outcome, every refusal, and the way out and back."""

import json

import pytest
from pyspark.sql import functions as F

from attesta.operators import imports
from attesta.session import scratch_path
from attesta.sources import bundles

SOURCE = {"source_id": "s1", "title": "Notes", "surface": "github", "source_kind": "RESEARCH", "authority_class": "RESEARCH_SYNTHESIS",
          "project_id": "p", "as_of": "2024-01-01", "revision": "r1"}


def line(**parts):
    return json.dumps(parts, ensure_ascii=False)


def item(item_id, claim="a claim", **more):
    return {"item_id": item_id, "item_type": "RESEARCH_RESULT", "claim": claim, **more}


BUNDLE = [line(manifest={"format": "f", "seed_id": "seed"}), "", "// a comment", line(source=SOURCE, item=item("a")),
          line(item=item("b", "ein Anspruch", source_id="s1", supersedes_item_id="a", confidence="0.5")),
          line(item=item("b", "ein Anspruch", source_id="s1", supersedes_item_id="a", confidence="0.5")),
          line(item=item("c", source_id="s1", supersedes_item_id="nowhere")),
          line(relation={"from_item_id": "a", "to_item_id": "b", "relation_type": "SUPPORTS"})]


def lines_of(spark, texts, parts=1):
    path = scratch_path(spark, "bundle")
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, value string")
    rows.repartitionByRange(parts, "n").sortWithinPartitions("n").select("value").write.text(path)
    return bundles.bundle_lines(spark, path, by_folder=True)


@pytest.fixture(scope="module")
def first(spark):
    return imports.import_bundle(imports.empty_memory(spark), lines_of(spark, BUNDLE, 3), "seed", "v1")


def counters(result):
    return {k: n for k, n in result.counters.first().asDict().items() if n}


def errors(result):
    return sorted((r.line, r.rule) for r in result.errors.collect())


def items(memory):
    return {r.item_id: r for r in memory.items.collect()}


def test_first_import(first):
    assert errors(first) == [] and first.committed
    assert counters(first) == {"sources_inserted": 1, "items_inserted": 3, "items_superseded": 1, "relations_inserted": 1}
    assert [(r.line, r.rule) for r in first.warnings.collect()] == [(7, "SUPERSEDED_ITEM_ABSENT")]
    rows = items(first.after)
    assert (rows["a"].lifecycle, rows["a"].superseded_by, rows["a"].project_id, rows["a"].as_of) == ("SUPERSEDED", "b", "p", "2024-01-01")
    assert rows["b"].confidence == 0.5 and rows["b"].source_title_at_capture == "Notes" and rows["b"].last_seed_version == "v1"
    edges = {r.relation_id: r for r in first.after.relations.collect()}
    assert set(edges) == {"rel:SUPPORTS:a->b", "rel:auto:SUPERSEDES:b->a"}
    assert edges["rel:SUPPORTS:a->b"].from_version_id == rows["a"].version_id


def test_same_again(spark, first):
    again = imports.import_bundle(first.after, lines_of(spark, BUNDLE), "seed", "v2")
    assert counters(again) == {"sources_unchanged": 1, "items_unchanged": 3, "relations_unchanged": 1}
    assert items(again.after)["a"].last_seed_version == "v2" and items(again.after)["a"].first_seed_version == "v1"


def test_revision_keeps_the_old_version(spark, first):
    source = {**SOURCE, "revision": "r2"}
    result = imports.import_bundle(first.after, lines_of(spark, [
        line(source=source), line(item=item("b", "another", source_id="s1")), line(item=item("d", source_id="s1")),
        line(relation={"from_item_id": "a", "to_item_id": "b", "relation_type": "SUPPORTS"}),
        line(relation={"from_item_id": "d", "to_item_id": "b", "relation_type": "SUPPORTS"})]), "seed", "v3")
    assert counters(result) == {"sources_updated": 1, "items_revised": 1, "items_inserted": 1, "relations_inserted": 1,
                                "relations_unchanged": 1, "not_in_this_seed": 2}
    rows, old = items(result.after), items(first.after)["b"]
    archived = rows[old.version_id]
    assert (archived.claim, archived.lifecycle, archived.superseded_by, archived.source_revision_at_capture) == (
        "ein Anspruch", "SUPERSEDED", "b", "r1")
    assert rows["b"].claim == "another" and rows["b"].source_revision_at_capture == "r2" and rows["a"].lifecycle == "SUPERSEDED"
    pins = {r.relation_id: r.to_version_id for r in result.after.relations.collect()}
    assert pins["rel:SUPPORTS:a->b"] == old.version_id and pins["rel:SUPPORTS:d->b"] == rows["b"].version_id


BAD = {
    "INVALID_JSON": ["{"], "UNRECOGNISED": ['{"x": 1}'], "CONFLICTING_ITEM": [line(item=item("z", source_id="s1")), line(item=item("z", "x", source_id="s1"))],
    "CONFLICTING_SOURCE": [line(source={**SOURCE, "source_id": "t"}), line(source={**SOURCE, "source_id": "t", "title": "T"})],
    "ITEM_SOURCE_UNKNOWN": [line(item=item("z", source_id="later")), line(source={**SOURCE, "source_id": "later"})],
    "UNKNOWN_ITEM_TYPE": [line(item={**item("z", source_id="s1"), "item_type": "WISH"})],
    "LOGICAL_ID_MISMATCH": [line(item=item("z", source_id="s1", logical_item_id="y"))],
    "VERSION_ID_MISMATCH": [line(item=item("z", source_id="s1", version_id="z@00000000000000"))],
    "SOURCE_REQUIRED": [line(source={"source_id": "t"})],
    "TO_UNKNOWN": [line(relation={"from_item_id": "a", "to_item_id": "zz", "relation_type": "SUPPORTS"})],
    "FROM_PIN_UNKNOWN": [line(relation={"from_item_id": "a", "to_item_id": "b", "relation_type": "CONTRADICTS", "from_version_id": "a@00000000000000"})],
    "UNKNOWN_RELATION_TYPE": [line(relation={"from_item_id": "a", "to_item_id": "b", "relation_type": "LIKES"})],
    "RELATION_REVISED": [line(relation={"from_item_id": "a", "to_item_id": "b", "relation_type": "SUPPORTS", "scope": "other"})],
}


@pytest.mark.parametrize("rule", ["INVALID_JSON", "RELATION_REVISED"])
def test_one_bad_line_changes_nothing(spark, first, rule):
    result = imports.import_bundle(first.after, lines_of(spark, [line(item=item("new", source_id="s1")), *BAD[rule]]), "seed", "v9")
    assert rule in {r for _, r in errors(result)} and not result.committed
    assert result.after is first.after and counters(result) == {}


def test_all_refusals_at_once(spark, first):
    texts = [t for group in BAD.values() for t in group]
    pins = {r.item_id: r.version_id for r in first.after.items.collect()}
    texts += [line(relation={"from_item_id": "a", "to_item_id": "c", "relation_type": "SUPPORTS", "from_version_id": pins["b"]}),
              line(relation={"from_item_id": "a", "to_item_id": "b", "relation_type": "SUPPORTS", "to_version_id": pins["c"]})]
    result = imports.import_bundle(first.after, lines_of(spark, texts, 4), "seed", "v9")
    got = {r for _, r in errors(result)}
    assert set(BAD) <= got and "FROM_PIN_OF_OTHER_ITEM" in got
    assert (1, "INVALID_JSON") in errors(result)


def test_export_and_back(spark, first):
    """Through four files and into an empty memory: the same rows, and the same export again."""
    revised = imports.import_bundle(first.after, lines_of(spark, [line(item=item("b", "another \n line", source_id="s1"))]), "seed", "v3")
    path = bundles.write_ordered(imports.export_lines(revised.after, {"kind": "export"}).repartition(4), ["part", "k1", "k2"],
                                 scratch_path(spark, "export"))
    back = imports.import_bundle(imports.empty_memory(spark), bundles.bundle_lines(spark, path, by_folder=True), "x", "y", restore=True)
    assert errors(back) == []
    for name in ("sources", "items", "relations"):
        before, after = getattr(revised.after, name), getattr(back.after, name)
        assert before.exceptAll(after.select(*before.columns)).count() == 0 == after.exceptAll(before.select(*after.columns)).count(), name


def test_nothing_at_all(spark):
    result = imports.import_bundle(imports.empty_memory(spark), lines_of(spark, ["", "// nothing"]), "seed", "v1")
    assert result.committed and counters(result) == {} and result.after.items.count() == 0


def test_claims_do_not_move_in_an_import(spark, first):
    """What an import stores beside the lines themselves has no claim in it; the items read back have them all."""
    result = imports.import_bundle(first.after, lines_of(spark, [line(item=item("b", "another", source_id="s1"))]), "seed", "v3")
    assert "claim" not in result.after.heads.columns
    assert {i: r.claim for i, r in items(result.after).items() if "@" not in i} == {"a": "a claim", "b": "another", "c": "a claim"}
    digests = {r.item_id: r.claim for r in imports.items_with_digests(result.after).collect()}
    assert digests == {r.item_id: r.d for r in result.after.items.select("item_id", F.sha2("claim", 256).alias("d")).collect()}


def test_a_memory_of_plain_tables_takes_an_import(spark, first):
    plain = imports.Memory(first.after.sources, first.after.items, first.after.relations)
    result = imports.import_bundle(plain, lines_of(spark, [line(item=item("b", "another", source_id="s1"))]), "seed", "v3")
    assert counters(result)["items_revised"] == 1
    assert sorted(r.claim for r in result.after.items.collect()) == ["a claim", "a claim", "another", "ein Anspruch"]
