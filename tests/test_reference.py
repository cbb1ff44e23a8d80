"""Bundles, imports, versions and retrieval on small hand-made records."""

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.functions.identity import version_parts
from attesta.functions.rules import violations
from attesta.operators import merge, versions
from attesta.operators import reference as ref
from attesta.operators import retrieval as rt
from attesta.operators import search_index as si
from attesta.operators import work
from attesta.plans.scale import asked_rows, lookup_join
from attesta.session import scratch_path
from attesta.sources import bundles


def write_text(spark, label, lines):
    path = scratch_path(spark, label)
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    return path


BUNDLE = [
    json.dumps({"manifest": {"format": "ref-jsonl/1", "seed_id": "s"}}), "", "// a comment",
    json.dumps({"source": {"source_id": "a", "title": "A", "surface": "github", "source_kind": "RESEARCH"},
                "item": {"item_id": "i1", "source_id": "a", "item_type": "DECISION", "claim": "x"}}),
    "{broken", json.dumps({"relation": {"from_item_id": "i1", "to_item_id": "i2", "relation_type": "SUPPORTS"}}),
    json.dumps({"manifest": {"seed_id": "late"}}), json.dumps({"other": 1}), '{"item": {"item_id": "i2"}} trailing',
]


def test_bundle_reader(spark):
    parsed = bundles.parse_lines(bundles.bundle_lines(spark, write_text(spark, "b", BUNDLE))).cache()
    kinds = {r.line: r.kind for r in parsed.select("line", "kind").collect()}
    assert kinds == {1: "manifest", 4: "item", 5: "INVALID_JSON", 6: "relation", 7: "manifest", 8: "UNRECOGNISED", 9: "INVALID_JSON"}
    manifests = bundles.bundle_manifests(parsed).collect()
    assert [m.manifest.seed_id for m in manifests] == ["s"]


def test_line_numbers_of_a_file_read_in_many_splits(spark):
    path = scratch_path(spark, "long")
    spark.range(0, 5000, 1, 1).select(F.concat(F.lit("line "), F.col("id") + 1).alias("value")).coalesce(1).write.text(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = bundles.bundle_lines(spark, path)
        assert lines.select(F.max("line"), F.count_if(F.concat(F.lit("line "), "line") != F.col("raw"))).first()[:] == (5000, 0)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def items_frame(spark, rows):
    df = spark.createDataFrame(rows, "item_id string, body string, seed string, lifecycle string")
    return df.select("item_id", F.sha2("body", 256).alias("record_hash"), F.struct("body").alias("content"),
                     F.struct("seed").alias("capture"), "lifecycle")


def empty_archive(spark):
    return items_frame(spark, []).withColumn("superseded_by", F.lit(None).cast("string"))


def test_merge_keeps_first_capture_archives_and_never_revives(spark):
    old = items_frame(spark, [("same", "x", "v1", "ACTIVE"), ("rev", "x", "v1", "ACTIVE"), ("dead", "x", "v1", "SUPERSEDED"), ("gone", "x", "v1", "ACTIVE")])
    new = items_frame(spark, [("same", "x", "v2", None), ("rev", "y", "v2", None), ("dead", "z", "v2", None), ("fresh", "x", "v2", None)])
    current, archive = merge.merge_items(old, new, empty_archive(spark))
    got = {r.item_id: (r.content.body, r.capture.seed, r.lifecycle, r.outcome) for r in current.collect()}
    assert got == {"same": ("x", "v1", "ACTIVE", "unchanged"), "rev": ("y", "v2", "ACTIVE", "revised"),
                   "dead": ("z", "v2", "SUPERSEDED", "revised"), "gone": ("x", "v1", "ACTIVE", "untouched"),
                   "fresh": ("x", "v2", "ACTIVE", "inserted")}
    assert {r.item_id.split("@")[0] for r in archive.collect()} == {"rev", "dead"}
    assert {(r.lifecycle, r.content.body, r.superseded_by == r.item_id.split("@")[0]) for r in archive.collect()} == {("SUPERSEDED", "x", True)}


def test_second_import_changes_nothing(spark):
    rows = items_frame(spark, [("a", "x", "v1", "ACTIVE"), ("b", "y", "v1", "ACTIVE")])
    current, archive = merge.merge_items(rows, rows, empty_archive(spark))
    assert {r.outcome for r in current.collect()} == {"unchanged"} and archive.count() == 0


def test_commit_is_all_or_nothing(spark):
    root = scratch_path(spark, "root")
    rows = spark.range(5)
    merge.commit({"t": rows}, rows.where("id < 0"), root)
    before = merge.published(spark, root)
    with pytest.raises(merge.ImportRefused):
        merge.commit({"t": rows}, rows.where("id = 1"), root)
    with pytest.raises(merge.ImportRefused):
        merge.commit({"t": rows}, rows.where("id < 0"), root, base="old", expected="new")
    assert merge.published(spark, root) == before


def test_export_and_import_again(spark):
    sources = ref.normalise_sources(spark.createDataFrame(
        [(s, "T", "github", "RESEARCH", "", "p", "", "", "2024", "", "", "") for s in ("a", "b")],
        "source_id string, title string, surface string, source_kind string, authority_class string, project_id string, "
        "locator string, revision string, as_of string, currentness string, privacy string, content_hash string"))
    raw = spark.createDataFrame([("i1", "a", "DECISION", "claim"), ("i2", "a", "ROUTE", 'quote "x"')],
                                "item_id string, source_id string, item_type string, claim string")
    for name in ("project_id", "source_section", "source_status", "epistemic_state", "authority_scope", "validity", "confidence",
                 "as_of", "supersedes_item_id", "provenance"):
        raw = raw.withColumn(name, F.lit(""))
    items = ref.bind_items(raw, sources)
    assert {(r.project_id, r.epistemic_state, r.as_of) for r in items.collect()} == {("p", "SOURCE_ASSERTION", "2024")}
    relations = spark.createDataFrame([("r1", "SUPPORTS", "i1", "i2")], "relation_id string, relation_type string, from_item_id string, to_item_id string")
    lines = bundles.bundle_export(items.select("item_id", *ref.v.ITEM_CONTENT, "version_id"), sources, relations, {"format": "ref-jsonl/1"})
    path = bundles.write_ordered(lines, ["part", "k1", "k2"], scratch_path(spark, "export"))
    texts = [r.value for r in spark.read.text(path).collect()]
    assert len(texts) == 5 and not any("null" in t for t in texts)
    parsed = bundles.parse_lines(bundles.bundle_lines(spark, path))
    back = parsed.where("kind = 'item'").select("record.item.*", F.lit(1).cast("long").alias("line"))
    again = ref.bind_items(back, ref.normalise_sources(parsed.where("kind IN ('source', 'item')").select("record.source.*").distinct()))
    key = ["item_id", "version_id"]
    assert sorted(map(tuple, again.select(*key).collect())) == sorted(map(tuple, items.select(*key).collect()))


def test_rules_of_lens_and_pairs(spark):
    rows = spark.createDataFrame([("i1", "s", "HUMAN_LENS", "c", None, "RESEARCH_SYNTHESIS"), ("i2", "s", "ROUTE", "c", "verified", "HUMAN_REFERENCE_ONLY"),
                                  ("i3", "s", "NOPE", "", None, None)],
                                 "item_id string, source_id string, item_type string, claim string, epistemic_state string, source_authority_class_at_capture string")
    rows = rows.withColumn("source_known", F.lit(True))
    got = {(r.key, r.rule) for r in violations(rows, F.col("item_id"), ref.item_rules()).collect()}
    assert got == {("i1", "LENS_FORBIDDEN"), ("i2", "LENS_REQUIRED"), ("i2", "STRONG_STATE_KEPT"), ("i3", "ITEM_REQUIRED"), ("i3", "UNKNOWN_ITEM_TYPE")}


def test_lineage_marks_cycles_and_long_chains(spark):
    rows = [("a", "b"), ("b", "c"), ("c", None), ("lost", "nowhere"), ("x", "y"), ("y", "x")] + [(f"n{i}", f"n{i + 1}") for i in range(60)] + [("n60", None)]
    got = {r.item_id: r for r in versions.lineage_heads(spark.createDataFrame(rows, "item_id string, superseded_by string")).collect()}
    assert (got["a"].head_id, got["a"].hops, got["c"].hops) == ("c", 2, 0)
    assert got["x"].over_bound_or_cyclic and got["y"].over_bound_or_cyclic and not got["a"].over_bound_or_cyclic
    assert (got["n10"].head_id, got["n10"].hops, got["n10"].over_bound_or_cyclic) == ("n60", 50, False)
    assert got["n9"].over_bound_or_cyclic
    assert (got["lost"].head_id, got["lost"].hops) == ("lost", 0)


def test_pins_stay_when_a_relation_comes_again(spark):
    schema = "relation_id string, record_hash string, from_version_id string, to_version_id string"
    stored = spark.createDataFrame([("r1", "h", "a@1", "b@1"), ("r2", "h", "a@1", "b@1")], schema)
    incoming = spark.createDataFrame([("r1", "h", "a@2", "b@1"), ("r2", "other", None, None), ("r3", "h", "a@1", "b@1")], schema)
    assert {tuple(r) for r in merge.relation_revisions(stored, incoming).collect()} == {("r1", "RELATION_REPINNED"), ("r2", "RELATION_REVISED")}
    assert {r.from_version_id for r in merge.merge_relations(stored, incoming).where("relation_id = 'r1'").collect()} == {"a@1"}


def test_version_parts(spark):
    df = spark.createDataFrame([("x@y@0123456789abcd",), ("x@short",)], "ref string")
    got = df.select(*version_parts(F.col("ref"))).collect()
    assert [tuple(r) for r in got] == [("x@y", "0123456789abcd"), (None, None)]


@pytest.mark.parametrize("word, want", [("classes", "class"), ("sing", "sing"), ("running", "runn"), ("abc1s", "abc1s"),
                                        ("исследованиями", "исследован"), ("ёлка", "елк"), ("занимается", "занима"), ("кот", "кот")])
def test_stems(spark, word, want):
    assert spark.range(1).select(tx.tokens(F.lit(word)).alias("t")).first().t == [want]


def test_tokens_keep_compounds_and_drop_stop_words(spark):
    got = spark.range(1).select(tx.tokens(F.lit("The ABC-01 of a run_time")).alias("t")).first().t
    assert sorted(got) == sorted(["abc-01", "abc", "01", "run_time", "run", "time"])


def test_json_must_be_one_whole_value(spark):
    texts = ['{"a":1}', '{"a":1} x', "1] [2", "1} x", "1,2", "", "[1]", '"t"']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.ok for r in df.select("t", tx.json_value(F.col("t")).isNotNull().alias("ok")).collect()}
    assert [t for t in texts if got[t]] == ['{"a":1}', "[1]", '"t"']


def test_redaction_leaves_unfinished_spans(spark):
    df = spark.createDataFrame([("a[S]x[E]b[S]y[E]c[S]z",)], "t string")
    assert df.select(tx.redacted(F.col("t"), "[S]", "[E]", "#")).first()[0] == "a#b#c[S]z"


def test_clip_counts_code_points(spark):
    df = spark.createDataFrame([("ab😀cd",)], "t string")
    assert df.select(tx.clipped(F.col("t"), 3)).first()[0] == "ab😀…"


def test_ranked_work_search(spark):
    rows = [("needle", "zz", "", "", []), ("w2", "Needle", "", "", []), ("w3", "a needle b", "", "", []), ("w4", "t", "", "", ["NEEDLE"]),
            ("w5", "t", "has needle", "", []), ("w6", "t", "", "needle", []), ("w7", "t", "", "", [])]
    df = spark.createDataFrame(rows, "work_id string, title string, summary string, body string, tags array<string>").withColumn(
        "archived_at", F.lit(None).cast("string")).withColumn("project_id", F.lit("p"))
    got = [(r.work_id, r["rank"]) for r in work.search_items(df, "needle", tags=F.col("tags")).collect()]
    assert got == [("needle", 1), ("w2", 2), ("w3", 3), ("w4", 4), ("w5", 5), ("w6", 6)]


def test_limits_and_scope():
    assert work.clamp_limit(None) == 20 and work.clamp_limit(0) == 1 and work.clamp_limit(1000) == 100
    assert work.view_limit(500, 20, 50) == (50, True)
    for bad in (0, -1, "5", 1.5, True):
        with pytest.raises(ValueError):
            work.view_limit(bad, 20, 50)


def test_blank_scope_is_refused(spark):
    with pytest.raises(ValueError):
        work.scope_condition(project="  ")


def searched(index, queries, schema="query string, text string", **options):
    queries = index.documents.sparkSession.createDataFrame(queries, schema)
    hits = si.search(index, queries, rt.query_tokens(F.col("text")), **options).collect()
    return sorted((h.query, h["rank"], h.item_id, h.match_mode) for h in hits)


def test_search_falls_back_to_any_after_the_filter(spark):
    df = spark.createDataFrame([(1, "alpha beta", "x"), (2, "alpha", "y"), (3, "gamma", "y")], "id long, t string, lang string")
    index = si.build_index(df, "id", {"t": rt.index_tokens(F.col("t"))}, ["lang"])
    assert searched(index, [("q", "alpha beta")]) == [("q", 1, 1, "all")]
    assert searched(index, [("q", "alpha beta")], keep=F.col("lang") == "y") == [("q", 1, 2, "any")]


def test_search_of_awkward_texts(spark):
    rows = [(1, None, "p", "ACTIVE"), (2, "", "p", "ACTIVE"), (3, "Straße Öl öl OL", None, "ACTIVE"), (4, "oletta x y z", "q", "SUPERSEDED"),
            (5, "z " * 5000 + "olm", "q", None), (6, "x ol", "q", None)]
    df = spark.createDataFrame(rows, "id long, t string, project_id string, lifecycle string")
    index = si.build_index(df, "id", {"t": rt.index_tokens(F.col("t")), "project": rt.index_tokens(F.col("project_id"))},
                           ["project_id", "lifecycle"])
    assert {(r.term, r.item_id): (r.tf0, r.tf1) for r in index.postings.collect()}[("ol", 3)] == (3, 0)
    found = searched(index, [("a", "ÖL", None, None, None), ("b", "ol", "q", True, 1), ("c", "", None, None, None),
                             ("d", "nothing", None, None, None)],
                     "query string, text string, project_id string, include_superseded boolean, limit int")
    assert {(q, i) for q, _, i, _ in found} == {("a", 3), ("a", 5), ("a", 6), ("b", 4)}
    nothing = si.build_index(df.limit(0), "id", {"t": rt.index_tokens(F.col("t"))})
    assert searched(nothing, [("a", "ol")]) == []


def test_search_reads_only_asked_parts(spark):
    df = spark.createDataFrame([(i, f"word{i} {chr(97 + i % 26)}{chr(97 + i // 26)}end") for i in range(600)], "id long, t string")
    index = si.build_index(df, "id", {"t": rt.index_tokens(F.col("t"))})
    asked = si.asked_terms(index, spark.createDataFrame([("q", "abend")], "query string, text string"), rt.query_tokens(F.col("text")))
    plan = si.asked_parts(index, asked).postings._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert searched(index, [("q", "abend")]) == [("q", 1, 26, "all")]


def test_search_scores_in_slices_and_blocks(spark, monkeypatch):
    """Blocks of two queries give the hits of one block; a query that comes twice is one query."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(1, 12) if i % j == 0)) for i in range(60)], "id long, t string")
    index = si.build_index(docs, "id", {"t": rt.index_tokens(F.col("t"))})
    queries = spark.createDataFrame([(f"q{k}", f"w{k} w{k % 3 + 5} zz") for k in range(1, 10)] + [("q1", "w1 w6 zz")], "query string, text string")

    def hits():
        return sorted(map(tuple, si.search(index, queries, rt.query_tokens(F.col("text"))).collect()))

    whole = hits()
    assert len(whole) == 90 and {h[0] for h in whole} == {f"q{k}" for k in range(1, 10)}
    monkeypatch.setattr(si, "BLOCK_QUERIES", 2)
    assert hits() == whole


def test_an_item_lies_in_one_slice(monkeypatch):
    """Rows of items that go on over batches, and of two filters, are all kept, and no slice has too many items."""
    monkeypatch.setattr(si, "SLICE_ITEMS", 3)
    monkeypatch.setattr(si, "SLICE_ROWS", 4)
    rows = [([f], i, t, i + t / 10) for f in ("a", "b") for i in range(8) for t in range(1 + i % 4)]
    types = [pa.list_(pa.string()), pa.int64(), pa.int64(), pa.float64()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at:at + 3]), types)], ["filter", "item_id", "term_id", "part"])
               for at in range(0, len(rows), 3)]
    got, seen = [], []
    for batch in si._sliced(batches):
        for s in batch.to_pylist():
            items, terms, parts = np.frombuffer(s["items"], np.int32), np.frombuffer(s["terms"], np.int64), np.frombuffer(s["parts"])
            assert len(s["item_ids"]) <= 3
            seen += [(s["filter"][0], i) for i in s["item_ids"]]
            got += [(s["filter"], s["item_ids"][i], t, p) for i, t, p in zip(items, terms, parts)]
    assert sorted(got) == sorted(rows) and len(set(seen)) == len(seen) == 16


def test_index_is_kept(spark):
    path = scratch_path(spark, "kept-index")
    records = spark.createDataFrame([("a", "OPEN_QUESTION", "OPEN", "rivers floods", "water")],
                                    "id string, type string, status string, statement string, keywords string")
    fields = si.lexical_index(records, path).fields
    queries = spark.createDataFrame([("q", "which flooding is open?")], "query string, text string")
    got = si.lexical_search(si.open_index(spark, path, fields), queries).collect()
    assert [(r.id, r["rank"]) for r in got] == [("a", 1)]


def test_chunks_join_again(spark):
    texts = [(1, "abcdefghij" * 97 + "😀é"), (2, ""), (3, None), (4, "\n" * 13)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for size, overlap in ((7, 0), (7, 3), (10, 9), (800, 200)):
        got = {}
        for r in rt.chunks(df, size, overlap).collect():
            got.setdefault(r.doc_id, {})[r.chunk] = (r.start_at, r.piece)
        for doc_id, text in texts:
            starts = range(0, max(len(text or ""), 1), size - overlap)
            assert [got[doc_id][n] for n in sorted(got[doc_id])] == [(s, (text or "")[s:s + size]) for s in starts]


def test_work_id_needs_a_real_day(spark):
    ids = {"WRK-AB-20240229-001": True, "WRK-AB-20230229-001": False, "WRK-AB-20240101-000": False, "WRK-A-B1-20240101-1234": True, "WRK-ab-20240101-001": False}
    df = spark.createDataFrame([(i,) for i in ids], "i string")
    got = {r.i: r.valid for r in df.select("i", work.work_id_parts(F.col("i"))["valid"].alias("valid")).collect()}
    assert got == ids


def test_work_export_document(spark):
    rows = {name: [] for name in bundles.v.WORK_TABLES}
    rows["projects"] = [{"project_id": "p", "code": "P", "name": "n", "summary": None, "created_at": "2024", "updated_at": "2024"}]
    good, bad = {"format": "f", **rows}, {"format": "f", **rows, "extra": []}
    path = scratch_path(spark, "documents")
    spark.createDataFrame([(json.dumps(good),), (json.dumps(bad),)], "value string").repartition(2).write.text(path)
    documents = bundles.work_documents(spark, path)
    assert sorted(r.keys_ok for r in documents.collect()) == [False, True]
    back = bundles.work_rows(documents, "projects").collect()
    assert [(r.project_id, r.fields_ok) for r in back] == [("p", True)]


def test_schemas_refuse_or_fill_up(spark):
    from attesta.sources import schemas
    old = spark.createDataFrame([("r1", "SUPPORTS", "a", "b")], "relation_id string, relation_type string, from_item_id string, to_item_id string")
    with pytest.raises(schemas.SchemaMismatch, match="missing scope"):
        schemas.require(old, schemas.REF_RELATIONS)
    full = schemas.filled_up(old, schemas.REF_RELATIONS)
    assert schemas.require(full, schemas.REF_RELATIONS).first().to_item_id == "b"
    with pytest.raises(schemas.SchemaMismatch, match="unknown extra"):
        schemas.filled_up(old.withColumn("extra", F.lit(1)), schemas.REF_RELATIONS)
    assert len(schemas.REF_SOURCES) == 17 and len(schemas.WORK["items"]) == 19


def test_links_and_sources_of_work(spark):
    rows = spark.createDataFrame([("a", "a", "RELATED_TO"), ("a", "b", "LIKES"), ("a", "b", "SUPERSEDES")],
                                 "from_work_id string, to_work_id string, relation_type string").withColumn("k", F.concat_ws("-", "*"))
    got = {(r.key, r.rule) for r in violations(rows, F.col("k"), work.relation_rules()).collect()}
    assert got == {("a-a-RELATED_TO", "SELF_RELATION"), ("a-b-LIKES", "UNKNOWN_RELATION_TYPE")}
    sources = spark.createDataFrame([("s", "GITHUB", "PRIMARY", " "), ("t", "MOON", "BOSS", "x")], "source_id string, surface string, role string, locator string")
    got = {(r.key, r.rule) for r in violations(sources, F.col("source_id"), work.source_rules()).collect()}
    assert got == {("s", "LOCATOR_REQUIRED"), ("t", "UNKNOWN_SURFACE"), ("t", "UNKNOWN_ROLE")}


def test_lineage_chains(spark):
    """A long chain beyond the bound, a star, a circle with a way into it, a missing successor, a loop of one."""
    after = {f"n{i}": f"n{i + 1}" for i in range(70)} | {f"s{i}": "n60" for i in range(40)}
    after |= {"c0": "c1", "c1": "c2", "c2": "c0", "way": "c1", "lost": "nowhere", "self": "self", "n70": None}
    links = spark.createDataFrame(list(after.items()), "item_id string, superseded_by string")
    got = {}
    for r in versions.lineage_chains(links).collect():
        got.setdefault(r.item_id, {})[r.hop] = (r.newer_id, r.repeats)
    for start in after:
        want, at, seen = [], start, {start}
        while after[at] in after and len(want) < 50:
            at = after[at]
            want.append((at, at in seen))
            seen.add(at)
        assert [got.get(start, {})[h] for h in sorted(got.get(start, {}))] == want, start


def test_lineage_chains_move_each_row_once_a_round(spark, monkeypatch):
    """No side of a join is repeated, and a chain that has come to its end asks for nothing more."""
    asked = []

    def counted(fact, dim, on, spread_by, how="left", salts=8):
        asked.append((salts, fact.count()))
        return lookup_join(fact, dim, on, spread_by, how, salts)

    monkeypatch.setattr(versions, "lookup_join", counted)
    links = spark.createDataFrame([(i, i + 1 if i % 10 != 9 else None) for i in range(100)], "item_id long, superseded_by long")
    assert versions.lineage_chains(links).count() == 10 * sum(range(10))
    assert [salts for salts, _ in asked] == [1] * len(asked)
    assert [rows for _, rows in asked] == [100, 90, 80, 60, 20]


VERSIONS = [("ca", "ca@1", "ca@1", False), ("ca", "ca@2", "ca", True), ("cb", "cb@1", "cb", True), ("cc", "cc@1", "cc", True)]
# the last two rows repeat; two ends without a pin, one of them of an unknown item
RELATIONS = [("e1", "S", "ca@2", "ca", "cb@1", "cb"), ("e2", "S", "ca@1", "ca@1", "cb@1", "cb"), ("e3", "R", "ca@2", "ca", None, "cc"),
             ("e4", "R", None, "cb", "ca@1", "ca"), ("e5", "R", None, None, None, "zz"), ("e6", "S", "cc@1", "cc", None, None),
             ("e7", "S", "cb@1", "cb", "ca@2", "ca"), ("e7", "S", "cb@1", "cb", "ca@2", "ca")]


def version_tables(spark):
    rows = spark.createDataFrame(VERSIONS, "logical_item_id string, version_id string, item_id string, is_current_version boolean")
    relations = spark.createDataFrame(RELATIONS, "edge_id string, relation_type string, from_version_id string, from_item_id string, "
                                                 "to_version_id string, to_item_id string")
    return rows, relations


def edges_by_definition():
    """(logical item, direction, edge, type) of the current versions, once for each relation."""
    for edge, kind, from_pin, from_item, to_pin, to_item in RELATIONS:
        for logical, version, item, current in VERSIONS:
            if current:
                yield from [(logical, "outgoing", edge, kind)] * (from_pin == version) + [(logical, "incoming", edge, kind)] * (to_pin == version)
                yield from [(logical, "unpinned", edge, kind)] * ((from_pin is None and from_item == item) + (to_pin is None and to_item == item))


def counting(monkeypatch, least):
    """How many rows of facts of ``least`` rows or more are joined from now on."""
    joined = []

    def counted(fact, dim, on, spread_by, how="left", salts=8):
        n = fact.count()
        joined.extend([n] * (n >= least))
        return lookup_join(fact, dim, on, spread_by, how, salts)

    monkeypatch.setattr(versions, "lookup_join", counted)
    return joined


def test_edges_of_versions_from_marked_pins(spark, monkeypatch):
    """Marked pins and unmarked relations give the edges of the definition; with marks, no relation is joined but the loose ones."""
    rows, relations = version_tables(spark)
    wanted = rows.where("is_current_version")
    want = sorted(edges_by_definition())
    marked = versions.mark_pins(versions.mark_pins(relations, wanted, "edge_id", "from"), wanted, "edge_id", "to")
    joined = counting(monkeypatch, len(RELATIONS))
    for given, joins in ((marked, 0), (relations, 2)):
        trace = versions.trace(rows, given, "edge_id")
        assert sorted(map(tuple, trace.where("part <> 'version'").select("logical_item_id", "part", "ref", "detail").collect())) == want
        assert trace.where("part = 'version'").count() == len(VERSIONS)
        edges = versions.edge_directions(given, wanted, "edge_id")
        assert sorted(map(tuple, edges.collect())) == sorted({(edge, part) for _, part, edge, _ in want})
        assert len(joined) == 2 * joins
        joined.clear()


def test_pins_are_resolved_at_one_end(spark):
    rows, relations = version_tables(spark)
    rows = rows.withColumn("lifecycle", F.when(F.col("is_current_version"), "ACTIVE").otherwise("SUPERSEDED"))
    both = versions.resolve_endpoints(relations, rows, "edge_id")
    start = versions.resolve_endpoints(relations.select("from_version_id").distinct(), rows, "from_version_id", ("from",))
    shown = ["edge_id", "from_logical_id", "from_lifecycle", "from_unresolved"]
    again = relations.alias("r").join(start.alias("s"), F.col("r.from_version_id").eqNullSafe(F.col("s.from_version_id")))
    assert sorted(map(repr, both.select(*shown).collect())) == sorted(map(repr, again.select(*shown).collect()))
    assert "to_logical_id" not in start.columns


def test_only_asked_rows_are_stored(spark):
    fact = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "id long, k string")
    dim = spark.createDataFrame([("a", 1), ("a", 2), ("c", 3), (None, 4)], "k string, v long")
    assert sorted(map(tuple, asked_rows(dim, fact, ["k"]).collect())) == [("a", 1), ("a", 2)]


def test_touching_moves_relations_once_by_their_start(spark):
    """Edges with a wanted end, once for each row, with ends that are missing; one exchange serves both outgoing and other edges."""
    ends = [("a", "b"), ("b", "a"), ("a", None), (None, "a"), ("b", "c"), (None, None), ("c", "c"), ("d", "a"), ("d", "a")]
    relations = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "edge long, start string, end string")
    wanted = spark.createDataFrame([("a",), ("c",), ("a",), (None,)], "item string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for key, value in zip(before, ("-1", "false")):
            spark.conf.set(key, value)
        found = versions.touching(relations, wanted, "edge", "start", "end", "item")
        assert sorted(r.edge for r in found.collect()) == [i for i, e in enumerate(ends) if "a" in e or "c" in e]
        plan = found._jdf.queryExecution().executedPlan().toString()
        moved = plan.count("ReusedExchange [edge")
        assert moved == 1, plan
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_files_of_lines_are_bounded_and_hashed_one_by_one(spark):
    """A reader that takes whole files meets none of more rows than asked, whatever the number of tasks that wrote them."""
    import hashlib
    rows = spark.range(25).select(F.concat(F.lit("line "), "id").alias("value")).coalesce(1)
    path = bundles.write_lines(rows, "bounded", 10)
    digests = {r.name: r for r in bundles.file_digests(spark, f"{path}/part-*").collect()}
    counts = {r.f.rsplit("/", 1)[-1]: r.n for r in spark.read.text(path).groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n")).collect()}
    assert sorted(counts.values()) == [5, 10, 10]
    assert set(digests) == set(counts)
    for name, row in digests.items():
        with open(f"{path}/{name}", "rb") as f:
            assert row.actual == hashlib.sha256(f.read()).hexdigest()


def test_labels_of_claims_without_texts_are_not_sent_to_the_driver(spark, tmp_path):
    spark.createDataFrame([(1, "t", "en", "src1"), (2, "t", "de", "src2")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    from attesta.sources.lake import Lake
    items = Lake(spark, str(tmp_path)).raw_items(False)
    assert "BroadcastExchange" not in items._sc._jvm.PythonSQLUtils.explainString(items._jdf.queryExecution(), "simple")
    assert {r.item_id: r.item_type for r in items.collect()} == {"d1": "UNKNOWN", "d2": "RESEARCH_RESULT"}
