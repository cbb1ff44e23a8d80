"""The pipeline, stage by stage on what the stage before kept, against plain Python."""

from collections import Counter

import corpus_pipeline
from attesta.llm import mixing
from tests_llm_plain import plain_groups, plain_quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    given = {r.doc_id: r for r in docs.collect()}
    kept = None
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        result = stage(spark, docs, SF)
        docs = spark.createDataFrame(result.collect(), result.schema)
        rows = docs.collect()
        ids = Counter(r.doc_id for r in rows)
        if name != "encode_pieces":
            assert docs.columns == columns
            assert all(r == given[r.doc_id] for r in rows)
        if name == "quality_rules":
            assert not any(plain_quality(given[i].text)["base_failed"] for i in ids)
            kept = set(ids)
        elif name == "exact_dedup":
            best = {}
            for i in kept:
                t = "".join(c.lower() if "A" <= c <= "Z" else c for c in given[i].text)
                best[t] = max(i, best.get(t, i))
            kept = set(best.values())
            assert set(ids) == kept and max(ids.values()) == 1
        elif name == "near_dedup":
            found = plain_groups([(i, given[i].text) for i in sorted(kept)], 5, 80)
            kept = {i for i, _, first in found if i == first}
            assert set(ids) == kept
        elif name == "mix_sources":
            taken = {r.doc_id: r.taken // max(r.size, 1) for r in mixing.mixed_sizes(before).collect()}
            assert ids == Counter({i: n for i, n in taken.items() if n})
            copies = ids
        else:
            assert ids == copies and all(r.round_trip and r.n_tokens == len(r.ids) > 0 for r in rows)
    assert corpus_pipeline.run(spark, SF).count() == sum(copies.values())


def test_stages_on_awkward_rows(spark, docs, empty):
    for table in (docs, empty):
        for name, stage in corpus_pipeline.STAGES:
            columns = table.columns
            result = stage(spark, table, SF)
            table = spark.createDataFrame(result.collect(), result.schema)
            if name != "encode_pieces":
                assert table.columns == columns
