"""Terms counted inside their row, and together where rows share a key."""

from collections import Counter

from pyspark.sql import functions as F

from attesta.operators import retrieval as rt

ROWS = [(1, "b a b"), (2, ""), (3, None), (4, "a"), (5, "x x x"), (7, "a b"), (7, "b c"), (None, "n"), (None, "n m"), (9, "É é e")]


def test_terms_of_single_and_repeated_keys(spark):
    rows = spark.createDataFrame(ROWS, "id long, text string")
    got = rt.postings(rows, "id", F.col("text"))
    assert got.columns == ["term", "item_id", "tf"]
    want = Counter((t, i) for i, text in ROWS for t in (text or "").lower().replace("é", "e").split())
    assert sorted(map(str, got.collect())) == sorted(
        f"Row(term={t!r}, item_id={i}, tf={n})" for (t, i), n in want.items())


def test_terms_of_single_keys_are_not_moved(spark):
    rows = spark.range(40).select("id", F.concat_ws(" ", F.lit("a b b"), "id").alias("text"))
    plan = rt.postings(rows, "id", F.col("text"))._jdf.queryExecution().optimizedPlan().toString()
    counted = [line for line in plan.splitlines() if "Aggregate" in line]
    # the only aggregate over terms stands above the rows of repeated keys
    assert len(counted) == 1 and "LeftSemi" in plan.split(counted[0])[1]
    assert "LeftAnti" in plan and "LeftAnti" not in plan.split(counted[0])[1]
