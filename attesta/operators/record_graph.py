"""Rules over the graph of a record set: ids, references, supersession in both directions, cycles, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.rules import Rule, violations
from attesta.operators.versions import lineage_chains
from attesta.plans.scale import lookup_join, never_sent


def _found(df: DataFrame, rule: str, key: str, severity: str = "ERROR") -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col(key).cast("string").alias("key"))


def provenance_rules(allowed: list[str], user_provenance: str, user_kind: str) -> list[Rule]:
    """The user's words need the user's source; another provenance of that source is a warning.  Needs ``known_kind``."""
    named, from_user = F.col("provenance") == user_provenance, F.col("known_kind") == user_kind
    return [
        Rule("UNKNOWN_PROVENANCE", ~F.coalesce(F.col("provenance").isin(allowed), F.lit(False))),
        Rule("USER_PROVENANCE_OF_OTHER_SOURCE", named & F.col("known_kind").isNotNull() & ~from_user),
        Rule("USER_SOURCE_WITH_OTHER_PROVENANCE", from_user & ~F.coalesce(named, F.lit(False)), "WARNING"),
    ]


def duplicate_ids(records: DataFrame) -> DataFrame:
    return records.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def lost_references(records: DataFrame) -> DataFrame:
    """``related_to`` (an array), ``supersedes`` and ``superseded_by`` that name no record: (rule, id, target)."""
    def ref(rule: str, target: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), target.alias("target"))

    related = F.transform(F.coalesce("related_to", F.array().cast(records.schema["related_to"].dataType)),
                          lambda t: ref("RELATED_TO_MISSING", t))
    single = F.array(ref("SUPERSEDES_MISSING", F.col("supersedes")), ref("SUPERSEDED_BY_MISSING", F.col("superseded_by")))
    named = records.select("id", F.explode(F.concat(related, single)).alias("ref")).select("id", "ref.*").where(F.col("target").isNotNull())
    known = records.select(F.col("id").alias("target")).distinct().withColumn("known", F.lit(True))
    return lookup_join(named, never_sent(known), ["target"], ["id", "target"], salts=1).where(F.col("known").isNull()).drop("known")


def one_sided_supersession(records: DataFrame) -> DataFrame:
    """Edges (older, newer) that only one of the two declares, where both exist.

    Both directions become the same edge, and one aggregate over the edges shows which side is missing.
    """
    ids = records.select(F.col("id").alias("other")).distinct().withColumn("known", F.lit(True))
    by_older = records.where(F.col("superseded_by").isNotNull()).select(
        F.col("id").alias("older"), F.col("superseded_by").alias("newer"), F.lit(1).alias("from_older"), F.col("superseded_by").alias("other"))
    by_newer = records.where(F.col("supersedes").isNotNull()).select(
        F.col("supersedes").alias("older"), F.col("id").alias("newer"), F.lit(0).alias("from_older"), F.col("supersedes").alias("other"))
    edges = lookup_join(by_older.unionByName(by_newer), never_sent(ids), ["other"], ["older", "newer"], "left_semi", salts=1)
    sides = edges.groupBy("older", "newer").agg(F.max("from_older").alias("older_says"), F.min("from_older").alias("newer_silent"))
    return sides.where("older_says = newer_silent").select(
        "older", "newer", F.when(F.col("older_says") == 1, "SUCCESSOR_DOES_NOT_SAY_SO").otherwise("PREDECESSOR_DOES_NOT_SAY_SO").alias("rule"),
        F.when(F.col("older_says") == 1, F.col("older")).otherwise(F.col("newer")).alias("id"))


def supersession_cycles(records: DataFrame, max_hops: int = 50) -> DataFrame:
    """Records that come back to themselves along ``superseded_by``, with the length of the way."""
    links = records.where(F.col("superseded_by").isNotNull()).select(F.col("id").alias("item_id"), "superseded_by").distinct()
    # one successor of a record follows it; that an id has two rows is a fault of its own
    links = links.groupBy("item_id").agg(F.min("superseded_by").alias("superseded_by"))
    back = lineage_chains(links, max_hops).where(F.col("newer_id") == F.col("item_id"))
    return back.groupBy(F.col("item_id").alias("id")).agg(F.min("hop").alias("length"))


def graph_violations(records: DataFrame, rules: list[Rule]) -> DataFrame:
    """All findings as (rule, severity, key): row rules and rules over the graph."""
    out = violations(records, F.col("id"), rules)
    out = out.unionByName(_found(duplicate_ids(records), "DUPLICATE_ID", "id"))
    lost = lost_references(records)
    out = out.unionByName(lost.select("rule", F.lit("ERROR").alias("severity"), F.col("id").cast("string").alias("key")))
    sides = one_sided_supersession(records)
    out = out.unionByName(sides.select("rule", F.lit("ERROR").alias("severity"), F.col("id").cast("string").alias("key")))
    return out.unionByName(_found(supersession_cycles(records), "SUPERSESSION_CYCLE", "id"))
