"""All-or-nothing imports: compare, check, write a new snapshot, publish last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.plans.scale import one_row_flag
from attesta.session import scratch_path


class ImportRefused(Exception):
    """The import has errors; nothing was written."""


def import_conflicts(stored: DataFrame, incoming: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys present on both sides with different content: any one of them refuses the whole import."""
    old = stored.select(*keys, F.struct(*columns).alias("old"))
    new = incoming.select(*keys, F.struct(*columns).alias("new"))
    return old.join(new, keys, "inner").where(~F.col("old").eqNullSafe(F.col("new"))).select(*keys)


def merge_items(old: DataFrame, new: DataFrame, archived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New current rows and the archive after an import.

    ``old`` and ``new`` hold (item_id, record_hash, content struct, capture struct, lifecycle).  An unchanged
    item keeps its first capture; a revised one is archived as ``item@hash`` and never revived when it was
    superseded; items the bundle does not name stay as they are.
    """
    joined = old.alias("o").join(new.alias("n"), F.col("o.item_id") == F.col("n.item_id"), "full_outer")
    inserted = F.col("o.item_id").isNull()
    kept = F.col("n.item_id").isNull() | (F.col("o.record_hash") == F.col("n.record_hash"))
    take_old = ~inserted & kept
    lifecycle = (F.when(inserted, F.coalesce("n.lifecycle", F.lit("ACTIVE")))
                 .when(take_old | (F.col("o.lifecycle") == "SUPERSEDED"), F.col("o.lifecycle"))
                 .otherwise(F.coalesce("n.lifecycle", F.lit("ACTIVE"))))
    outcome = (F.when(inserted, "inserted").when(F.col("n.item_id").isNull(), "untouched").when(kept, "unchanged")
               .otherwise("revised"))
    current = joined.select(
        F.coalesce("o.item_id", "n.item_id").alias("item_id"),
        *[F.when(take_old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c) for c in ("record_hash", "content", "capture")],
        lifecycle.alias("lifecycle"), outcome.alias("outcome"))
    moved = joined.where(~inserted & ~kept).select(
        F.concat("o.item_id", F.lit("@"), F.substring("o.record_hash", 1, 14)).alias("item_id"),
        F.col("o.record_hash").alias("record_hash"), F.col("o.content").alias("content"),
        F.col("o.capture").alias("capture"), F.lit("SUPERSEDED").alias("lifecycle"),
        F.col("o.item_id").alias("superseded_by"))
    fresh = moved.join(archived.select("item_id"), "item_id", "left_anti")
    return current, archived.unionByName(fresh)


def merge_relations(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Relations are stored once; the pins of the first import stay."""
    return stored.unionByName(incoming.join(stored.select("relation_id"), "relation_id", "left_anti"))


def relation_revisions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Known relations with other content, or with other explicit pins: both are rejected."""
    old = stored.select("relation_id", F.col("record_hash").alias("old_hash"), F.col("from_version_id").alias("old_from"),
                        F.col("to_version_id").alias("old_to"))
    joined = incoming.join(old, "relation_id", "inner")
    moved = ((F.col("from_version_id").isNotNull() & (F.col("from_version_id") != F.col("old_from")))
             | (F.col("to_version_id").isNotNull() & (F.col("to_version_id") != F.col("old_to"))))
    rule = (F.when(F.col("record_hash") != F.col("old_hash"), "RELATION_REVISED")
            .when(F.coalesce(moved, F.lit(False)), "RELATION_REPINNED"))
    return joined.withColumn("rule", rule).where(F.col("rule").isNotNull()).select("relation_id", "rule")


def restored_meta(existing: DataFrame, bundle: DataFrame) -> DataFrame:
    """A restored export fills settings only where they are absent; the schema version is never taken over."""
    new = bundle.where(F.col("key") != "schema_version").select("key", F.col("value").alias("new_value"))
    return existing.join(new, "key", "full_outer").select("key", F.coalesce("value", "new_value").alias("value"))


# ---- commit -----------------------------------------------------------------
def commit(tables: dict[str, DataFrame], errors: DataFrame, root: str, base: str | None = None,
           expected: str | None = None) -> str:
    """Write a new snapshot and publish its pointer last.

    Any error row, or a base other than the expected one, refuses the import and leaves the published
    snapshot as it is.  A job that dies half way leaves an unpublished folder only.
    """
    first = errors.limit(1).take(1)
    if first:
        raise ImportRefused(f"import refused: {first[0].asDict()}")
    if expected is not None and base != expected:
        raise ImportRefused(f"import refused: based on {base}, published is {expected}")
    spark = errors.sparkSession
    snapshot = scratch_path(spark, "snapshot")
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{snapshot}/{name}")
    publish(spark, root, snapshot)
    return snapshot


def publish(spark: SparkSession, root: str, snapshot: str) -> None:
    """One small row appended; readers take the newest pointer."""
    pointer = spark.range(1).select(F.lit(snapshot).alias("snapshot"), F.current_timestamp().alias("published_at"))
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/pointers")


def published(spark: SparkSession, root: str) -> str | None:
    """Path of the newest published snapshot (at most one row is fetched)."""
    rows = spark.read.parquet(f"{root}/pointers").agg(F.max_by("snapshot", "published_at").alias("s")).take(1)
    return rows[0]["s"] if rows else None


def publish_if_valid(candidate: DataFrame, violations: DataFrame, root: str, last_good: str | None) -> tuple[str | None, str]:
    """Keep the last good snapshot when the candidate is invalid: fresh, stale or none."""
    spark = candidate.sparkSession
    if one_row_flag(violations):
        return last_good, "stale" if last_good else "none"
    snapshot = scratch_path(spark, "candidate")
    candidate.write.mode("errorifexists").parquet(snapshot)
    publish(spark, root, snapshot)
    return snapshot, "fresh"
