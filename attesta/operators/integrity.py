"""Duplicate, conflict, reference and count checks that return rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.plans.scale import lookup_join


def duplicate_keys(df: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Keys that occur more than once, with the first line that carries them."""
    return (df.groupBy(*keys).agg(F.count("*").alias("copies"), F.min(line).alias("first_id"))
            .where(F.col("copies") > 1))


def conflicting_records(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys declared with two or more different contents.

    Counting in two steps keeps the state of a key with very many copies at its distinct contents.
    """
    contents = df.groupBy(*keys, "record_hash").agg(F.min("line").alias("line"))
    return (contents.groupBy(*keys).agg(F.count("*").alias("variants"), F.min("line").alias("first_line"))
            .where(F.col("variants") > 1))


def missing_references(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str,
                       row_key: str, salts: int = 1) -> DataFrame:
    """Rows whose reference names no parent; an empty reference is not a broken one."""
    known = parent.select(F.col(parent_key).alias(child_key))
    return lookup_join(child.where(F.col(child_key).isNotNull()), known, [child_key], [row_key], "left_anti", salts)


def present_in(rows: DataFrame, used: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Mark the rows whose key occurs in ``used``."""
    distinct = used.select(*keys).distinct().withColumn("__hit", F.lit(True))
    return rows.join(distinct, keys, "left").withColumn(flag, F.coalesce("__hit", F.lit(False))).drop("__hit")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table; every count is partially aggregated before it leaves a task."""
    parts = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def changed_rows(old: DataFrame, new: DataFrame, keys: list[str], frozen: list[str]) -> DataFrame:
    """Audit between two snapshots: rows that vanished and rows whose frozen columns moved."""
    before = old.select(*keys, F.struct(*frozen).alias("before"))
    after = new.select(*keys, F.struct(*frozen).alias("after"), F.lit(True).alias("kept"))
    joined = before.join(after, keys, "left")
    status = F.when(F.col("kept").isNull(), "DELETED").when(~F.col("before").eqNullSafe(F.col("after")), "MUTATED")
    return joined.withColumn("violation", status).where(F.col("violation").isNotNull()).select(*keys, "violation")
