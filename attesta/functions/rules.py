"""Rule tables: each rule is a code, a severity and a condition; a job returns the rows that break one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    code: str
    broken: Column
    severity: str = "ERROR"


def violations(df: DataFrame, key: Column, rules: list[Rule]) -> DataFrame:
    """All broken rules as (rule, severity, key), in one pass and without a shuffle."""
    hits = F.filter(
        F.array(*[F.when(F.coalesce(r.broken, F.lit(False)),
                         F.struct(F.lit(r.code).alias("rule"), F.lit(r.severity).alias("severity")))
                  for r in rules]),
        lambda hit: hit.isNotNull())
    return df.select(key.cast("string").alias("key"), F.explode(hits).alias("hit")).select(
        "hit.rule", "hit.severity", "key")


def first_violation(rules: list[Rule], passed: str) -> Column:
    """Code of the first broken rule of a ladder, or ``passed``."""
    return F.coalesce(*[F.when(F.coalesce(r.broken, F.lit(False)), F.lit(r.code)) for r in rules], F.lit(passed))


def missing(name: str) -> Column:
    return F.col(name).isNull() | (F.col(name) == "")


def outside(name: str, allowed: list[str]) -> Column:
    """Present but not one of the allowed values."""
    return F.col(name).isNotNull() & ~F.col(name).isin(allowed)
