"""Building blocks that keep plans flat when one key holds a large share of all rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.session import written


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int,
                    rank_name: str = "rank") -> DataFrame:
    """First ``k`` rows of each group.

    The filter on ``row_number`` lets Spark cut every task to ``k`` rows per group before the
    shuffle (WindowGroupLimit), so a hot group sends only ``k`` rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank_name, F.row_number().over(window)).where(F.col(rank_name) <= k)
    return ranked.withColumn(rank_name, F.col(rank_name).cast("long"))


def lookup_join(fact: DataFrame, dim: DataFrame, on: list[str], spread_by: list[str],
                how: str = "left", salts: int = 8) -> DataFrame:
    """Join a large table to one row per key without sending a hot key to one task.

    The fact side is spread over ``salts`` by a hash of its own row key (stable when a task is
    retried) and the dimension is repeated once per salt.  Adaptive execution turns this into a
    broadcast when the measured dimension is below the broadcast threshold.

    ``salts=1`` is for dimensions about as large as the fact side, where repeating them would cost more
    than the join: there the hot partitions of the fact side are split by the adaptive skew join.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"lookup_join cannot repeat the right side for {how}")
    if salts == 1:
        return fact.join(dim, on, how)
    salted_fact = fact.withColumn("__salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    salted_dim = dim.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted_fact.join(salted_dim, [*on, "__salt"], how).drop("__salt")


def never_sent(dim: DataFrame) -> DataFrame:
    """``dim`` as the side of a join that is never a broadcast.

    A side that is read from a stored table is estimated by its compressed files: millions of ids are a few megabytes
    there and hundreds on the driver, and a broadcast that is planned by the estimate is not given up for a measured size.
    """
    return dim.hint("merge")


def asked_rows(dim: DataFrame, fact: DataFrame, on: list[str]) -> DataFrame:
    """The rows of a large ``dim`` that some row of ``fact`` asks for, stored.

    For keys that many rows of ``fact`` share: only the different keys are moved to find them.  The stored table has a
    known size, so a join with few rows of it is a broadcast and ``fact`` stays where it is; with many, it is an
    ordinary join.
    """
    return written(dim.join(fact.select(*on).distinct(), on, "left_semi"), "asked-rows")


@dataclass(frozen=True)
class Running:
    """One running value: ``last`` keeps the last non-null value, ``sum`` adds, ``max`` keeps the largest."""

    kind: str
    value: Column
    inclusive: bool = False


def _combine(kind: str, value: Column) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True)
    if kind == "sum":
        return F.sum(value)
    if kind == "max":
        return F.max(value)
    raise ValueError(f"unknown running value {kind}")


def running_values(df: DataFrame, keys: list[str], order: list[str], outputs: dict[str, Running],
                   levels: list[list[str]], reverse: bool = False, stored: bool = False) -> DataFrame:
    """Window values over the rows before (or after) each row, exact for keys of any size.

    Rows are cut into (key, bucket): each task sorts one bucket only, what earlier buckets contribute is one
    partially aggregated row per bucket, carried over the buckets of the key by the next coarser level, and joined
    back.  It is one plan for keys of every size; no job runs while it is built.

    A missing key is a key, and a missing bucket a bucket, like any other.  ``levels`` lists bucket columns from fine to
    coarse; the buckets must follow ``order`` and the columns of a coarser level must be among those of the finer
    one.  Without levels it is a plain window.  ``stored`` says that ``df`` is read from a stored table (``never_sent``).
    """
    specs = {n: (o.kind, o.inclusive, o.value) for n, o in outputs.items()}
    return _running(df, keys, order, specs, levels, reverse, stored).select(*df.columns, *outputs)


def _running(df, keys, order, specs, levels, reverse, stored):
    bucket = levels[0] if levels else []
    inputs = {f"__in_{n}": value for n, (_, _, value) in specs.items()}
    if bucket:
        position = F.struct(*order)
        pick = F.min_by if reverse else F.max_by
        totals = []
        for name, (kind, _, _) in specs.items():
            value = F.col(f"__in_{name}")
            if kind == "last":
                total = pick(value, F.when(value.isNotNull(), position))
            else:
                total = _combine(kind, value)
            totals.append(total.alias(f"__in_{name}"))
        per_bucket = df.withColumns(inputs).groupBy(*keys, *bucket).agg(*totals)
        carried = _running(per_bucket, keys, bucket, {n: (kind, False, F.col(f"__in_{n}")) for n, (kind, _, _) in specs.items()},
                           levels[1:], reverse, stored)
        # a bucket may be null (an order value is missing): it is one bucket like any other
        carried = carried.select(*[F.col(c).alias(f"__key_{c}") for c in (*keys, *bucket)],
                                 *[F.col(n).alias(f"__carry_{n}") for n in specs])
        same = [F.col(c).eqNullSafe(F.col(f"__key_{c}")) for c in (*keys, *bucket)]
        df = df.join(never_sent(carried) if stored else carried, same, "left").drop(*[f"__key_{c}" for c in (*keys, *bucket)])
    # the values are made where the rows are sorted, after the exchange: they do not travel beside what they are made of
    df = df.withColumns(inputs)
    direction = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    window = Window.partitionBy(*keys, *bucket).orderBy(*direction)
    columns = []
    for name, (kind, inclusive, _) in specs.items():
        end = Window.currentRow if inclusive else -1
        inside = _combine(kind, F.col(f"__in_{name}")).over(
            window.rowsBetween(Window.unboundedPreceding, end))
        if bucket:
            carry = F.col(f"__carry_{name}")
            if kind == "last":
                value = F.coalesce(inside, carry)
            elif kind == "sum":
                value = F.when(inside.isNull() & carry.isNull(), F.lit(None)).otherwise(
                    F.coalesce(inside, F.lit(0)) + F.coalesce(carry, F.lit(0)))
            else:
                value = F.greatest(inside, carry)
        else:
            value = inside
        columns.append(value.alias(name))
    kept = [c for c in df.columns if not c.startswith("__carry_")]
    return df.select(*[F.col(c) for c in kept], *columns)


def one_row_flag(df: DataFrame) -> bool:
    """Is there any row?  Fetches at most one row."""
    return len(df.limit(1).take(1)) > 0
