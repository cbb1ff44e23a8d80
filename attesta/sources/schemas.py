"""Fixed schemas of the domain tables; a table that differs is refused, older reference tables are filled up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions import vocabulary as v


def _texts(names: list[str], **other: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, other.get(n, T.StringType())) for n in names])


_SEED = ["seed_id", "first_seed_version", "last_seed_version", "record_hash"]
REF_SOURCES = _texts(["source_id", *v.SOURCE_CONTENT, *_SEED, "imported_at"], imported_at=T.TimestampType())
REF_ITEMS = _texts(
    ["item_id", *v.ITEM_CONTENT, "created_at", "lifecycle", "superseded_by", *_SEED,
     *[f"{f}_at_capture" for f in v.CAPTURE], "capture_backfilled", "logical_item_id", "version_id"],
    confidence=T.DoubleType(), created_at=T.TimestampType(), capture_backfilled=T.BooleanType())
REF_RELATIONS = _texts(
    ["relation_id", *v.RELATION_CONTENT, "seed_id", "created_at", "record_hash", "from_version_id", "to_version_id",
     "pin_backfilled"], created_at=T.TimestampType(), pin_backfilled=T.BooleanType())
WORK = {name: _texts(columns, non_canon=T.BooleanType(), is_primary=T.BooleanType()) for name, columns in v.WORK_TABLES.items()}


class SchemaMismatch(ValueError):
    """The table has other columns or types than its schema."""


def require(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The same table, or an error that names every difference."""
    have = {f.name: f.dataType for f in df.schema}
    want = {f.name: f.dataType for f in schema}
    problems = [f"missing {n}" for n in want if n not in have] + [f"unknown {n}" for n in have if n not in want]
    problems += [f"{n} is {have[n].simpleString()}, not {want[n].simpleString()}" for n in want if n in have and have[n] != want[n]]
    if problems:
        raise SchemaMismatch("; ".join(problems))
    return df.select(*want)


def filled_up(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Additive evolution of the reference tables: columns a stored table does not know yet are added as null."""
    unknown = [n for n in df.columns if n not in schema.names]
    if unknown:
        raise SchemaMismatch(f"unknown {', '.join(unknown)}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
