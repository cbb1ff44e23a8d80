"""Fingerprints of tables that take added and removed rows, and checksum lists of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTS = ["s0", "s1", "s2", "s3"]
STEPS = 2.0 ** 40
EXACT_BELOW = 2.0 ** 22


def _number_text(value: Column) -> Column:
    """A binary fraction as whole steps of 2^-40: exact for the usual magnitudes, and the same text in every engine."""
    steps = F.floor(value.cast("double") * F.lit(STEPS)).cast("string")
    return F.when(F.abs(value) < EXACT_BELOW, steps).otherwise(value.cast("string"))


def value_text(value: Column, kind: T.DataType) -> Column:
    """Text of one value that does not depend on the session: times as microseconds, arrays as their members' texts."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return _number_text(value)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp")).cast("string")
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(value, lambda x: _sized(value_text(x, kind.elementType))), "")
    if isinstance(kind, T.StructType):
        return F.concat(*[_sized(value_text(value[f.name], f.dataType)) for f in kind.fields])
    if isinstance(kind, T.MapType):
        return value_text(F.array_sort(F.map_entries(value)), T.ArrayType(T.StructType(
            [T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
    if isinstance(kind, T.BinaryType):
        return F.hex(value)
    return value.cast("string")


def _sized(text: Column) -> Column:
    """The text behind its length, so that neighbours cannot run together; a missing one is a mark of its own."""
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 over the sized texts of the columns (all of them by default), in their order."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    return F.sha2(F.concat(*[_sized(value_text(F.col(f"`{c}`"), kinds[c])) for c in columns or df.columns]), 256)


def table_sums(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: the number of rows and four exact sums over their hashes.  Order and partitioning do not matter."""
    hashed = df.select(row_hash(df, columns).alias("h"))
    part = [F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(len(PARTS))]
    sums = [F.coalesce(F.sum(p).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias(n) for n, p in zip(PARTS, part)]
    return hashed.agg(F.count("*").alias("rows"), *sums)


def updated_sums(stored: DataFrame, added: DataFrame, removed: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Sums of a table after rows came and went.  Only those rows are read; a changed row is removed and added."""
    columns = columns or added.columns
    minus = table_sums(removed, columns).select((-F.col("rows")).alias("rows"), *[(-F.col(p)).alias(p) for p in PARTS])
    every = stored.select("rows", *PARTS).unionByName(table_sums(added, columns)).unionByName(minus)
    return every.agg(F.sum("rows").alias("rows"), *[F.sum(p).cast("decimal(38,0)").alias(p) for p in PARTS])


def digest(sums: DataFrame) -> DataFrame:
    """(row_count, digest) of sums."""
    return sums.select(F.col("rows").alias("row_count"), F.concat_ws("-", *[F.col(p).cast("string") for p in PARTS]).alias("digest"))


# ---- files ------------------------------------------------------------------
def write_blocks(lines: DataFrame, block: str, order: list[str], path: str) -> None:
    """One text file per block, its lines in order; a block is written by one task, so blocks are chosen small."""
    sorted_lines = lines.repartition(block).sortWithinPartitions(block, *order)
    sorted_lines.select(block, "value").write.mode("errorifexists").partitionBy(block).text(path)


def block_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of the bytes of each file below ``path``, by the name of its folder, hashed inside the tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -2).alias("name"), F.sha2("content", 256).alias("actual"),
                        F.col("length").alias("bytes"))


def write_checksums(listed: DataFrame, path: str) -> None:
    """(name, expected) as lines of a checksum list: the digest, two blanks, the name."""
    listed.select(F.concat_ws("  ", "expected", "name").alias("value")).write.mode("errorifexists").text(path)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(name, expected) of a checksum list; a binary mark before the name is dropped, other lines are no entries."""
    line = r"^([0-9a-fA-F]{64}) [ *](.+)$"
    rows = spark.read.text(path).where(F.col("value").rlike(line))
    return rows.select(F.regexp_extract("value", line, 2).alias("name"), F.lower(F.regexp_extract("value", line, 1)).alias("expected"))


def verified(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """MATCH, MISMATCH, NOT_RECOVERED for a listed file that is not there, NOT_LISTED for a file without an entry."""
    status = (F.when(F.col("actual").isNull(), "NOT_RECOVERED").when(F.col("expected").isNull(), "NOT_LISTED")
              .when(F.col("actual") == F.col("expected"), "MATCH").otherwise("MISMATCH"))
    return expected.join(actual, "name", "full_outer").select("name", "expected", "actual", "bytes", status.alias("status"))
