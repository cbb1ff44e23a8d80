"""Readers and writers: JSON-line bundles, exports, packages, checksums and store profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions import vocabulary as v
from attesta.functions.text import json_value
from attesta.plans.scale import Running, lookup_join, running_values
from attesta.session import scratch_path, written

_TEXT = T.StringType()
# what an import or an export carries beside the content
SEED_FIELDS = ["seed_id", "first_seed_version", "last_seed_version"]
CAPTURED = [f"{field}_at_capture" for field in v.CAPTURE]
SOURCE_FIELDS = ["source_id", *v.SOURCE_CONTENT, *SEED_FIELDS]
ITEM_FIELDS = ["item_id", *v.ITEM_CONTENT, "lifecycle", "superseded_by", "logical_item_id", "version_id", *SEED_FIELDS, *CAPTURED,
               "capture_backfilled"]
RELATION_FIELDS = ["relation_id", *v.RELATION_CONTENT, "from_version_id", "to_version_id", "pin_backfilled", "seed_id"]
SOURCE_SCHEMA, ITEM_SCHEMA, RELATION_SCHEMA = (T.StructType([T.StructField(n, _TEXT) for n in fields])
                                               for fields in (SOURCE_FIELDS, ITEM_FIELDS, RELATION_FIELDS))
MANIFEST_SCHEMA = T.StructType([T.StructField(n, _TEXT) for n in
                                ["format", "kind", "seed_id", "seed_version", "seed_as_of", "privacy", "note"]])
BUNDLE_SCHEMA = T.StructType([T.StructField("manifest", MANIFEST_SCHEMA), T.StructField("source", SOURCE_SCHEMA),
                              T.StructField("item", ITEM_SCHEMA), T.StructField("relation", RELATION_SCHEMA)])


def bundle_lines(spark: SparkSession, path: str, by_folder: bool = False) -> DataFrame:
    """Lines of bundle files with bundle and line number.

    A bundle is a file, or with ``by_folder`` all files of a folder in the order of their names (as ``write_ordered``
    leaves them).  A file of any size is read in its splits: inside a split the rows keep their order, and the splits
    are put in order by file and by where they start, so the line number is a running count over all splits of the
    bundle and no file goes through one task.  Only one row for each split is moved for it; the lines are stored once
    and stay where they are.
    """
    file = F.col("_metadata.file_path")
    rows = spark.read.text(path).select(
        (F.regexp_replace(file, "/[^/]*$", "") if by_folder else file).alias("bundle"), file.alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"),
        F.trim("value").alias("raw"))
    rows = written(rows, "lines")
    splits = rows.groupBy("bundle", "file", "block").agg(F.min("place").alias("first"), F.count("*").alias("lines"))
    before = running_values(splits, ["bundle"], ["file", "block"], {"before": Running("sum", F.col("lines"))}, [])
    starts = written(before.select("file", "block", (F.coalesce("before", F.lit(0)) - F.col("first")).alias("shift")), "splits")
    return rows.join(starts, ["file", "block"]).select("bundle", (F.col("shift") + F.col("place") + 1).alias("line"), "raw")


def parse_lines(lines: DataFrame) -> DataFrame:
    """Parsed records; blank and comment lines are skipped and bad JSON becomes an error row."""
    kept = lines.where((F.col("raw") != "") & ~F.col("raw").startswith("//"))
    shape = json_value(F.col("raw"))
    record = F.from_json("raw", BUNDLE_SCHEMA)
    rows = kept.withColumn("is_json", shape.isNotNull()).withColumn("record", record)
    known = F.col("record.source").isNotNull() | F.col("record.item").isNotNull() | F.col("record.relation").isNotNull()
    manifest = F.col("record.manifest").isNotNull() & ~known
    return rows.withColumn("kind", F.when(~F.col("is_json"), "INVALID_JSON").when(manifest, "manifest")
                           .when(F.col("record.relation").isNotNull(), "relation")
                           .when(F.col("record.item").isNotNull(), "item").when(F.col("record.source").isNotNull(), "source")
                           .otherwise("UNRECOGNISED")).drop("is_json")


def bundle_manifests(parsed: DataFrame) -> DataFrame:
    """The manifest of each bundle: the first one, and only when it stands before any record."""
    manifest = F.col("kind") == "manifest"
    record = ~manifest & (F.col("kind") != "INVALID_JSON")
    first = parsed.groupBy("bundle").agg(
        F.min(F.when(record, F.col("line"))).alias("first_record"),
        F.min(F.when(manifest, F.col("line"))).alias("manifest_line"),
        F.min_by(F.when(manifest, F.col("record.manifest")), F.when(manifest, F.col("line"))).alias("manifest"))
    valid = F.col("manifest_line").isNotNull() & (F.col("first_record").isNull() | (F.col("manifest_line") < F.col("first_record")))
    return first.select("bundle", "manifest_line", F.when(valid, F.col("manifest")).alias("manifest"))


def first_records(rows: DataFrame, inline_sources: DataFrame) -> DataFrame:
    """First record of each id in line order, and whether its source stands on or before that line."""
    others = [c for c in rows.columns if c not in ("item_id", "line")]
    first = rows.groupBy("item_id").agg(F.min("line").alias("line"),
                                        F.min_by(F.struct(*others), "line").alias("record"))
    seen = inline_sources.groupBy("source_id").agg(F.min("line").alias("source_line"))
    flat = first.select("item_id", "line", "record.*")
    return lookup_join(flat, seen, ["source_id"], ["item_id"]).withColumn(
        "source_visible", F.coalesce(F.col("source_line") <= F.col("line"), F.lit(False)))


def bundle_export(items: DataFrame, sources: DataFrame, relations: DataFrame, manifest: dict[str, str]) -> DataFrame:
    """Ordered JSON lines of a lossless export: manifest, items with their source, unused sources, relations.

    ``to_json`` leaves null fields out.  The order is carried in columns and applied by a distributed sort
    when the lines are written.
    """
    source_fields = F.struct(*[c for c in SOURCE_FIELDS if c in sources.columns])
    carried = sources.select("source_id", source_fields.alias("source"))
    item_fields = F.struct(*[c for c in items.columns if c not in ("record_hash", "line", "source_known")])
    paired = lookup_join(items.select("item_id", "source_id", item_fields.alias("item")), carried, ["source_id"], ["item_id"], "inner")
    item_lines = paired.select(F.lit(1).alias("part"), F.col("source_id").alias("k1"), F.col("item_id").alias("k2"),
                               F.to_json(F.struct("source", "item")).alias("value"))
    unused = carried.join(items.select("source_id").distinct(), "source_id", "left_anti").select(
        F.lit(2).alias("part"), F.col("source_id").alias("k1"), F.lit("").alias("k2"),
        F.to_json(F.struct("source")).alias("value"))
    relation = F.struct(*[c for c in relations.columns if c != "record_hash"])
    edges = relations.select(F.lit(3).alias("part"), F.col("relation_id").alias("k1"), F.lit("").alias("k2"),
                             F.to_json(F.struct(relation.alias("relation"))).alias("value"))
    spark = items.sparkSession
    head = spark.range(1).select(
        F.lit(0).alias("part"), F.lit("").alias("k1"), F.lit("").alias("k2"),
        F.to_json(F.struct(F.struct(*[F.lit(x).alias(k) for k, x in manifest.items()]).alias("manifest"))).alias("value"))
    return head.unionByName(item_lines).unionByName(unused).unionByName(edges)


def write_ordered(lines: DataFrame, order: list[str], path: str) -> str:
    """Text files whose names follow the order: a range partitioning instead of one sorting task."""
    lines.orderBy(*order).select("value").write.mode("errorifexists").text(path)
    return path


def write_lines(df: DataFrame, label: str, most: int = 0) -> str:
    """JSON lines in the shared folder; with ``most`` no file has more rows, for readers that take a file as a whole."""
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").option("maxRecordsPerFile", most).json(path)
    return path


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def compare_exports(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows on one side only, in both directions, counting copies."""
    columns = before.columns
    both = before.select(*columns, F.lit(1).alias("side")).unionByName(after.select(*columns, F.lit(-1).alias("side")))
    net = both.groupBy(*columns).agg(F.sum("side").alias("net"), F.count_if(F.col("side") == 1).alias("n"))
    return net.agg(F.coalesce(F.sum(F.when(F.col("net") > 0, F.col("net"))), F.lit(0)).alias("only_before"),
                   F.coalesce(F.sum(F.when(F.col("net") < 0, -F.col("net"))), F.lit(0)).alias("only_after"),
                   F.sum("n").alias("rows_before"))


def work_export(tables: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines per table, ordered by key, with empty summary and body as null."""
    for name, columns in v.WORK_TABLES.items():
        df = tables[name].select(*columns)
        if name == "items":
            df = df.withColumn("thread", F.coalesce("thread", F.lit(""))).withColumns(
                {c: F.nullif(F.col(c), F.lit("")) for c in ("summary", "body_md")})
        df.orderBy(*v.WORK_KEYS[name]).write.mode("errorifexists").option("ignoreNullFields", "false").json(f"{path}/{name}")


def work_documents(spark: SparkSession, path: str) -> DataFrame:
    """Export documents, one per file, with the check of their key set."""
    names = ["format", *v.WORK_TABLES]
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    found = F.json_object_keys("value")
    exact = (F.size(F.array_except(found, F.array(*map(F.lit, names)))) == 0) & (
        F.size(F.array_except(F.array(*map(F.lit, names)), found)) == 0)
    return files.withColumn("keys_ok", F.coalesce(exact, F.lit(False)))


def work_rows(documents: DataFrame, table: str) -> DataFrame:
    """Rows of one of the six arrays; every value stays text, and missing or unknown fields are marked."""
    columns = v.WORK_TABLES[table]
    rows = documents.where("keys_ok").select("file", F.explode(F.from_json(
        F.get_json_object("value", f"$.{table}"), "array<string>")).alias("raw"))
    found = F.json_object_keys("raw")
    allowed = F.array(*map(F.lit, columns))
    exact = (F.size(F.array_except(found, allowed)) == 0) & (F.size(F.array_except(allowed, found)) == 0)
    schema = T.StructType([T.StructField(c, _TEXT) for c in columns])
    return rows.select("file", exact.alias("fields_ok"), F.from_json("raw", schema).alias("row")).select(
        "file", "fields_ok", "row.*")


def export_packages(package: DataFrame, passed: DataFrame, key: str, fields: list[str], path: str) -> str:
    """Packages that passed their gate, one folder of JSON lines per package, ordered by section and place.

    The folder is cut by a distributed sort, so a package of any size is written by many tasks.
    """
    rows = lookup_join(package, passed.select(key), [key], ["id"], "left_semi")
    ordered = rows.orderBy(key, "section_place", "late", "order_key")
    ordered.select(key, "section", *fields).write.mode("errorifexists").partitionBy(key).json(path)
    return path


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file, read and hashed inside the tasks.  A task holds one whole file: write them in small parts."""
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("actual"),
        F.col("length").alias("bytes"))


def verify_digests(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """MATCH, MISMATCH, or NOT_RECOVERED for a listed file that is not there."""
    status = (F.when(F.col("actual").isNull(), "NOT_RECOVERED").when(F.col("actual") == F.col("expected"), "MATCH")
              .otherwise("MISMATCH"))
    return expected.join(actual.select("name", "actual"), "name", "left").select("name", status.alias("status"))


def store_profile(tables: dict[str, DataFrame | None], cap: int) -> DataFrame:
    """Rows per store; a missing store is a status and not a zero, and a store near its cap is flagged."""
    spark = next(df.sparkSession for df in tables.values() if df is not None)
    parts = []
    for name, df in tables.items():
        if df is None:
            parts.append(spark.range(1).select(F.lit(name).alias("store"), F.lit("STORE_MISSING").alias("status"),
                                               F.lit(None).cast("long").alias("row_count")))
        else:
            parts.append(df.agg(F.count("*").alias("row_count")).select(
                F.lit(name).alias("store"), F.lit("OK").alias("status"), "row_count"))
    return reduce(DataFrame.unionByName, parts).withColumn("near_cap", F.coalesce(F.col("row_count") >= 0.9 * cap, F.lit(False)))


def secret_rules() -> dict[str, Column]:
    """Generic private patterns on ``text``; the hit is reported, the matched text never."""
    text = F.col("text")
    return {
        "PRIVATE_URL": text.rlike(r"(notion\.so/|notion\.site/|docs\.google\.com/|drive\.google\.com/)"),
        "HEX_ID": text.rlike(r"(?i)(^|[^0-9a-z_])[0-9a-f]{8}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{4}-?[0-9a-f]{12}([^0-9a-z_]|$)"),
        "CREDENTIAL_WORD": text.rlike(r"(?i)(password|passwd|api[_-]?key|secret|token|bearer)"),
        "EMAIL": text.rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}"),
    }
