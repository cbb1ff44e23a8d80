"""Record sets and packages: validation, statistics, section selection, integrity gates, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import vocabulary as v
from attesta.functions.rules import Rule, missing, outside
from attesta.plans.scale import lookup_join

RECONCILED = ["MATCH", "PARTIAL_MISMATCH", "STALE_LEFT", "STALE_RIGHT", "SOURCE_ONLY_LEFT", "SOURCE_ONLY_RIGHT", "UNKNOWN"]


def lookup(mapping: dict[str, str], column: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair]), column)


# ---- mapping to items -------------------------------------------------------
def mapped_item_type() -> Column:
    """Item type of a seed record; the weakest readings come last."""
    return (F.when(F.col("authority_class") == "HUMAN_REFERENCE_ONLY", "HUMAN_LENS")
            .when((F.col("type") == "RESEARCH_RESULT") & (F.col("status") == "ENGINEERING_RESULT"), "VALIDATION_RESULT")
            .otherwise(F.coalesce(lookup(v.SEED_ITEM_TYPE, F.col("type")),
                                  F.when(F.col("status").isin("HISTORICAL", "SUPERSEDED"), "HISTORICAL_NOTE")
                                  .when(F.col("status") == "HYPOTHESIS", "HYPOTHESIS").otherwise("UNKNOWN"))))


def mapped_relations(edges: DataFrame) -> DataFrame:
    """Relations of a record set as item relations; a type without a counterpart is left out."""
    kind = lookup(v.SEED_RELATION_TYPE, F.col("rel"))
    return edges.withColumn("relation_type", kind).where(F.col("relation_type").isNotNull())


# ---- sections ---------------------------------------------------------------
def is_live() -> Column:
    return ~F.col("status").isin("HISTORICAL", "SUPERSEDED")


def in_sections(records: DataFrame) -> DataFrame:
    """Live records with their section and place: the order of the record set, next actions before deferred ones."""
    section = lookup(v.SECTION_OF_TYPE, F.col("type"))
    rows = records.where(is_live()).withColumn("section", section).where(F.col("section").isNotNull())
    place = F.array_position(F.array(*[F.lit(s) for s in v.SECTION_ORDER]), F.col("section")).cast("long")
    late = F.when(F.col("type") == "DEFERRED_ITEM", 1).otherwise(0)
    return rows.withColumn("section_place", place).withColumn("late", late)


def in_core() -> Column:
    """Rows of a package that the small core keeps; deferred ones stay deferred."""
    deferred = (F.col("type") == "DEFERRED_ITEM") | (F.col("status") == "DEFERRED")
    next_only = (F.col("section") != "next") | (F.col("type") == "NEXT_ACTION")
    return F.col("section").isin(v.CORE_SECTIONS) & is_live() & ~deferred & next_only


def excluded_counts(package: DataFrame, keys: list[str]) -> DataFrame:
    """What the core leaves out, per package, in one aggregate."""
    section = F.col("section")
    deferred = (section == "next") & ((F.col("type") == "DEFERRED_ITEM") | (F.col("status") == "DEFERRED"))
    return package.groupBy(*keys).agg(
        F.count_if(in_core()).alias("core_records"),
        *[F.count_if(section == s).alias(f"excluded_{s}") for s in ("known", "known_limitations", "open", "sources")],
        F.count_if(deferred).alias("excluded_deferred"))


def record_lines() -> Column:
    """Two lines per record, never shortened."""
    first = F.concat(F.lit("- "), "id", F.lit(" ["), "type", F.lit(" · "), "status", F.lit("] "), "statement")
    second = F.concat(F.lit("  - source: "), "source", F.lit("; provenance: "), "provenance", F.lit("; scope: "), "scope",
                      F.lit("; updated: "), "updated_at", F.lit("; details: "), "details_pointer")
    return F.concat(first, F.lit("\n"), second)


def rendered(package: DataFrame, keys: list[str]) -> DataFrame:
    """The rendered core as ordered lines: a heading row per section, then its records.

    The rows carry their place, so a package of any size is written with a distributed sort and is never
    put together in one task.
    """
    core = package.where(in_core())
    heads = core.select(*keys, "section", "section_place").distinct().withColumn("late", F.lit(-1)).withColumn(
        "order_key", F.lit(-1).cast("long")).withColumn("line", F.concat(F.lit("## "), F.upper("section")))
    rows = core.select(*keys, "section", "section_place", "late", "order_key", record_lines().alias("line"))
    return heads.select(*rows.columns).unionByName(rows)


def render_size(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Characters of the rendered text (lines joined by newlines) and the token estimate of it."""
    total = lines.groupBy(*keys).agg((F.sum(F.length("line").cast("long")) + F.count("*") - 1).alias("chars"),
                                     F.count_if(F.col("late") >= 0).alias("records"))
    return total.withColumn("approx_tokens", F.floor(F.col("chars") / 4 + 0.5).cast("long"))


# ---- validation -------------------------------------------------------------
def record_rules() -> list[Rule]:
    """Needs the source row joined in as ``known_kind``."""
    return [
        *[Rule(f"MISSING_{f.upper()}", missing(f)) for f in v.SEED_REQUIRED if f != "relations"],
        Rule("UNKNOWN_TYPE", outside("type", v.SEED_TYPES)),
        Rule("UNKNOWN_STATUS", outside("status", v.SEED_STATUSES)),
        Rule("SOURCE_NOT_LISTED", F.col("known_kind").isNull()),
        Rule("SOURCE_KIND_DIFFERS", F.col("known_kind").isNotNull() & (F.col("known_kind") != F.col("source_kind"))),
        Rule("SUPERSEDED_WITHOUT_SUCCESSOR", (F.col("status") == "SUPERSEDED") & F.col("superseded_by").isNull()),
        Rule("SUCCESSOR_BUT_LIVE", F.col("superseded_by").isNotNull() & (F.col("status") != "SUPERSEDED")),
        Rule("LONG_STATEMENT", F.length("statement") > 420, "WARNING"),
    ]


def edge_violations(edges: DataFrame, records: DataFrame) -> DataFrame:
    """Relations with a type outside the list, a target that does not exist, or that point at themselves."""
    known = records.select(F.col("id").alias("target"), F.lit(True).alias("known"))
    rows = lookup_join(edges, known, ["target"], ["id", "target"], salts=1)
    hits = F.filter(F.array(F.when(outside("rel", v.SEED_RELATIONS), F.lit("RELATION_NOT_ALLOWED")),
                            F.when(F.col("known").isNull(), F.lit("TARGET_MISSING")),
                            F.when(F.col("id") == F.col("target"), F.lit("SELF_RELATION"))), lambda h: h.isNotNull())
    return rows.select("id", "target", F.explode(hits).alias("rule"))


def supersession_violations(records: DataFrame) -> DataFrame:
    """``superseded_by`` must name a record that declares the matching ``supersedes``."""
    other = records.select(F.col("id").alias("superseded_by"), F.col("supersedes").alias("back"), F.lit(True).alias("found"))
    rows = lookup_join(records.where(F.col("superseded_by").isNotNull()), other, ["superseded_by"], ["id"], salts=1)
    rule = F.when(F.col("found").isNull(), "TARGET_MISSING").when(~F.col("back").eqNullSafe(F.col("id")), "NOT_SYMMETRIC")
    return rows.withColumn("rule", rule).where(F.col("rule").isNotNull()).select("id", "rule")


def pin_violations(edges: DataFrame, versions: DataFrame, row_key: str) -> DataFrame:
    """A pin must be a known version and belong to the declared endpoint (a logical id or that very version)."""
    dim = versions.select("version_id", "logical_item_id")
    rows = lookup_join(edges, dim, ["version_id"], [row_key], salts=1)
    exact = F.col("endpoint").rlike(r"^(.*)@([0-9a-f]{14})$")
    rule = (F.when(F.col("logical_item_id").isNull(), "PIN_UNKNOWN")
            .when(exact & (F.col("endpoint") != F.col("version_id")), "PIN_OF_OTHER_VERSION")
            .when(~exact & (F.col("endpoint") != F.col("logical_item_id")), "PIN_OF_OTHER_ITEM"))
    return rows.withColumn("rule", rule).where(F.col("rule").isNotNull()).select(row_key, "rule")


def set_stats(records: DataFrame, columns: list[str]) -> DataFrame:
    """Counts by each column in one pass over the records (grouping sets)."""
    sets = [[c] for c in columns]
    counted = records.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(
        F.count("*").alias("records"), *[F.grouping(c).alias(f"g_{c}") for c in columns])
    dimension = F.coalesce(*[F.when(F.col(f"g_{c}") == 0, F.lit(c)) for c in columns])
    value = F.coalesce(*[F.when(F.col(f"g_{c}") == 0, F.col(c).cast("string")) for c in columns])
    return counted.select(dimension.alias("dimension"), value.alias("value"), "records")


# ---- gates ------------------------------------------------------------------
def integrity_gate(records: DataFrame, violations: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Rules hold, the count is the manifest's and the content is the manifest's; anything else fails closed.

    The content digest is a sum over the row hashes: it does not depend on order and needs no sort.
    """
    actual = records.groupBy(*keys).agg(F.count("*").alias("actual_count"), content_digest("record_hash").alias("actual_digest"))
    broken = violations.groupBy(*keys).agg(F.count("*").alias("violations"))
    rows = manifest.join(actual, keys, "left").join(broken, keys, "left")
    return rows.select(
        *keys, (F.coalesce("violations", F.lit(0)) == 0).alias("rules_ok"),
        F.col("actual_count").eqNullSafe(F.col("expected_count")).alias("count_ok"),
        F.col("actual_digest").eqNullSafe(F.col("expected_digest")).alias("content_ok")).withColumn(
        "ok", F.col("rules_ok") & F.col("count_ok") & F.col("content_ok"))


def content_digest(hash_column: str) -> Column:
    """Order-free digest of hex row hashes: exact sums of four 32-bit parts of each hash."""
    part = [F.sum(F.conv(F.substring(hash_column, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string") for i in range(4)]
    return F.concat_ws("-", *part)


def package_status(parsed: Column, rules: list[Rule]) -> Column:
    """LOAD_ERROR (unreadable) is kept apart from INTEGRITY_FAIL (readable but wrong); never a partial package."""
    broken = F.lit(False)
    for rule in rules:
        broken = broken | F.coalesce(rule.broken, F.lit(False))
    return F.when(~parsed, "LOAD_ERROR").when(broken, "INTEGRITY_FAIL").otherwise("READY")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Claim by claim comparison of two registries; an older copy is stale, not contradicting."""
    a = left.select(*keys, F.col("record_hash").alias("lh"), F.col("at").alias("la"))
    b = right.select(*keys, F.col("record_hash").alias("rh"), F.col("at").alias("ra"))
    status = (F.when(F.col("rh").isNull() & F.col("ra").isNull(), "SOURCE_ONLY_LEFT")
              .when(F.col("lh").isNull() & F.col("la").isNull(), "SOURCE_ONLY_RIGHT")
              .when(F.col("lh").isNull() | F.col("rh").isNull(), "UNKNOWN")
              .when(F.col("lh") == F.col("rh"), "MATCH").when(F.col("la") < F.col("ra"), "STALE_LEFT")
              .when(F.col("la") > F.col("ra"), "STALE_RIGHT").otherwise("PARTIAL_MISMATCH"))
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def status_counters(reconciled: DataFrame) -> DataFrame:
    """Counts of all statuses, zeros included."""
    spark = reconciled.sparkSession
    names = spark.createDataFrame([(s,) for s in RECONCILED], "status string")
    counted = reconciled.groupBy("status").agg(F.count("*").alias("claims"))
    return names.join(counted, "status", "left").select("status", F.coalesce("claims", F.lit(0)).alias("claims"))
