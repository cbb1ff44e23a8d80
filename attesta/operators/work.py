"""Working memory: normalised rows, list views, bounded dashboards, ranked search and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.functions import vocabulary as v
from attesta.functions.rules import Rule, first_violation, outside
from attesta.plans.scale import Running, lookup_join, running_values, top_k_per_group

WORK_ID = r"^WRK-([A-Z][A-Z0-9-]*[A-Z0-9]|[A-Z])-(\d{8})-(\d{3,})$"
PROJECT_CODE = r"^([A-Z][A-Z0-9-]*[A-Z0-9]|[A-Z])$"


# ---- parameters -------------------------------------------------------------
def clamp_limit(limit: int | None, default: int = 20, largest: int = 100) -> int:
    """List limits: a missing value takes the default, others are clamped."""
    if limit is None:
        return default
    return max(1, min(largest, int(limit)))


def view_limit(limit: int | None, default: int, largest: int) -> tuple[int, bool]:
    """View limits: whole numbers from 1; above the largest they are clamped and reported."""
    if limit is None:
        return default, False
    if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
        raise ValueError(f"limit must be a whole number from 1 (default {default}, largest {largest})")
    return (largest, True) if limit > largest else (limit, False)


def scope_condition(project: str | None = None, project_id: str | None = None) -> Column:
    """Scope by id or by code without regard to case; a given blank value is refused."""
    keep = F.lit(True)
    for name, value in (("project", project), ("project_id", project_id)):
        if value is None:
            continue
        if not isinstance(value, str) or not value.strip():
            raise ValueError(f"{name} must be a non-blank text when it is given")
        key = value.strip()
        keep = keep & ((F.col("project_id").cast("string") == key) | (F.lower("code") == key.lower()))
    return keep


# ---- rows -------------------------------------------------------------------
def normalise_projects(raw: DataFrame) -> DataFrame:
    code = F.upper(F.trim("code"))
    return raw.withColumn("code", code).withColumn("code_ok", code.rlike(PROJECT_CODE))


def normalise_items(raw: DataFrame) -> DataFrame:
    """Enum defaults, blanks, and ``resolved_at`` filled for resolved items."""
    def default(name, value):
        return F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(value))
    resolved = F.coalesce(F.col("resolved_at"), F.when(default("status", "OPEN") == "RESOLVED", F.col("updated_at")))
    changed = {"type": default("type", "NOTE"), "status": default("status", "OPEN"),
               "priority": default("priority", "P2"), "thread": F.coalesce(F.col("thread"), F.lit("")),
               "status_note": F.nullif(F.col("status_note"), F.lit("")),
               "next_action": F.nullif(F.col("next_action"), F.lit("")), "resolved_at": resolved}
    return raw.withColumns({k: c for k, c in changed.items() if k in raw.columns})


def normalise_tags(value: Column) -> tuple[Column, Column]:
    """Trimmed tags and whether the text is a JSON array of non-blank strings."""
    kind = tx.json_value(value)
    tags = F.from_json(value, "array<string>")
    trimmed = F.transform(tags, lambda t: F.trim(t))
    all_text = F.forall(F.try_variant_get(kind, "$", "array<variant>"),
                        lambda x: F.schema_of_variant(x) == "STRING")
    ok = tags.isNotNull() & F.coalesce(all_text, F.lit(False)) & F.forall(trimmed, lambda t: F.coalesce(t != "", F.lit(False)))
    return F.when(ok, trimmed), F.coalesce(ok, F.lit(False))


def work_id_parts(value: Column) -> dict[str, Column]:
    """Project code, day and sequence of a work id; valid only with a real calendar day and a sequence from 1."""
    matched = value.rlike(WORK_ID)
    day = F.regexp_extract(value, WORK_ID, 2)
    sequence = F.regexp_extract(value, WORK_ID, 3)
    real_day = F.try_to_timestamp(day, F.lit("yyyyMMdd")).isNotNull()
    valid = matched & real_day & (F.when(matched, sequence).try_cast("long") >= 1)
    return {"project_code": F.when(matched, F.regexp_extract(value, WORK_ID, 1)), "day": F.when(matched, day),
            "sequence": F.when(matched, sequence).try_cast("long"), "valid": F.coalesce(valid, F.lit(False))}


def number_new_items(new: DataFrame, taken: DataFrame) -> DataFrame:
    """Work ids ``WRK-code-day-NNN`` for new items: after the largest number already given on that day.

    ``new`` has (code, day, order_key); ``taken`` has (code, day, sequence).  Numbers are never reused.
    """
    blocks = new.withColumn("block", F.shiftright("order_key", 16))
    numbered = running_values(blocks, ["code", "day"], ["order_key"],
                              {"place": Running("sum", F.lit(1), inclusive=True)}, [["block"]])
    used = taken.groupBy("code", "day").agg(F.max("sequence").alias("used"))
    joined = lookup_join(numbered, used, ["code", "day"], ["order_key"])
    sequence = F.coalesce("used", F.lit(0)) + F.col("place")
    return joined.withColumn("sequence", sequence.cast("long")).withColumn(
        "new_work_id", F.concat(F.lit("WRK-"), "code", F.lit("-"), "day", F.lit("-"),
                                F.when(F.length(sequence.cast("string")) >= 3, sequence.cast("string"))
                                .otherwise(F.lpad(sequence.cast("string"), 3, "0")))).drop("block", "place", "used")


# ---- views ------------------------------------------------------------------
def live() -> Column:
    return F.col("archived_at").isNull()


def list_filter(*, project_id=None, status=None, type=None, priority=None, thread=None,
                include_archived=False) -> Column:
    keep = F.lit(True) if include_archived else live()
    for name, wanted, allowed in (("project_id", project_id, None), ("status", status, v.WORK_STATUSES),
                                  ("type", type, v.WORK_TYPES), ("priority", priority, v.PRIORITIES),
                                  ("thread", thread, None)):
        if wanted is None:
            continue
        if allowed and wanted not in allowed:
            raise ValueError(f"unknown {name}: {wanted}")
        keep = keep & (F.col(name) == wanted)
    return keep


def unresolved() -> Column:
    return live() & F.col("status").isin(v.UNRESOLVED)


def recent_order(column: str = "updated_at") -> list[Column]:
    return [F.col(column).desc_nulls_last(), F.col("work_id").asc()]


def priority_order() -> list[Column]:
    place = F.array_position(F.array(*[F.lit(p) for p in v.PRIORITIES]), F.col("priority"))
    return [place.asc(), *recent_order()]


def pointer_order() -> list[Column]:
    place = F.when(F.col("role") == "PRIMARY", 0).when(F.col("role") == "NAVIGATION", 1).otherwise(9)
    return [place.asc(), F.col("title").asc(), F.col("source_id").asc()]


BUCKETS = {"CURRENT": "current", "IN_PROGRESS": "in_progress", "OPEN": "open", "BLOCKED": "blocked",
           "UNKNOWN": "unknown", "COMPLETED": "recent_completed"}


def bucketed(items: DataFrame) -> DataFrame:
    """Live items with the dashboard bucket of their status; an item with a next action stands in that one too."""
    bucket = F.element_at(F.create_map(*[F.lit(x) for pair in BUCKETS.items() for x in pair]), F.col("status"))
    next_bucket = F.when(F.col("status").isin(v.UNRESOLVED) & tx.has_text(F.col("next_action")), F.lit("next_actions"))
    rows = items.where(live()).withColumn("bucket", F.explode(F.array_compact(F.array(bucket, next_bucket))))
    return rows


def dashboard(items: DataFrame, limit: int = 5) -> DataFrame:
    """Top items of every (project, bucket): by priority, completed ones by recency only."""
    rows = bucketed(items)
    place = F.array_position(F.array(*[F.lit(p) for p in v.PRIORITIES]), F.col("priority"))
    by_priority = F.when(F.col("bucket") == "recent_completed", 0).otherwise(place)
    return top_k_per_group(rows, ["project_id", "bucket"], [by_priority.asc(), *recent_order()], limit)


def dashboard_totals(items: DataFrame, limit: int = 5) -> DataFrame:
    """Totals and truncation flags per (project, bucket): never lost because of the limit."""
    return bucketed(items).groupBy("project_id", "bucket").agg(F.count("*").alias("total")).withColumn(
        "truncated", F.col("total") > limit)


def source_pointers(sources: DataFrame, projects: DataFrame, per_project: int = 3, overall: int = 15) -> DataFrame:
    """At most three pointers per project and fifteen in all, in project order; only pointer roles count."""
    eligible = sources.where(F.col("role").isin(v.POINTER_ROLES))
    first = top_k_per_group(eligible, ["project_id"], pointer_order(), per_project)
    return (first.join(projects.select("project_id", "code"), "project_id")
            .orderBy("code", "project_id", "rank").limit(overall))


def omitted_projects(sources: DataFrame, projects: DataFrame, per_project: int = 3, overall: int = 15) -> DataFrame:
    """Projects with pointers of which none was shown."""
    shown = source_pointers(sources, projects, per_project, overall).select("project_id").distinct()
    eligible = sources.where(F.col("role").isin(v.POINTER_ROLES)).select("project_id").distinct()
    return eligible.join(shown, "project_id", "left_anti")


def compact_items(items: DataFrame) -> DataFrame:
    """Bounded item view: long fields are clipped and named in ``truncated_fields``."""
    caps = {f: v.TEXT_CAPS[f] for f in ("title", "status_note", "next_action") if f in items.columns}
    return items.select("work_id", "project_id", "thread", "type", "status", "priority", "updated_at",
                        *[tx.clipped(F.col(f), cap).alias(f) for f, cap in caps.items()],
                        tx.clipped_fields(caps).alias("truncated_fields"))


def search_items(items: DataFrame, query: str, *, project_id=None, include_archived=False, limit: int | None = 20,
                 tags: Column | None = None) -> DataFrame:
    """Ranked search: id, exact title, title part, tag, summary, body.  The scope applies before rank and limit."""
    needle = query.strip()
    if not needle:
        raise ValueError("query must not be blank")
    fold = needle.lower()
    title, summary, body = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("title", "summary", "body"))
    tag_hit = F.coalesce(F.exists(tags, lambda t: F.lower(t) == fold), F.lit(False)) if tags is not None else F.lit(False)
    rank = (F.when(F.col("work_id") == needle, 1).when(title == fold, 2).when(title.contains(fold), 3)
            .when(tag_hit, 4).when(summary.contains(fold), 5).when(body.contains(fold), 6))
    keep = F.lit(True) if include_archived else live()
    if project_id is not None:
        keep = keep & (F.col("project_id") == project_id)
    hits = items.where(keep).withColumn("rank", rank.cast("long")).where(F.col("rank").isNotNull())
    return hits.orderBy("rank", "title", "work_id").limit(clamp_limit(limit))


# ---- checks and writes ------------------------------------------------------
def item_rules() -> list[Rule]:
    return [
        Rule("STATUS_NOTE_REQUIRED", F.col("status").isin(v.NOTE_REQUIRED) & ~tx.has_text(F.col("status_note"))),
        Rule("RESOLVED_AT_REQUIRED", (F.col("status") == "RESOLVED") & F.col("resolved_at").isNull()),
        Rule("UNKNOWN_STATUS", outside("status", v.WORK_STATUSES)),
        Rule("UNKNOWN_TYPE", outside("type", v.WORK_TYPES)),
        Rule("UNKNOWN_PRIORITY", outside("priority", v.PRIORITIES)),
    ]


def source_rules() -> list[Rule]:
    return [
        Rule("UNKNOWN_SURFACE", outside("surface", v.WORK_SURFACES)),
        Rule("UNKNOWN_ROLE", outside("role", v.WORK_ROLES)),
        Rule("LOCATOR_REQUIRED", ~tx.has_text(F.col("locator"))),
    ]


def relation_rules() -> list[Rule]:
    return [
        Rule("SELF_RELATION", F.col("from_work_id") == F.col("to_work_id")),
        Rule("UNKNOWN_RELATION_TYPE", outside("relation_type", v.WORK_RELATIONS)),
    ]


def changed_fields(before: str, after: str, fields: list[str]) -> Column:
    """Sorted names of the fields that differ, null-safe."""
    return F.array_sort(F.filter(
        F.array(*[F.when(~F.col(f"{before}.{f}").eqNullSafe(F.col(f"{after}.{f}")), F.lit(f)) for f in fields]),
        lambda name: name.isNotNull()))


def apply_patches(items: DataFrame, patches: DataFrame, fields: list[str]) -> DataFrame:
    """Batch update: patched fields replace the old ones, an equal result is a no-op without a change row."""
    patch = patches.select("work_id", *[F.col(f).alias(f"__new_{f}") for f in fields], F.lit(True).alias("__patched"))
    joined = items.join(patch, "work_id", "inner")
    before = F.struct(*[F.col(f) for f in fields])
    after = F.struct(*[F.coalesce(F.col(f"__new_{f}"), F.col(f)).alias(f) for f in fields])
    out = joined.select("work_id", before.alias("before"), after.alias("after"))
    out = out.withColumn("changed", changed_fields("before", "after", fields))
    return out.where(F.size("changed") > 0)


def switch_primary(links: DataFrame) -> DataFrame:
    """Last link of each (item, source); of the primary ones only the last of an item stays primary."""
    last = links.groupBy("work_id", "source_id").agg(F.max_by("is_primary", "seq").alias("is_primary"),
                                                     F.max("seq").alias("seq"))
    primary = links.where("is_primary").groupBy("work_id").agg(F.max_by("source_id", "seq").alias("primary_source"))
    joined = lookup_join(last, primary, ["work_id"], ["work_id", "source_id"])
    return joined.select("work_id", "source_id",
                         (F.col("is_primary") & F.col("source_id").eqNullSafe(F.col("primary_source"))).alias("is_primary"))


def check_change_rows(rows: DataFrame, key: str) -> DataFrame:
    """First failing rule of each change row (JSON text in ``raw``) of an export."""
    columns = v.WORK_TABLES["changes"]
    allowed = F.array(*map(F.lit, columns))
    found = F.json_object_keys("raw")
    exact = (F.size(F.array_except(found, allowed)) == 0) & (F.size(F.array_except(allowed, found)) == 0)
    parsed = F.from_json("raw", ", ".join(f"{c} string" for c in columns))
    out = rows.withColumn("exact", F.coalesce(exact, F.lit(False))).withColumn("row", parsed)
    _, fields_ok = normalise_tags(F.col("row.changed_fields_json"))
    images_ok = F.lit(True)
    for image in ("row.before_json", "row.after_json"):
        images_ok = images_ok & (F.col(image).isNull() | tx.json_value(F.col(image)).isNotNull())
    ladder = [
        Rule("FIELDS", ~F.col("exact")),
        Rule("TIMESTAMP", F.try_to_timestamp("row.created_at").isNull()),
        Rule("CHANGED_FIELDS", ~fields_ok),
        Rule("ACTOR", ~tx.has_text(F.col("row.actor_class"))),
        Rule("IMAGE", ~images_ok),
    ]
    return out.select(key, first_violation(ladder, "OK").alias("verdict"))
