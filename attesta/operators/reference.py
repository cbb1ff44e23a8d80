"""Reference memory: normalised records, capture provenance, evidence blocks and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import vocabulary as v
from attesta.functions.identity import blank_to_null, content_hash, number_or_null, version_id
from attesta.functions.rules import Rule, missing, outside
from attesta.plans.scale import lookup_join

CAPTURED = {field: f"{field}_at_capture" for field in v.CAPTURE}
DRAFT_WORDS = r"(?i)(^|[^A-Za-z0-9_])(draft|branch|unmerged|open pr)([^A-Za-z0-9_]|$)"


def normalise_sources(raw: DataFrame) -> DataFrame:
    """Empty fields become null and privacy falls back to ``private``."""
    fields = ["source_id", *v.SOURCE_CONTENT]
    columns = [F.coalesce(blank_to_null(F.col(f)), F.lit("private")).alias(f) if f == "privacy"
               else blank_to_null(F.col(f)).alias(f) for f in fields]
    out = raw.select(*columns)
    return out.withColumn("record_hash", content_hash(v.SOURCE_CONTENT))


def bind_items(raw: DataFrame, sources: DataFrame, hashed: bool = True) -> DataFrame:
    """Normalise items against their source and keep the source fields they were captured with.

    One join serves both: project and date are inherited from the source where the item has none, and
    the eight source fields are stored beside the item as its provenance at capture.
    """
    capture = [F.col(column).alias(CAPTURED[field]) for field, column in v.CAPTURE.items()]
    dim = sources.select("source_id", F.col("project_id").alias("__project"), F.col("as_of").alias("__as_of"),
                         F.lit(True).alias("source_known"), *capture)
    out = lookup_join(raw.drop(*CAPTURED.values()), dim, ["source_id"], ["item_id"])
    state = F.coalesce(blank_to_null(F.col("epistemic_state")), F.lit(v.WEAKEST_STATE))
    inherited = {"project_id": F.coalesce(blank_to_null(F.col("project_id")), F.col("__project")),
                 "as_of": F.coalesce(blank_to_null(F.col("as_of")), F.col("__as_of")),
                 "epistemic_state": state, "confidence": number_or_null(F.col("confidence"))}
    columns = [inherited.get(f, blank_to_null(F.col(f))).alias(f) for f in v.ITEM_CONTENT]
    extra = [c for c in ("line",) if c in raw.columns]
    out = out.select("item_id", *columns, *CAPTURED.values(), *extra,
                     F.coalesce("source_known", F.lit(False)).alias("source_known"))
    if not hashed:
        return out
    full = content_hash(v.ITEM_CONTENT)
    return out.withColumn("record_hash", full).withColumn("version_id", version_id(F.col("item_id"), full))


def normalise_relations(raw: DataFrame) -> DataFrame:
    """Weakest status by default and an id made of type and endpoints where none is given."""
    made = F.concat(F.lit("rel:"), F.col("relation_type"), F.lit(":"), F.col("from_item_id"), F.lit("->"),
                    F.col("to_item_id"))
    given = [c for c in raw.columns if c not in ("relation_id", "epistemic_status")]
    return raw.select(
        F.coalesce(blank_to_null(F.col("relation_id")), made).alias("relation_id"),
        F.coalesce(blank_to_null(F.col("epistemic_status")), F.lit(v.WEAKEST_STATE)).alias("epistemic_status"),
        *given)


def mark_superseded(items: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """First declared superseder (in bundle order) wins; nothing is deleted or revived.

    ``declared`` may be the raw records: they hold the same claims without the joins behind ``items``.
    """
    target = blank_to_null(F.col("supersedes_item_id"))
    claims = ((items if declared is None else declared).select("line", F.col("item_id").alias("by_id"), target.alias("item_id"))
              .where(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.min_by("by_id", "line").alias("superseded_by")))
    marked = items.join(claims, "item_id", "left")
    return marked.withColumn("lifecycle", F.when(F.col("superseded_by").isNotNull(), "SUPERSEDED").otherwise("ACTIVE"))


def superseding_edges(items: DataFrame) -> DataFrame:
    """Automatic SUPERSEDES edges for declared targets that exist; others stay a warning."""
    known = items.select(F.col("item_id").alias("supersedes_item_id"), F.lit(True).alias("known"))
    declared = items.where(F.col("supersedes_item_id").isNotNull()).select("item_id", "supersedes_item_id", "source_id")
    joined = lookup_join(declared, known, ["supersedes_item_id"], ["item_id"], salts=1)
    return joined.select(
        F.concat(F.lit("rel:auto:SUPERSEDES:"), "item_id", F.lit("->"), "supersedes_item_id").alias("relation_id"),
        F.col("item_id").alias("from_item_id"), F.col("supersedes_item_id").alias("to_item_id"), "source_id",
        F.coalesce("known", F.lit(False)).alias("target_known"))


# ---- retrieval rows ---------------------------------------------------------
def with_source(items: DataFrame, sources: DataFrame) -> DataFrame:
    """Item and source as it is now (``cur_*``); what it was at capture stays in ``*_at_capture``."""
    fields = ["title", "surface", "source_kind", "authority_class", "revision", "as_of", "currentness",
              "content_hash", "locator", "privacy", "project_id"]
    dim = sources.select("source_id", *[F.col(f).alias(f"cur_{f}") for f in fields])
    return lookup_join(items, dim, ["source_id"], ["item_id"], "inner")


def effective(field: str) -> Column:
    """Value at capture, else the value of the source now."""
    return F.coalesce(F.col(CAPTURED[field]), F.col(f"cur_{v.CAPTURE[field]}"))


def retrieval_filter(*, project_id=None, item_type=None, authority_class=None, source_kind=None, surface=None,
                     source_id=None, include_superseded=False, evidence_only=False) -> Column:
    """Filters of a retrieval; classification always uses the values at capture."""
    keep = F.lit(True)
    for column, wanted in ((F.col("project_id"), project_id), (F.col("item_type"), item_type),
                           (effective("source_authority_class"), authority_class),
                           (effective("source_kind"), source_kind), (effective("source_surface"), surface),
                           (F.col("source_id"), source_id)):
        if wanted is not None:
            keep = keep & (column == wanted)
    if not include_superseded:
        keep = keep & (F.coalesce(F.col("lifecycle"), F.lit("ACTIVE")) != "SUPERSEDED")
    if evidence_only:
        keep = keep & implementation_evidence()
    return keep


def in_project(project_id: str) -> Column:
    """The item's own project or the project of its source."""
    return (F.col("project_id") == project_id) | (F.col("cur_project_id") == project_id)


def implementation_evidence() -> Column:
    return F.coalesce((effective("source_surface") == "github")
                      & (effective("source_authority_class") == "IMPLEMENTATION_EVIDENCE"), F.lit(False))


def is_draft() -> Column:
    text = F.concat_ws(" ", "source_status", effective("source_currentness"), "validity", "authority_scope")
    return F.coalesce(effective("source_currentness") == "DRAFT", F.lit(False)) | text.rlike(DRAFT_WORDS)


def changed_source_fields() -> Column:
    """Names of the source fields that differ between capture and now."""
    return F.filter(
        F.array(*[F.when(~effective(field).eqNullSafe(F.col(f"cur_{column}")), F.lit(column))
                  for field, column in v.CAPTURE.items()]), lambda name: name.isNotNull())


def caveats() -> Column:
    """Caveat codes of a retrieved item, in fixed order; details follow after a colon."""
    authority, surface = effective("source_authority_class"), effective("source_surface")
    state, kind = effective("source_currentness"), effective("source_kind")
    item_type = F.col("item_type")
    cached_type = item_type.isin("IMPLEMENTATION_FACT", "VALIDATION_RESULT")
    as_of = F.coalesce(F.col("as_of"), effective("source_as_of"), F.lit("UNKNOWN"))
    changed = changed_source_fields()
    dash = F.lit("-")
    rules = [
        ((surface == "demo") | (authority == "DEMO_ONLY"), F.lit("DEMO_DATA")),
        (surface == "fixture", F.lit("TEST_FIXTURE")),
        (authority == "NAVIGATION_ONLY", F.lit("ROUTE_ONLY")),
        ((authority == "HUMAN_REFERENCE_ONLY") | (item_type == "HUMAN_LENS"), F.lit("HUMAN_LENS")),
        ((authority == "HISTORICAL_ONLY") | (state == "HISTORICAL") | (item_type == "HISTORICAL_NOTE"),
         F.lit("HISTORICAL_NOTE")),
        (authority == "RESEARCH_DONOR", F.lit("BOOK_NOT_CANON")),
        (~implementation_evidence() & (cached_type | (item_type == "ARCHITECTURE_POSITION")
                                       | surface.isin("notion", "drive")), F.lit("NOT_IMPLEMENTATION_EVIDENCE")),
        (cached_type | (kind == "IMPLEMENTATION"), F.concat(F.lit("CACHED_STATE:"), as_of)),
        (is_draft(), F.lit("DRAFT_STATE")),
        (F.col("lifecycle") == "SUPERSEDED", F.concat(F.lit("SUPERSEDED:"), F.coalesce("superseded_by", dash))),
        (F.size(changed) > 0, F.concat(
            F.lit("SOURCE_CHANGED:"), F.concat_ws(",", changed), F.lit(";captured="),
            F.coalesce(effective("source_revision"), dash), F.lit("/"), F.coalesce(effective("source_as_of"), dash),
            F.lit(";now="), F.coalesce("cur_revision", dash), F.lit("/"), F.coalesce("cur_as_of", dash))),
        (F.coalesce(F.col("capture_backfilled"), F.lit(False)), F.lit("CAPTURE_BACKFILLED")),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(broken, F.lit(False)), text) for broken, text in rules]),
                    lambda text: text.isNotNull())


# What each caveat code tells the reader
CAVEAT_TEXT = {
    "DEMO_DATA": "DEMO/EXAMPLE DATA: not a source fact",
    "TEST_FIXTURE": "SYNTHETIC TEST FIXTURE",
    "ROUTE_ONLY": "ROUTE ONLY: a navigation source is not a truth owner",
    "HUMAN_LENS": "HUMAN LENS is not a system primitive",
    "HISTORICAL_NOTE": "HISTORICAL NOTE is not current truth",
    "BOOK_NOT_CANON": "BOOK is not canon",
    "NOT_IMPLEMENTATION_EVIDENCE": "NOT IMPLEMENTATION EVIDENCE: verify at the exact repository and commit",
    "CACHED_STATE": "CACHED STATE: not the live state",
    "DRAFT_STATE": "DRAFT/BRANCH STATE: not a main-branch fact",
    "SUPERSEDED": "SUPERSEDED",
    "SOURCE_CHANGED": "SOURCE CHANGED SINCE CAPTURE: the item was not verified again",
    "CAPTURE_BACKFILLED": "CAPTURE PROVENANCE BACKFILLED at migration",
}


def evidence_blocks(items: DataFrame, sources: DataFrame, with_claim: bool = False) -> DataFrame:
    """One row per item with effective provenance, drift, flags and caveats."""
    rows = with_source(items, sources)
    if "capture_backfilled" not in rows.columns:
        rows = rows.withColumn("capture_backfilled", F.lit(False))
    changed = changed_source_fields()
    return rows.select(
        "item_id", "project_id", "item_type", "epistemic_state", "lifecycle", "superseded_by", "as_of", "source_id",
        *(["claim", "version_id", "source_section", "source_status", effective("source_currentness").alias("source_currentness")]
          if with_claim else []),
        effective("source_title").alias("source_title"), effective("source_surface").alias("source_surface"),
        effective("source_kind").alias("source_kind"),
        effective("source_authority_class").alias("authority_class"),
        effective("source_revision").alias("source_revision"),
        F.concat_ws(",", changed).alias("changed_fields"), (F.size(changed) > 0).alias("source_changed"),
        implementation_evidence().alias("is_implementation_evidence"), is_draft().alias("is_draft"),
        F.concat_ws("|", caveats()).alias("caveats"))


def block_text() -> Column:
    """Rendered evidence block; claims never appear without their provenance."""
    dash = F.lit("-")
    status = F.concat_ws(" / ", "epistemic_state", F.concat(F.lit("source_status="), "source_status"),
                         F.concat(F.lit("currentness="), "source_currentness"))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("[REFERENCE MEMORY] "), F.coalesce("project_id", dash), F.lit(" / "), F.col("item_type"),
                 F.lit(" / "), status),
        F.concat(F.lit("source (at capture): "), F.col("source_title"), F.lit(" ("), F.col("source_id"), F.lit("; "),
                 F.col("source_surface"), F.lit("/"), F.col("source_kind"), F.lit("; authority="),
                 F.coalesce("authority_class", F.lit("UNSPECIFIED")),
                 F.coalesce(F.concat(F.lit("; rev="), "source_revision"), F.lit("")), F.lit(")")),
        F.concat(F.lit("as_of: "), F.coalesce("as_of", F.lit("UNKNOWN")),
                 F.coalesce(F.concat(F.lit(" · section: "), "source_section"), F.lit(""))),
        F.concat(F.lit("version: "), F.coalesce("version_id", dash)),
        F.concat(F.lit("claim (source-bound, not verified truth): "), F.col("claim")),
        F.when(F.col("caveats") != "", F.array_join(F.transform(F.split("caveats", r"\|"), _caveat_line), "\n")))


def _caveat_line(caveat: Column) -> Column:
    texts = F.create_map(*[F.lit(x) for pair in CAVEAT_TEXT.items() for x in pair])
    return F.concat(F.lit("! "), caveat, F.lit(" ("), F.element_at(texts, F.regexp_extract(caveat, "^[A-Z_]+", 0)), F.lit(")"))


# ---- checks -----------------------------------------------------------------
def source_rules() -> list[Rule]:
    required = missing("source_id") | missing("title") | missing("surface") | missing("source_kind")
    return [
        Rule("SOURCE_REQUIRED", required),
        Rule("UNKNOWN_SOURCE_KIND", outside("source_kind", v.SOURCE_KINDS)),
        Rule("UNKNOWN_AUTHORITY_CLASS", outside("authority_class", v.AUTHORITY_CLASSES)),
        Rule("HUMAN_REFERENCE_PAIR", (F.col("source_kind") == "HUMAN_REFERENCE")
             & ~F.col("authority_class").eqNullSafe("HUMAN_REFERENCE_ONLY")),
        Rule("BOOK_DONOR_PAIR", (F.col("source_kind") == "BOOK_DONOR")
             & ~F.col("authority_class").eqNullSafe("RESEARCH_DONOR")),
        Rule("NON_STANDARD_SURFACE", outside("surface", v.SURFACES), "WARNING"),
        Rule("NON_STANDARD_CURRENTNESS", outside("currentness", v.CURRENTNESS), "WARNING"),
    ]


def item_rules() -> list[Rule]:
    """The source must be joined in: its authority class decides the lens rules."""
    human = F.coalesce(F.col(CAPTURED["source_authority_class"]) == "HUMAN_REFERENCE_ONLY", F.lit(False))
    lens = F.coalesce(F.col("item_type") == "HUMAN_LENS", F.lit(False))
    return [
        Rule("ITEM_REQUIRED", missing("item_id") | missing("source_id") | missing("item_type") | missing("claim")),
        Rule("ITEM_SOURCE_UNKNOWN", ~F.col("source_known")),
        Rule("UNKNOWN_ITEM_TYPE", outside("item_type", v.ITEM_TYPES)),
        Rule("LENS_REQUIRED", human & ~lens),
        Rule("LENS_FORBIDDEN", lens & ~human),
        Rule("STRONG_STATE_KEPT", F.upper("epistemic_state").isin(v.QUALIFYING_STATES), "WARNING"),
    ]


def relation_rules() -> list[Rule]:
    return [
        Rule("RELATION_REQUIRED", missing("from_item_id") | missing("to_item_id") | missing("relation_type")),
        Rule("UNKNOWN_RELATION_TYPE", outside("relation_type", v.RELATION_TYPES)),
        Rule("FROM_UNKNOWN", ~F.col("from_known")),
        Rule("TO_UNKNOWN", ~F.col("to_known")),
    ]


def identity_rules() -> list[Rule]:
    """Declared logical and version ids must follow from the item id and the content."""
    archived = F.col("item_id").rlike(r"^(.*)@([0-9a-f]{14})$")
    expected = F.when(archived, F.regexp_extract("item_id", r"^(.*)@([0-9a-f]{14})$", 1)).otherwise(F.col("item_id"))
    logical = F.coalesce(F.col("logical_item_id"), F.col("item_id"))
    return [
        Rule("LOGICAL_ID_MISMATCH", logical != expected),
        Rule("VERSION_ID_MISMATCH", (logical == expected) & F.col("declared_version").isNotNull()
             & (F.col("declared_version") != version_id(logical, F.col("record_hash")))),
    ]
