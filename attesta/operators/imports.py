"""The whole import of a bundle: parse, normalise, check, pin, merge and count; one error refuses all of it.

``Memory`` holds the three stored tables.  ``import_bundle`` reads a bundle's parsed lines once, finds all errors, and
gives the memory after the import: stored and incoming rows of a table are tagged, brought together by one exchange on
their id, and classified in that one pass.  Nothing stored is deleted; a revised item stays as ``item@hash``.

Claims are long texts that no check compares but by their hash.  They stay in the table of the parsed lines: an import
moves the heads of items (all but the claim, with the line that holds it), and the claims come back by that line when
somebody reads the items.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import vocabulary as v
from attesta.functions.identity import VERSION_ID, blank_to_null, content_hash, number_or_null, version_id
from attesta.functions.rules import Rule, violations
from attesta.operators import reference as ref
from attesta.plans.scale import lookup_join
from attesta.session import written
from attesta.sources import bundles

SOURCES = [*bundles.SOURCE_FIELDS, "record_hash"]
ITEMS = [*bundles.ITEM_FIELDS, "record_hash"]
HEADS = [*(c for c in ITEMS if c != "claim"), "body"]
RELATIONS = [*bundles.RELATION_FIELDS, "record_hash"]
COUNTERS = ["sources_inserted", "sources_updated", "sources_unchanged", "items_inserted", "items_unchanged", "items_revised",
            "items_superseded", "relations_inserted", "relations_unchanged", "not_in_this_seed"]


@dataclass(frozen=True)
class Memory:
    """The three tables.  After an import the items are there in their two parts as well: ``heads`` and ``claims``, whose
    ``body`` names the line that brought the claim."""

    sources: DataFrame
    items: DataFrame
    relations: DataFrame
    heads: DataFrame | None = None
    claims: DataFrame | None = None


@dataclass(frozen=True)
class Imported:
    """``after`` is the memory as it was where ``errors`` has a row; ``counters`` has one row."""

    committed: bool
    after: Memory
    errors: DataFrame
    warnings: DataFrame
    counters: DataFrame


def empty_memory(spark: SparkSession) -> Memory:
    def nothing(columns: list[str]) -> DataFrame:
        kinds = {"confidence": "double", "capture_backfilled": "boolean", "pin_backfilled": "boolean"}
        return spark.createDataFrame([], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns))
    return Memory(nothing(SOURCES), nothing(ITEMS), nothing(RELATIONS))


def _in_parts(memory: Memory) -> tuple[DataFrame, DataFrame]:
    """Heads and claims of the items; ids of items are unique."""
    if memory.heads is not None:
        return memory.heads, memory.claims
    items = memory.items.withColumn("body", F.concat(F.lit("stored:"), F.coalesce("item_id", F.lit(""))))
    return items.select(*HEADS), items.select("body", "claim")


def _whole(heads: DataFrame, claims: DataFrame) -> DataFrame:
    return heads.join(claims, "body", "left").select(*ITEMS)


def items_with_digests(memory: Memory) -> DataFrame:
    """The items with the SHA-256 of each claim in its place; it is taken before anything moves."""
    heads, claims = _in_parts(memory)
    return _whole(heads, claims.withColumn("claim", F.sha2("claim", 256)))


def _flag(name: str) -> Column:
    return F.coalesce(F.col(name).isin("1", "true"), F.lit(False))


def _firsts(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The first record of each id by line, and the lines whose content differs from it."""
    fields = [c for c in rows.columns if c != key]
    firsts = (rows.groupBy(key).agg(F.min_by(F.struct(*fields), "line").alias("r"),
                                    F.min("record_hash").alias("low"), F.max("record_hash").alias("high")))
    # copies with one content are the usual case: only ids with several contents look for their lines
    several = firsts.where("low <> high").select(key, F.col("r.record_hash").alias("__first"))
    clash = rows.join(several, key).where(F.col("record_hash") != F.col("__first"))
    return firsts.select(key, "r.*"), clash.select("line", key)


# ---- records of a bundle ---------------------------------------------------------------------------------------

def _bundle_sources(parsed: DataFrame) -> DataFrame:
    rows = parsed.where(F.col("record.source").isNotNull()).select("line", "record.source.*")
    cleaned = [F.coalesce(blank_to_null(F.col(f)), F.lit("private")).alias(f) if f == "privacy" else blank_to_null(F.col(f)).alias(f)
               for f in bundles.SOURCE_FIELDS]
    return rows.select("line", *cleaned).withColumn("record_hash", content_hash(v.SOURCE_CONTENT))


def _bundle_items(parsed: DataFrame, sources: DataFrame, stored: DataFrame) -> DataFrame:
    """Items with the source they see: one that stands on or before their line, else the stored one."""
    rows = parsed.where(F.col("record.item").isNotNull()).select(
        "line", "record.item.*", F.col("record.source.source_id").alias("__own")).withColumn(
        "source_id", F.coalesce(blank_to_null(F.col("source_id")), "__own"))
    fields = F.struct("project_id", *v.CAPTURE.values())
    here = sources.select("source_id", F.col("line").alias("__line"), fields.alias("__here"))
    there = stored.select("source_id", fields.alias("__there"))
    seen = lookup_join(lookup_join(rows, here, ["source_id"], ["line"]), there, ["source_id"], ["line"]).withColumn(
        "__source", F.when(F.col("__line") <= F.col("line"), F.col("__here")).otherwise(F.col("__there")))
    carried = F.coalesce(*[blank_to_null(F.col(c)) for c in bundles.CAPTURED]).isNotNull()
    known = F.col("__source").isNotNull() & F.coalesce(F.col("__own") == F.col("source_id"), F.lit(True))
    inherited = {
        "project_id": F.coalesce(blank_to_null(F.col("project_id")), F.col("__source.project_id")),
        "as_of": F.coalesce(blank_to_null(F.col("as_of")), F.col("__source.as_of")),
        "epistemic_state": F.coalesce(blank_to_null(F.col("epistemic_state")), F.lit(v.WEAKEST_STATE)),
        "confidence": number_or_null(F.col("confidence")), "capture_backfilled": _flag("capture_backfilled"),
        "lifecycle": F.when(F.col("lifecycle") == "SUPERSEDED", F.col("lifecycle")),
        **{f"{field}_at_capture": F.when(carried, blank_to_null(F.col(f"{field}_at_capture"))).otherwise(F.col(f"__source.{column}"))
           for field, column in v.CAPTURE.items()}}
    items = seen.select("line", known.alias("source_known"), F.col("__source.authority_class").alias("__authority"),
                        *[inherited.get(f, blank_to_null(F.col(f))).alias(f) for f in bundles.ITEM_FIELDS])
    items = items.withColumn("record_hash", content_hash(v.ITEM_CONTENT)).withColumnRenamed("version_id", "declared_version")
    logical = F.coalesce("logical_item_id", "item_id")
    return items.withColumn("logical_item_id", logical).withColumn("version_id", version_id(logical, F.col("record_hash")))


def _bundle_relations(parsed: DataFrame) -> DataFrame:
    rows = parsed.where(F.col("record.relation").isNotNull()).select("line", "record.relation.*")
    made = F.concat(F.lit("rel:"), "relation_type", F.lit(":"), "from_item_id", F.lit("->"), "to_item_id")
    own = {"relation_id": F.coalesce(blank_to_null(F.col("relation_id")), made), "pin_backfilled": _flag("pin_backfilled"),
           "epistemic_status": F.coalesce(blank_to_null(F.col("epistemic_status")), F.lit(v.WEAKEST_STATE))}
    return rows.select("line", *[own.get(f, blank_to_null(F.col(f))).alias(f) for f in bundles.RELATION_FIELDS]).withColumn(
        "record_hash", content_hash(v.RELATION_CONTENT))


# ---- classification --------------------------------------------------------------------------------------------

def _together(stored: DataFrame, incoming: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``o`` (stored) and ``n`` (incoming) of each id, by one exchange; ids are unique on either side."""
    row = F.struct(*columns)
    kind = incoming.select(row.alias("r")).schema["r"].dataType.simpleString()
    sides = stored.select(key, row.cast(kind).alias("o"), F.lit(None).cast(kind).alias("n")).unionByName(
        incoming.select(key, F.lit(None).cast(kind).alias("o"), row.alias("n")))
    both = sides.groupBy(key).agg(F.first("o", ignorenulls=True).alias("o"), F.first("n", ignorenulls=True).alias("n"))
    same = F.col("o.record_hash") == F.col("n.record_hash")
    return both.withColumn("outcome", F.when(F.col("o").isNull(), "inserted").when(F.col("n").isNull(), "untouched")
                           .when(same, "unchanged").otherwise("revised"))


def _picked(columns: list[str], old: Column, own: dict[str, Column]) -> list[Column]:
    """Each column of the stored row where ``old``, else of the incoming one; ``own`` says otherwise for some."""
    return [own.get(c, F.when(old, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))).alias(c) for c in columns]


def _pins(relations: DataFrame, items: DataFrame, stored: DataFrame) -> DataFrame:
    """Endpoints resolved to versions: ``<end>_row`` is what the declared endpoint names after this bundle, ``<end>_pin``
    the version given or found, ``<end>_logical`` whose version that is."""
    named = items.select("item_id", "logical_item_id", "version_id")
    before = stored.select("item_id", "logical_item_id", "version_id")
    # an item of the bundle decides what its id names; stored versions stay reachable by their version id
    by_id = named.withColumn("p", F.lit(1)).unionByName(before.withColumn("p", F.lit(0))).groupBy("item_id").agg(
        F.max_by(F.struct("logical_item_id", "version_id"), "p").alias("row"))
    by_version = named.unionByName(before).groupBy("version_id").agg(F.max("logical_item_id").alias("logical"))
    out = relations
    for end in ("from", "to"):
        out = lookup_join(out, by_id.select(F.col("item_id").alias(f"{end}_item_id"), F.col("row").alias(f"{end}_row")),
                          [f"{end}_item_id"], ["relation_id"], salts=1)
        out = out.withColumn(f"{end}_pin", F.coalesce(f"{end}_version_id", f"{end}_row.version_id"))
        out = lookup_join(out, by_version.select(F.col("version_id").alias(f"{end}_pin"), F.col("logical").alias(f"{end}_logical")),
                          [f"{end}_pin"], ["relation_id"], salts=1)
    return out


def _pin_rules(end: str) -> list[Rule]:
    given, pin, row = F.col(f"{end}_version_id").isNotNull(), F.col(f"{end}_pin"), F.col(f"{end}_row")
    archived = F.when(row.isNotNull(), F.col(f"{end}_row.logical_item_id") != F.col(f"{end}_item_id")).otherwise(
        F.col(f"{end}_item_id").rlike(VERSION_ID))
    own = F.coalesce(f"{end}_row.version_id", f"{end}_item_id")
    logical = F.coalesce(f"{end}_row.logical_item_id", f"{end}_item_id")
    known = F.col(f"{end}_logical").isNotNull()
    name = end.upper()
    return [Rule(f"{name}_UNKNOWN", ~given & pin.isNull()), Rule(f"{name}_PIN_UNKNOWN", given & ~known),
            Rule(f"{name}_PIN_OF_OTHER_VERSION", given & known & archived & (pin != own)),
            Rule(f"{name}_PIN_OF_OTHER_ITEM", given & known & ~archived & (F.col(f"{end}_logical") != logical))]


def import_bundle(stored: Memory, lines: DataFrame, seed_id: str, seed_version: str, restore: bool = False) -> Imported:
    """Import one bundle's lines (``bundles.bundle_lines``) as seed ``seed_id`` in ``seed_version``.

    ``restore`` takes an export back: seed versions of stored rows stay, supersession is taken as exported, and nothing is
    counted as missing.  Lines that
    are blank or comments count for the numbering only.  Errors name their line; warnings do not refuse.
    """
    spark = lines.sparkSession
    heads, claims = _in_parts(stored)
    parsed = written(bundles.parse_lines(lines).drop("raw"), "bundle")
    body = F.concat(F.lit(f"{uuid4().hex[:12]}:"), "line")
    claims = claims.unionByName(parsed.where(F.col("record.item").isNotNull()).select(
        body.alias("body"), blank_to_null(F.col("record.item.claim")).alias("claim")))
    sources, source_clash = _firsts(_bundle_sources(parsed), "source_id")
    sources = written(sources, "bundle-sources")
    # whether there is a claim is all that the rules ask: its first letter is kept for them
    every_item = written(_bundle_items(parsed, sources, stored.sources).withColumn("claim", F.left("claim", F.lit(1)))
                         .withColumn("body", body), "bundle-items")
    items, item_clash = _firsts(every_item.drop("claim"), "item_id")
    items = written(items, "bundle-item-firsts")
    every_relation = _bundle_relations(parsed)
    relations, relation_clash = _firsts(every_relation.where(F.col("relation_id").isNotNull()), "relation_id")
    pinned = written(_pins(relations, items, heads), "bundle-relations")
    old = stored.relations.select("relation_id", F.struct("record_hash", "from_version_id", "to_version_id").alias("old"))
    against = pinned.join(old, "relation_id", "left").withColumn("is_known", F.col("old").isNotNull())

    # ---- errors
    authority = F.col("__authority").alias(ref.CAPTURED["source_authority_class"])
    judged = every_item.select("line", "item_id", "logical_item_id", "declared_version", "record_hash", "source_known", authority,
                               *[c for c in v.ITEM_CONTENT])
    revised = F.col("is_known") & (F.col("record_hash") != F.col("old.record_hash"))
    moved = [F.col(f"{end}_version_id").isNotNull() & ~F.col(f"{end}_version_id").eqNullSafe(F.col(f"old.{end}_version_id"))
             for end in ("from", "to")]
    line = F.col("line")
    declared = [r for r in ref.relation_rules() if r.code in ("RELATION_REQUIRED", "UNKNOWN_RELATION_TYPE")]
    found = [
        violations(parsed, line, [Rule("INVALID_JSON", F.col("kind") == "INVALID_JSON"), Rule("UNRECOGNISED", F.col("kind") == "UNRECOGNISED")]),
        violations(_bundle_sources(parsed), line, ref.source_rules()),
        violations(judged, line, ref.item_rules() + ref.identity_rules()),
        violations(every_relation, line, declared),
        violations(against, line, [*_pin_rules("from"), *_pin_rules("to"), Rule("RELATION_REVISED", revised),
                                   Rule("RELATION_REPINNED", F.col("is_known") & ~revised & (moved[0] | moved[1]))])]
    for kind, clash in (("SOURCE", source_clash), ("ITEM", item_clash), ("RELATION", relation_clash)):
        found.append(violations(clash, line, [Rule(f"CONFLICTING_{kind}", F.lit(True))]))

    # ---- supersession, in the order of the bundle; a mark that is there stays
    # (an export brings the marks and edges of its declarations itself)
    wanted = items.where(F.col("supersedes_item_id").isNotNull() & F.lit(not restore)).select(
        F.col("supersedes_item_id").alias("item_id"), F.col("item_id").alias("by_id"), "line", "source_id")
    exists = heads.select("item_id").unionByName(items.select("item_id")).distinct().withColumn("is_there", F.lit(True))
    aimed = wanted.join(exists, "item_id", "left")
    absent = aimed.where(F.col("is_there").isNull())
    missing = absent.select(F.lit("SUPERSEDED_ITEM_ABSENT").alias("rule"), F.lit("WARNING").alias("severity"),
                            F.col("line").cast("string").alias("key"))
    problems = written(reduce(DataFrame.unionByName, [*found, missing]), "import-problems")
    errors = problems.where("severity = 'ERROR'").select(F.col("key").cast("long").alias("line"), "rule")
    warnings = problems.where("severity = 'WARNING'").select(F.col("key").cast("long").alias("line"), "rule")
    if errors.take(1):
        return Imported(False, stored, errors, warnings,
                        spark.range(1).select(*[F.lit(0).cast("long").alias(c) for c in COUNTERS]))
    marks = aimed.where("is_there").groupBy("item_id").agg(F.min_by("by_id", "line").alias("by_id"))

    # ---- merge
    def seeded(name: str) -> Column:
        """Rows of an import carry its seed and version, unless the record brings its own."""
        return F.coalesce(f"n.{name}", F.lit(seed_id if name == "seed_id" else seed_version))

    taken = F.col("outcome").isin("untouched", "unchanged")
    here = F.col("outcome") != "untouched"
    last = F.when((F.col("outcome") == "unchanged") & F.lit(not restore), F.lit(seed_version)).when(taken, F.col("o.last_seed_version"))
    sources_both = written(_together(stored.sources, sources, "source_id", SOURCES), "sources-both")
    new_sources = sources_both.select("outcome", *_picked(SOURCES, taken, {
        "seed_id": F.coalesce("o.seed_id", seeded("seed_id")),
        "first_seed_version": F.coalesce("o.first_seed_version", seeded("first_seed_version")),
        "last_seed_version": F.coalesce(last, F.when(F.col("outcome") == "revised", F.lit(seed_version)), seeded("last_seed_version"))}))

    items_both = _together(heads, items, "item_id", HEADS).join(marks, "item_id", "left")
    given_up = (F.col("o.lifecycle") == "SUPERSEDED") | (F.col("n.lifecycle") == "SUPERSEDED")
    told = F.coalesce("o.superseded_by", "n.superseded_by")
    items_both = written(items_both.withColumn("newly", F.col("by_id").isNotNull() & ~(
        F.coalesce(given_up, F.lit(False)) & told.isNotNull())), "items-both")
    current = items_both.select("outcome", "newly", *_picked(HEADS, taken, {
        "lifecycle": F.when(F.coalesce(given_up, F.lit(False)) | F.col("newly"), "SUPERSEDED").otherwise("ACTIVE"),
        "superseded_by": F.when(F.col("newly"), F.col("by_id")).otherwise(told),
        "seed_id": F.coalesce("o.seed_id", seeded("seed_id")),
        "first_seed_version": F.coalesce("o.first_seed_version", seeded("first_seed_version")),
        "last_seed_version": F.coalesce(last, F.when(F.col("outcome") == "revised", F.lit(seed_version)), seeded("last_seed_version"))}))
    archive = items_both.where("outcome = 'revised'").select(*[{
        "item_id": F.col("o.version_id"), "lifecycle": F.lit("SUPERSEDED"), "superseded_by": F.col("item_id")}.get(c, F.col(f"o.{c}"))
        .alias(c) for c in HEADS])
    archive = archive.join(items_both.select(F.col("item_id")), "item_id", "left_anti")
    all_items = written(current.drop("outcome", "newly").unionByName(archive.select(*HEADS)), "items-after")

    # the automatic edge of each declared supersession, pinned to the versions that are current now
    ends = all_items.select("item_id", "version_id")
    automatic = (aimed.where("is_there").join(ends.select(F.col("item_id").alias("by_id"), F.col("version_id").alias("from_version_id")), "by_id")
                 .join(ends.withColumnRenamed("version_id", "to_version_id"), "item_id"))
    made = {"relation_id": F.concat(F.lit("rel:auto:SUPERSEDES:"), "by_id", F.lit("->"), "item_id"),
            "relation_type": F.lit("SUPERSEDES"), "from_item_id": F.col("by_id"), "to_item_id": F.col("item_id"),
            "epistemic_status": F.lit(v.WEAKEST_STATE), "rationale": F.lit("declared via supersedes_item_id"),
            "source_id": F.col("source_id"), "from_version_id": F.col("from_version_id"), "to_version_id": F.col("to_version_id"),
            "pin_backfilled": F.lit(False), "seed_id": F.lit(seed_id)}
    automatic = automatic.select(*[made.get(c, F.lit(None).cast("string")).alias(c) for c in bundles.RELATION_FIELDS]).withColumn(
        "record_hash", content_hash(v.RELATION_CONTENT))
    pinned_new = against.select(*[{"from_version_id": F.col("from_pin"), "to_version_id": F.col("to_pin"),
                                   "seed_id": F.coalesce("seed_id", F.lit(seed_id))}.get(c, F.col(c)).alias(c) for c in RELATIONS])
    incoming = pinned_new.unionByName(automatic.join(pinned_new.select("relation_id"), "relation_id", "left_anti").select(*RELATIONS))
    relations_both = written(_together(stored.relations, incoming, "relation_id", RELATIONS), "relations-both")
    # a relation is stored once: the pins of its first import stay
    new_relations = relations_both.select(*_picked(RELATIONS, F.col("o").isNotNull(), {}))

    # ---- counters
    def counted(both: DataFrame, label: str, names: dict[str, str]) -> DataFrame:
        return both.agg(*[F.count_if(F.col("outcome") == outcome).alias(f"{label}_{name}") for outcome, name in names.items()])

    usual = {"inserted": "inserted", "unchanged": "unchanged"}
    by_source = counted(sources_both, "sources", {**usual, "revised": "updated"})
    by_item = items_both.agg(
        *[F.count_if(F.col("outcome") == o).alias(f"items_{o}") for o in ("inserted", "unchanged", "revised")],
        F.count_if("newly").alias("items_superseded"),
        F.count_if(~here & (F.col("o.seed_id") == seed_id) & ~F.col("item_id").contains("@") & F.lit(not restore)).alias("not_in_this_seed"))
    explicit = ~F.coalesce(F.col("relation_id").startswith("rel:auto:SUPERSEDES:"), F.lit(False)) | F.lit(restore)
    by_relation = counted(relations_both.where(explicit), "relations", usual)
    counters = by_source.join(by_item).join(by_relation).select(*COUNTERS)
    after = Memory(new_sources.select(*SOURCES), _whole(all_items, claims), new_relations.select(*RELATIONS), all_items, claims)
    return Imported(True, after, errors, warnings, counters)


def export_lines(memory: Memory, manifest: dict[str, str]) -> DataFrame:
    """Lines of a lossless export: everything but the record hashes, which follow from the content."""
    drop = "record_hash"
    return bundles.bundle_export(memory.items.drop(drop), memory.sources.drop(drop), memory.relations.drop(drop), manifest)
