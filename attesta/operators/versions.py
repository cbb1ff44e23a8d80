"""Version chains, pinned relations, lineage and as-of capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import vocabulary as v
from attesta.functions.identity import content_hash, short_hash
from attesta.plans.scale import Running, lookup_join, never_sent, one_row_flag, running_values
from attesta.session import cut_lineage, written

REVISION_CONTENT = ["status", "price", "priority"]
# buckets follow the revision order (at, revision_no); ``at`` is a date, so a day is one bucket
REVISION_LEVELS = [["day"]]


def with_neighbours(revisions: DataFrame, values: list[str], earlier: bool = True, later: bool = True) -> DataFrame:
    """Previous (``earlier``) and next (``later``) revision of each one, exact for items with very many revisions."""
    order = ["at", "revision_no"]
    neighbour = F.struct(*values)
    out = running_values(revisions, ["logical_id"], order, {"earlier": Running("last", neighbour)}, REVISION_LEVELS)
    if later:
        out = running_values(out, ["logical_id"], order, {"later": Running("last", neighbour)}, REVISION_LEVELS,
                             reverse=True)
    return out


def next_revision(revisions: DataFrame, values: list[str]) -> DataFrame:
    return running_values(revisions, ["logical_id"], ["at", "revision_no"],
                          {"later": Running("last", F.struct(*values))}, REVISION_LEVELS, reverse=True)


def version_rows(revisions: DataFrame) -> DataFrame:
    """All versions of all logical items: the last one is current, older ones are archived under their version id.

    A revision is identified by its number, so that equal content at different times stays two versions.
    """
    rows = next_revision(revisions, ["revision_no"])
    full = content_hash(["logical_id", "revision_no", *REVISION_CONTENT])
    rows = rows.withColumn("record_hash", full)
    name = F.concat(F.lit("c"), F.col("logical_id"))
    vid = F.concat(name, F.lit("@"), short_hash(F.col("record_hash")))
    current = F.col("later").isNull()
    return rows.select(
        name.alias("logical_item_id"), vid.alias("version_id"), F.when(current, name).otherwise(vid).alias("item_id"),
        F.when(current, "ACTIVE").otherwise("SUPERSEDED").alias("lifecycle"),
        F.when(~current, name).alias("superseded_by"), current.alias("is_current_version"), "record_hash",
        "logical_id", "revision_no", "at", "day", *REVISION_CONTENT,
        F.col("later.revision_no").alias("next_revision"))


def one_row_per_version(rows: DataFrame) -> DataFrame:
    """Of several rows that hold one version the archived one is kept."""
    archived = (F.col("item_id") == F.col("version_id")).cast("int")
    others = [c for c in rows.columns if c != "version_id"]
    best = rows.groupBy("version_id").agg(F.max(F.struct(archived.alias("a"), F.col("item_id"))).alias("best"))
    return best.select("version_id", F.col("best.item_id").alias("item_id")) if others == ["item_id"] else rows.join(
        best.select("version_id", F.col("best.item_id").alias("item_id")), ["version_id", "item_id"])


def resolve_endpoints(relations: DataFrame, versions: DataFrame, row_key: str, ends: tuple[str, ...] = ("from", "to")) -> DataFrame:
    """Pinned endpoints with what they name; an endpoint that resolves to nothing is kept and marked.

    ``ends`` may be one end, for a table of pins that many relations share: it is resolved once, not for each relation.
    """
    out = relations
    for end in ends:
        dim = versions.select(F.col("version_id").alias(f"{end}_version_id"),
                              F.col("logical_item_id").alias(f"{end}_logical_id"),
                              F.col("lifecycle").alias(f"{end}_lifecycle"),
                              F.col("is_current_version").alias(f"{end}_is_current"))
        out = lookup_join(out, dim, [f"{end}_version_id"], [row_key], salts=1)
        out = out.withColumn(f"{end}_unresolved", F.col(f"{end}_logical_id").isNull())
    return out


def touching(relations: DataFrame, wanted: DataFrame, row_key: str, start: str, end: str, key: str) -> DataFrame:
    """Relations with a wanted item at either end, each once: two equality joins and a union."""
    keys = wanted.select(key).distinct()
    wanted_start, wanted_end = keys.withColumnRenamed(key, start), keys.withColumnRenamed(key, end)
    has_start, has_end = F.col(start).isNotNull(), F.col(end).isNotNull()
    # outgoing edges and the others come from one exchange of the relations that have both ends
    both = relations.where(has_start & has_end)
    outgoing = [lookup_join(rows, wanted_start, [start], [row_key], "left_semi", salts=1)
                for rows in (both, relations.where(has_start & ~has_end))]
    # an edge between two wanted items is kept on the outgoing side
    others = lookup_join(both, wanted_start, [start], [row_key], "left_anti", salts=1).unionByName(relations.where(~has_start & has_end))
    incoming = lookup_join(others, wanted_end, [end], [row_key], "left_semi", salts=1)
    return outgoing[0].unionByName(outgoing[1]).unionByName(incoming)


def mark_pins(pins: DataFrame, versions: DataFrame, row_key: str, end: str) -> DataFrame:
    """``{end}_of``: the logical items of ``versions`` that the pin of this end names; empty where it names none.

    For the relations themselves, or for a table of pins that many relations share."""
    named = versions.where(F.col("version_id").isNotNull()).groupBy(F.col("version_id").alias(f"{end}_version_id")).agg(
        F.collect_list(F.struct("logical_item_id")).alias(f"{end}_of"))
    return lookup_join(pins, named, [f"{end}_version_id"], [row_key], salts=1)


def _marked(relations: DataFrame, versions: DataFrame, row_key: str, kept: dict[str, Column]) -> DataFrame:
    """What the ends of the relations are, stored, as the directions and the loose ends are read from it: ``row_key``,
    ``kept`` (of ``from_of`` and ``to_of``), and the declared item of an end without a pin as ``{end}_loose``."""
    for end in ("from", "to"):
        if f"{end}_of" not in relations.columns:
            relations = mark_pins(relations, versions, row_key, end)
    loose = [F.when(F.col(f"{end}_version_id").isNull(), F.col(f"{end}_item_id")).alias(f"{end}_loose") for end in ("from", "to")]
    return written(relations.select(row_key, *[value.alias(name) for name, value in kept.items()], *loose), "marked-relations")


def edge_directions(relations: DataFrame, wanted: DataFrame, row_key: str) -> DataFrame:
    """Edges of a set of versions: outgoing and incoming by pin, unpinned ones by the declared item.

    ``relations`` may come with ends that ``mark_pins`` has marked already by the wanted versions."""
    names = wanted.select("item_id").distinct()
    directions = F.array_compact(F.array(F.when(F.size("from_of") > 0, "outgoing"), F.when(F.size("to_of") > 0, "incoming")))
    marked = _marked(relations, wanted, row_key, {"directions": directions})
    out = marked.select(row_key, F.explode("directions").alias("direction"))
    for column in ("from_loose", "to_loose"):
        hit = lookup_join(marked.where(F.col(column).isNotNull()).select(row_key, column), names.withColumnRenamed("item_id", column),
                          [column], [row_key], "left_semi", salts=1)
        out = out.unionByName(hit.select(row_key, F.lit("unpinned").alias("direction")))
    return out.distinct()


def lineage_heads(links: DataFrame, max_hops: int = 50) -> DataFrame:
    """Newest item reachable from every item over ``superseded_by``, for all items at once.

    Pointer jumping: each round doubles the distance, so 50 hops take six joins at most.  Only items that have a
    successor take part; an item without one, or with one that does not exist, is its own head.  ``links`` has
    (item_id, superseded_by); the result has (item_id, head_id, hops, over_bound_or_cyclic): a chain longer than
    the bound and a chain that meets itself are marked.
    """
    known = links.select(F.col("item_id").alias("superseded_by"), F.lit(True).alias("known"))
    base = cut_lineage(lookup_join(links.select("item_id", "superseded_by"), known, ["superseded_by"], ["item_id"], salts=1))
    alone = base.where(F.col("known").isNull()).select(
        "item_id", F.col("item_id").alias("head_id"), F.lit(0).cast("long").alias("hops"), F.lit(False).alias("over_bound_or_cyclic"))
    state = base.where("known").select("item_id", F.col("superseded_by").alias("head_id"), F.lit(1).cast("long").alias("hops"),
                                       F.lit(False).alias("done"))
    for _ in range(max(1, max_hops - 1).bit_length() + 1):
        ahead = state.select(F.col("item_id").alias("head_id"), F.col("head_id").alias("far_id"),
                             F.col("hops").alias("far_hops"), F.col("done").alias("far_done"))
        # a head that is no item with a successor ends the chain
        state = cut_lineage(lookup_join(state, ahead, ["head_id"], ["item_id"], salts=1).select(
            "item_id", F.when(F.col("done"), F.col("head_id")).otherwise(F.coalesce("far_id", "head_id")).alias("head_id"),
            F.when(F.col("done"), F.col("hops")).otherwise(F.col("hops") + F.coalesce("far_hops", F.lit(0))).alias("hops"),
            (F.col("done") | F.coalesce("far_done", F.lit(True))).alias("done")))
        if not one_row_flag(state.where(~F.col("done") & (F.col("hops") <= max_hops))):
            break
    over = ~F.col("done") | (F.col("hops") > max_hops)
    return alone.unionByName(state.select("item_id", "head_id", "hops", over.alias("over_bound_or_cyclic")))


def lineage_chains(links: DataFrame, max_hops: int = 50) -> DataFrame:
    """Every newer item of every item: ``item_id, hop, newer_id, repeats``, up to ``max_hops`` hops.

    Each round appends to a chain the chain of its last item, so chains double and 50 hops take six joins; a chain is
    one row until the end, and an item that very many others lead to is looked up, not grouped.  A successor that does
    not exist ends a chain.  ``repeats`` marks items that came before in the chain, or are its own beginning: a cycle
    is followed to the bound and can be seen.
    """
    known = links.select(F.col("item_id").alias("superseded_by"), F.lit(True).alias("known"))
    # both sides are about as large: neither is repeated
    first = lookup_join(links.select("item_id", "superseded_by"), never_sent(known), ["superseded_by"], ["item_id"], "inner", salts=1)
    state = cut_lineage(first.select("item_id", F.array("superseded_by").alias("chain")))
    length, salts, items = 1, 1, state.count()
    while length < max_hops:
        full = F.size("chain") == length
        if not one_row_flag(state.where(full)):
            break
        # a chain that has come to its end is looked up, but asks for nothing more
        ahead = state.select(F.col("item_id").alias("last"), F.col("chain").alias("more"))
        growing = state.where(full).withColumn("last", F.element_at("chain", -1))
        more = F.coalesce("more", F.array().cast(state.schema["chain"].dataType))
        longer = lookup_join(growing, ahead, ["last"], ["item_id"], salts=salts).select(
            "item_id", F.slice(F.concat("chain", more), 1, max_hops).alias("chain"))
        state = cut_lineage(state.where(~full).unionByName(longer))
        # items that repeat multiply the chains that meet them: those are spread
        salts = 8 if state.count() > items else 1
        length *= 2
    rows = state.select("item_id", "chain", F.posexplode("chain").alias("place", "newer_id"))
    before = (F.col("newer_id") == F.col("item_id")) | (F.array_position("chain", F.col("newer_id")) <= F.col("place"))
    return rows.select("item_id", (F.col("place") + 1).cast("long").alias("hop"), "newer_id", before.alias("repeats"))


def lineage_trace(items: DataFrame, sources: DataFrame, max_hops: int = 50) -> DataFrame:
    """``item_id, part, place, ref, detail`` of every item: its source as it is now, all newer items with their place in
    the chain, and the older ones that name it directly."""
    now = lookup_join(items.select("item_id", "source_id"), sources.select("source_id", "revision", "as_of"), ["source_id"],
                      ["item_id"], "inner")
    source = now.select("item_id", F.lit("source").alias("part"), F.lit(0).cast("long").alias("place"), F.col("source_id").alias("ref"),
                        F.concat_ws("/", "revision", "as_of").alias("detail"))
    what = items.select(F.col("item_id").alias("ref"), F.concat_ws("/", "lifecycle", "as_of").alias("detail"))
    chains = lineage_chains(items.select("item_id", "superseded_by"), max_hops)
    newer = chains.select("item_id", F.lit("newer").alias("part"), F.col("hop").alias("place"), F.col("newer_id").alias("ref"))
    older = items.where(F.col("superseded_by").isNotNull()).select(
        F.col("superseded_by").alias("item_id"), F.lit("older").alias("part"), F.lit(0).cast("long").alias("place"), F.col("item_id").alias("ref"))
    named = older.join(items.select("item_id"), "item_id", "left_semi")
    edges = lookup_join(newer.unionByName(named), what, ["ref"], ["item_id"], "inner")
    return source.unionByName(edges.select(*source.columns))


def as_of_values(left: DataFrame, right: DataFrame, keys: list[str], at: str, tie: str, value: Column,
                 levels: list[list[str]], row_key: str) -> DataFrame:
    """For each left row the latest right value at or before its time: union and one running value.

    Both sides need the columns of ``keys``, ``at``, ``tie`` and the buckets.  No pair of rows is ever built.
    """
    buckets = sorted({c for level in levels for c in level})
    events = right.select(*keys, at, tie, *buckets, F.lit(0).alias("side"), value.alias("seen"),
                          F.lit(None).cast(left.schema[row_key].dataType).alias(row_key))
    asks = left.select(*keys, at, tie, *buckets, F.lit(1).alias("side"),
                       F.lit(None).cast(events.schema["seen"].dataType).alias("seen"), row_key)
    merged = running_values(events.unionByName(asks), keys, [at, "side", tie],
                            {"value": Running("last", F.col("seen"))}, levels)
    return merged.where(F.col("side") == 1).select(row_key, *keys, at, "value")


def backfill_capture(stored: DataFrame, sources: DataFrame) -> DataFrame:
    """One-off migration: rows without capture take the source as it is now and are marked as backfilled."""
    dim = sources.select("source_id", *[F.col(c).alias(f"{f}_at_capture") for f, c in v.CAPTURE.items()])
    return lookup_join(stored, dim, ["source_id"], ["item_id"]).withColumn("capture_backfilled", F.lit(True))


def compare_snapshots(old: DataFrame, new: DataFrame, keys: list[str], full_hash: str = "record_hash") -> DataFrame:
    """inserted / unchanged / revised / absent per key, by the full content hash."""
    before = old.select(*keys, F.col(full_hash).alias("old_hash"))
    after = new.select(*keys, F.col(full_hash).alias("new_hash"))
    status = (F.when(F.col("old_hash").isNull(), "inserted").when(F.col("new_hash").isNull(), "absent")
              .when(F.col("old_hash") == F.col("new_hash"), "unchanged").otherwise("revised"))
    return before.join(after, keys, "full_outer").withColumn("outcome", status)


def trace(versions: DataFrame, relations: DataFrame, row_key: str) -> DataFrame:
    """Versions of each logical item and the edges of its current version, by direction.

    A current version never takes over the edges of older ones; an edge without a pin belongs to the declared item.
    """
    current = versions.where("is_current_version")
    marked = _marked(relations, current, row_key, {c: F.col(c) for c in ("relation_type", "from_of", "to_of")})
    out = versions.select("logical_item_id", F.lit("version").alias("part"), F.col("version_id").alias("ref"),
                          F.when(F.col("is_current_version"), "current").otherwise("archived").alias("detail"))
    for label, end in (("outgoing", "from"), ("incoming", "to")):
        edges = marked.select(F.explode(f"{end}_of.logical_item_id").alias("logical_item_id"), row_key, "relation_type")
        out = out.unionByName(edges.select("logical_item_id", F.lit(label).alias("part"), F.col(row_key).alias("ref"),
                                           F.col("relation_type").alias("detail")))
    for end in ("from", "to"):
        column = f"{end}_loose"
        loose = marked.where(F.col(column).isNotNull()).select(row_key, "relation_type", column)
        dim = current.select(F.col("item_id").alias(column), "logical_item_id")
        hit = lookup_join(loose, dim, [column], [row_key], "inner", salts=1)
        out = out.unionByName(hit.select("logical_item_id", F.lit("unpinned").alias("part"), F.col(row_key).alias("ref"),
                                         F.col("relation_type").alias("detail")))
    return out
