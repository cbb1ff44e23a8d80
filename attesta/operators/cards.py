"""Cards out of semi-structured documents: lines, headings, flags, fields and the fail-closed validity ladder."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import vocabulary as v
from attesta.functions.rules import Rule, first_violation
from attesta.plans.scale import Running, running_values

LINE_LEVELS = [["line_block"]]
HEADING = r"^### (\d+)\. (.+?)\s*$"


def document_lines(documents: DataFrame, key: str, text: Column, separator: str = "\r?\n") -> DataFrame:
    """(document, line number, line) of whole documents."""
    lines = documents.select(F.col(key), F.posexplode(F.split(text, separator)).alias("pos", "line"))
    return lines.select(key, F.col("pos").cast("long").alias("line_no"), F.shiftright("pos", 10).alias("line_block"), "line")


def carry_headings(lines: DataFrame, key: str, heading: Column) -> DataFrame:
    """The last heading at or above each line."""
    return running_values(lines, [key], ["line_no"], {"heading": Running("last", heading, inclusive=True)}, LINE_LEVELS)


# ---- authority flags --------------------------------------------------------
def _line_flags(line: Column) -> Column:
    """Declarations of one header line: strict forms carry their value, all others are marked."""
    keys = list(v.AUTHORITY_FLAGS)
    declared = []
    for key in keys:
        colon = F.regexp_extract(line, f"^{key}: `([A-Za-z0-9_]+)`\\\\?[ \\t]*$", 1)
        equals = F.regexp_extract(line, f"^{key}=([A-Za-z0-9_]+)\\\\?[ \\t]*$", 1)
        value = F.when(colon != "", colon).when(equals != "", equals)
        declared.append(F.when(line.rlike(f"^{key}\\s*[:=]"), F.struct(
            F.lit(key).alias("key"), F.coalesce(value, F.lit("<ambiguous>")).alias("value"),
            F.when(value.isNull(), "AMBIGUOUS").alias("problem"))))
    strict = F.filter(F.array(*declared), lambda d: d.isNotNull())
    inline = r"(?<![A-Za-z0-9_])(" + "|".join(keys) + r")\s*[:=]\s*`?([A-Za-z0-9_]*)"
    loose = F.zip_with(
        F.regexp_extract_all(line, F.lit(inline), F.lit(1)), F.regexp_extract_all(line, F.lit(inline), F.lit(2)),
        lambda k, value: F.struct(k.alias("key"), F.when(value == "", "<inline>").otherwise(value).alias("value"),
                                  F.lit("INLINE").alias("problem")))
    return F.when(F.size(strict) > 0, strict).otherwise(loose)


def with_authority_problems(documents: DataFrame, text: str, name: str = "problems") -> DataFrame:
    """Add the sorted problems ``KEY:PROBLEM`` of the header block; an empty array means the contract holds.

    Works inside the row: a document is read as a whole and nothing is shuffled.  The intermediate columns are
    used several times and stand in projections of their own, so each is computed once.
    """
    rows = documents.withColumn("__header", F.split(F.regexp_extract(
        text, r"(?s)\A(.*?)(?:(?:^|\r?\n)## .*)?\z", 1), "\r?\n"))
    rows = rows.withColumn("__flags", F.flatten(F.transform("__header", _line_flags)))
    problems = [p for key, required in v.AUTHORITY_FLAGS.items() for p in _key_problems(F.col("__flags"), key, required)]
    return rows.withColumn(name, F.array_sort(F.flatten(F.array(*problems)))).drop("__header", "__flags")


def _key_problems(found: Column, key: str, required: str) -> list[Column]:
    own = F.filter(found, lambda d: d["key"] == key)
    values = F.array_distinct(F.transform(own, lambda d: d["value"]))
    marked = F.filter(F.transform(own, lambda d: F.concat(F.lit(f"{key}:"), d["problem"])), lambda p: p.isNotNull())
    wrong = (F.get(values, 0) != required) & (F.get(values, 0) != "<ambiguous>")
    verdict = (F.when(F.size(own) == 0, f"{key}:MISSING").when(F.size(values) > 1, f"{key}:CONFLICTING")
               .when(F.size(own) > 1, f"{key}:DUPLICATE").when(wrong, f"{key}:WRONG_VALUE"))
    return [F.array_distinct(marked), F.array_compact(F.array(verdict))]


# ---- cards ------------------------------------------------------------------
def card_lines(documents: DataFrame, key: str, text: Column) -> DataFrame:
    """Lines of section C with the card they belong to; a card is known by the line of its heading."""
    lines = document_lines(documents, key, text)
    section = F.col("line").startswith("## ")
    wanted = F.col("line").rlike(r"^## C\. ")
    heading = F.col("line").rlike(HEADING)
    marked = running_values(lines, [key], ["line_no"], {
        "in_cards": Running("last", F.when(section, wanted), inclusive=True),
        "section_line": Running("last", F.when(section, F.col("line_no")), inclusive=True),
        "card_line": Running("last", F.when(heading, F.col("line_no")), inclusive=True)}, LINE_LEVELS)
    inside = F.coalesce("in_cards", F.lit(False)) & ~section & (F.col("card_line") > F.col("section_line"))
    return marked.where(inside).withColumn("is_heading", heading).select(key, "card_line", "line_no", "line", "is_heading")


def card_fields(lines: DataFrame, key: str) -> DataFrame:
    """Field values and unrecognised lines of each card; listed followers may share the line of a leading field."""
    names = "|".join(re.escape(f) for f in v.CARD_FIELDS)
    line = F.col("line")
    body = lines.where(~F.col("is_heading") & (F.trim("line") != ""))
    lead = F.regexp_extract(line, f"^({names}):", 1)
    rest = F.regexp_replace(F.substring(line, F.length(lead) + 2, F.length(line)), r"\\\s*$", "")
    rows = body.withColumn("lead", lead).withColumn("rest", F.when(F.col("lead") != "", rest))
    marks = []
    for leader, followers in v.CARD_INLINE.items():
        for name in followers:
            pattern = r"(?:^|\s)" + name + r":(?:\s|$)"
            at = F.regexp_instr("rest", F.lit(pattern))
            marks.append(F.when((F.col("lead") == leader) & (at > 0), F.struct(
                at.alias("at"), (at + F.length(F.regexp_substr("rest", F.lit(pattern)))).alias("value_from"), F.lit(name).alias("key"))))
    rows = rows.withColumn("marks", F.array_sort(F.array_compact(F.array(*marks))))
    # the leading field ends where the first follower starts, each follower ends at the next one
    starts = F.concat(F.array(F.struct(F.lit(1).alias("at"), F.lit(1).alias("value_from"), F.col("lead").alias("key"))), F.col("marks"))
    ends = F.concat(F.transform("marks", lambda m: m["at"]), F.array(F.length("rest") + 1))
    values = F.zip_with(starts, ends, lambda s, e: F.struct(
        s["key"].alias("field"), F.trim(F.substring(F.col("rest"), s["value_from"], F.greatest(e - s["value_from"], F.lit(0)))).alias("value")))
    unknown = F.array(F.struct(F.lit(None).cast("string").alias("field"), F.left(F.trim("line"), F.lit(80)).alias("value")))
    return rows.select(key, "card_line", "line_no", F.posexplode(F.when(F.col("lead") != "", values).otherwise(unknown)).alias("place", "f")).select(
        key, "card_line", "line_no", "place", "f.field", "f.value")


def cards(lines: DataFrame, fields: DataFrame, key: str) -> DataFrame:
    """One row per card: number, title, a map of its fields (the first value wins) and its issues.

    A card has one entry per known field name at most, so the map and the lists are bounded by the field list.
    """
    heads = lines.where("is_heading").select(
        key, "card_line", F.regexp_extract("line", HEADING, 1).cast("long").alias("card_number"),
        F.regexp_extract("line", HEADING, 2).alias("title"))
    per_field = fields.groupBy(key, "card_line", "field").agg(
        F.min_by("value", F.struct("line_no", "place")).alias("value"), F.count("*").alias("times"))
    known = F.col("field").isNotNull()
    per_card = per_field.groupBy(key, "card_line").agg(
        F.map_from_entries(F.collect_list(F.when(known, F.struct("field", "value")))).alias("fields"),
        F.array_sort(F.collect_list(F.when(known & (F.col("times") > 1), F.col("field")))).alias("duplicate_fields"),
        F.sum(F.when(known, 0).otherwise(F.col("times"))).alias("unrecognised_lines"))
    out = heads.join(per_card, [key, "card_line"], "left")
    required = F.array(*[F.lit(f) for f in v.CARD_REQUIRED])
    blank = F.filter(required, lambda f: F.coalesce(F.trim(F.element_at("fields", f)), F.lit("")) == "")
    return out.withColumn("missing_fields", blank)


def document_status(documents: DataFrame, card_rows: DataFrame, key: str, text: Column) -> DataFrame:
    """Parse status of every document: the first failing gate, or OK.  No card of a failing document is served."""
    numbers = card_rows.groupBy(key, "card_number").agg(
        F.count("*").alias("times"), F.count_if(F.size("missing_fields") > 0).alias("malformed"),
        F.count_if((F.coalesce("unrecognised_lines", F.lit(0)) > 0) | (F.coalesce(F.size("duplicate_fields"), F.lit(0)) > 0)).alias("unsupported"))
    per_document = numbers.groupBy(key).agg(F.sum("times").alias("cards"), F.max("times").alias("most"),
                                            F.sum("malformed").alias("malformed"), F.sum("unsupported").alias("unsupported"))
    looks = F.coalesce(text.contains("RESEARCH_INDEX_ONLY") & text.rlike(r"(?m)^## C\. "), F.lit(False))
    checked = with_authority_problems(documents.withColumn("__text", text), "__text")
    base = checked.select(key, text.isNull().alias("no_text"), (text == "").alias("blank"), looks.alias("looks"),
                          F.size("problems").alias("problems"))
    rows = base.join(per_document, key, "left")
    ladder = [
        Rule("INDEX_UNAVAILABLE", F.col("no_text") | F.col("blank")),
        Rule("NOT_AN_EVIDENCE_INDEX", ~F.col("looks")),
        Rule("AUTHORITY_CONTRACT_INVALID", F.col("problems") > 0),
        Rule("NO_CARDS_PARSED", F.col("cards").isNull()),
        Rule("DUPLICATE_CARD_NUMBER", F.col("most") > 1),
        Rule("MALFORMED_CARDS", F.col("malformed") > 0),
        Rule("UNSUPPORTED_CARD_CONTENT", F.col("unsupported") > 0),
    ]
    return rows.select(key, first_violation(ladder, "OK").alias("parse_status"))
