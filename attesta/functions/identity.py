"""Content hashes and version ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VERSION_ID = r"^(.*)@([0-9a-f]{14})$"


def content_json(fields: list[str | Column]) -> Column:
    """Ordered fields as one JSON array of strings; a missing field stays a ``null`` in its place."""
    return F.to_json(F.array(*[(F.col(f) if isinstance(f, str) else f).cast("string") for f in fields]))


def content_hash(fields: list[str | Column]) -> Column:
    """Full SHA-256 of the content; joins and comparisons always use this one."""
    return F.sha2(content_json(fields), 256)


def short_hash(full: Column) -> Column:
    return F.substring(full, 1, 14)


def version_id(logical: Column, full_hash: Column) -> Column:
    """``<logical id>@<14 hex digits>``, for display and for pins written by hand."""
    return F.concat(logical, F.lit("@"), short_hash(full_hash))


def version_parts(value: Column) -> tuple[Column, Column]:
    """Logical id and hash of a version id; both null when the text is not a version id."""
    matched = value.rlike(VERSION_ID)
    return (F.when(matched, F.regexp_extract(value, VERSION_ID, 1)),
            F.when(matched, F.regexp_extract(value, VERSION_ID, 2)))


def sha256_text(value: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(value, 256))


def blank_to_null(value: Column) -> Column:
    """Only the empty string counts as missing; blanks are kept as they are."""
    return F.nullif(value.cast("string"), F.lit(""))


def number_or_null(value: Column) -> Column:
    return F.nullif(value, F.lit("")).try_cast("double")
