"""Spans of whole texts by code point, and their arithmetic."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN_TYPE = "array<struct<pos:long,start_at:long,end_at:long,piece:string>>"
TEXTS_AT_ONCE = 64
MARKER_TYPE = "array<struct<kind:string,start_at:long,end_at:long,piece:string>>"


def pieces(text: Column, pattern: str) -> Column:
    """Consecutive pieces of a text with their offsets.

    Arrow-batched: running offsets inside a row would cost the square of the number of pieces with array
    functions, and a window would shuffle the texts.  A batch is cut a few texts at a time straight into Arrow columns,
    so Python objects exist for those only, however many rows the session puts into a batch.
    """
    compiled = re.compile(pattern)

    @F.arrow_udf(SPAN_TYPE)
    def cut(values: pa.Array) -> pa.Array:
        def some(texts: list) -> pa.Array:
            upto, pos, start, end, piece = [0], [], [], [], []
            for t in texts:
                for i, m in enumerate(() if t is None else compiled.finditer(t)):
                    pos.append(i)
                    start.append(m.start())
                    end.append(m.end())
                    piece.append(m.group())
                upto.append(len(pos))
            spans = pa.StructArray.from_arrays(
                [pa.array(pos, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(piece, pa.string())],
                ["pos", "start_at", "end_at", "piece"])
            return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), spans, mask=pa.array([t is None for t in texts], pa.bool_()))

        return pa.concat_arrays([some(values.slice(n, TEXTS_AT_ONCE).to_pylist()) for n in range(0, max(1, len(values)), TEXTS_AT_ONCE)])

    return cut(text)


def markers(text: Column, lexicon: dict[str, str]) -> Column:
    """All marker hits of a text with their offsets, by the order of the lexicon and then by place."""
    compiled = [(kind, re.compile(pattern)) for kind, pattern in lexicon.items()]

    @F.pandas_udf(MARKER_TYPE)
    def find(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else [
            {"kind": kind, "start_at": m.start(), "end_at": m.end(), "piece": m.group()}
            for kind, pattern in compiled for m in pattern.finditer(t)])

    return find(text)


# Marker types; the patterns are a lexicon of ours (Russian and English)
MARKER_LEXICON = {
    "PROPOSAL_LET_US": r"(?i)\b(let's|let us|давай(те)?)\b",
    "REQUEST_PLEASE": r"(?i)\b(please|пожалуйста|скажи(те)?)\b",
    "QUESTION_MARK": r"\?",
    "CONSTRAINT_ONLY_EXACT": r"(?i)\b(only|exactly|только|именно)\b",
    "CONDITIONAL_IF": r"(?i)\b(if|если)\b",
    "BECAUSE": r"(?i)\b(because|потому что)\b",
    "PREFERENCE_ALWAYS": r"(?i)\b(always|всегда)\b",
    "OPTIONAL_CAN": r"(?i)\b(can|may|можно|можешь)\b",
}


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Share of the common characters in all characters of two spans."""
    common = overlap(a_start, a_end, b_start, b_end)
    return F.try_divide(common.cast("double"), ((a_end - a_start) + (b_end - b_start) - common).cast("double"))
