"""Documents that break the contract in one way each."""

import pytest
from pyspark.sql import functions as F

from attesta.operators import cards

HEAD = ["# Index", "STATUS: `RESEARCH_INDEX_ONLY`", "CANON=NO", "RUNTIME_AUTHORITY: `NO`\\", "PRIMARY_EVIDENCE=NO"]
CARD = ["### 1. First", "STATUS: open", "EXECUTION_VERDICT: NOT_RUN", "PRIMARY_EVIDENCE: here"]


def text(head=HEAD, body=CARD, section="## C. Cards"):
    return "\n".join([*head, "", section, *body, "## D. End", "CANON=YES"])


CASES = {
    "fine": (text(), "OK"),
    "combined": (text([*HEAD[:2], "CANON=NO RUNTIME_AUTHORITY=NO", *HEAD[4:]]), "AUTHORITY_CONTRACT_INVALID"),
    "spaced": (text([HEAD[0], HEAD[1], "CANON = NO", *HEAD[3:]]), "AUTHORITY_CONTRACT_INVALID"),
    "one tick": (text([HEAD[0], HEAD[1], "CANON: `NO", *HEAD[3:]]), "AUTHORITY_CONTRACT_INVALID"),
    "twice": (text([*HEAD, "CANON=NO"]), "AUTHORITY_CONTRACT_INVALID"),
    "prose": (text([*HEAD, "note: CANON=NO holds"]), "AUTHORITY_CONTRACT_INVALID"),
    "no section": (text(section="## B. Cards"), "NOT_AN_EVIDENCE_INDEX"),
    "empty": ("", "INDEX_UNAVAILABLE"),
    "no cards": (text(body=["text"]), "NO_CARDS_PARSED"),
    "same number": (text(body=CARD + CARD), "DUPLICATE_CARD_NUMBER"),
    "blank field": (text(body=[*CARD[:2], "EXECUTION_VERDICT:  ", CARD[3]]), "MALFORMED_CARDS"),
    "unknown line": (text(body=[*CARD, "what is this"]), "UNSUPPORTED_CARD_CONTENT"),
    "field twice": (text(body=[*CARD, "STATUS: closed"]), "UNSUPPORTED_CARD_CONTENT"),
}


def test_validity_ladder(spark):
    documents = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()], "doc string, text string")
    lines = cards.card_lines(documents, "doc", F.col("text"))
    rows = cards.cards(lines, cards.card_fields(lines, "doc"), "doc")
    got = {r.doc: r.parse_status for r in cards.document_status(documents, rows, "doc", F.col("text")).collect()}
    assert got == {k: want for k, (_, want) in CASES.items()}


@pytest.mark.parametrize("line, want", [
    ("GITHUB_REF: a b NOTION_REF: c DRIVE_REF: d\\", {"GITHUB_REF": "a b", "NOTION_REF": "c", "DRIVE_REF": "d"}),
    ("GITHUB_REF: a DRIVE_REF: d NOTION_REF: c", {"GITHUB_REF": "a", "DRIVE_REF": "d", "NOTION_REF": "c"}),
    ("GITHUB_REF: a", {"GITHUB_REF": "a"}),
    ("NOTION_STATUS: x CONSISTENCY: `MATCH`. LAST_VERIFIED: y", {"NOTION_STATUS": "x", "CONSISTENCY": "`MATCH`.", "LAST_VERIFIED": "y"}),
    ("NOTES: DRIVE_REF: not split", {"NOTES": "DRIVE_REF: not split"}),
])
def test_inline_fields(spark, line, want):
    documents = spark.createDataFrame([("d", text(body=[*CARD, line]))], "doc string, text string")
    fields = cards.card_fields(cards.card_lines(documents, "doc", F.col("text")), "doc")
    got = {r.field: r.value for r in fields.collect()}
    assert {k: got.get(k) for k in want} == want and None not in got


def test_inline_flags_keep_their_value(spark):
    """A flag inside prose is a problem of its own; its value counts as a declaration like any other."""
    heads = [[*HEAD[:2], "see CANON=NO here", *HEAD[3:]], [*HEAD, "see CANON=NO here"], [*HEAD, "see CANON=YES here"],
             [*HEAD[:2], "see CANON: here", *HEAD[3:]]]
    rows = spark.createDataFrame([(i, text(h)) for i, h in enumerate(heads)], "id long, text string")
    got = {r.id: r.problems for r in cards.with_authority_problems(rows, "text").collect()}
    assert got[0] == ["CANON:INLINE"]
    assert got[1] == ["CANON:DUPLICATE", "CANON:INLINE"]
    assert got[2] == ["CANON:CONFLICTING", "CANON:INLINE"]
    assert got[3] == ["CANON:INLINE", "CANON:WRONG_VALUE"]
