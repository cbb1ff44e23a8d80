"""Many phrases found in one pass over a text: markers, question cues and private words as one automaton.

A phrase table is a list of literals with their kind and what must stand beside them.  Its automaton reads a text once,
whatever the number of phrases; Python sees hits only.  Offsets count code points of the text as it is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HIT_TYPE = "array<struct<kind:string,start_at:long,end_at:long,piece:string>>"
ANYTHING, WORD, BLANK = "", "w", "s"


@dataclass(frozen=True)
class Phrase:
    """A literal; ``left`` and ``right`` say what must be beside it: anything, a word's end, or a blank."""

    kind: str
    text: str
    left: str = WORD
    right: str = WORD
    exact_case: bool = False


# Marker types; the phrases are a lexicon of ours (Russian and English)
MARKER_PHRASES = {
    "PROPOSAL_LET_US": ["let's", "let us", "давай", "давайте"],
    "REQUEST_PLEASE": ["please", "пожалуйста", "скажи", "скажите"],
    "QUESTION_MARK": ["?"],
    "CONSTRAINT_ONLY_EXACT": ["only", "exactly", "только", "именно"],
    "CONDITIONAL_IF": ["if", "если"],
    "BECAUSE": ["because", "потому что"],
    "PREFERENCE_ALWAYS": ["always", "всегда"],
    "OPTIONAL_CAN": ["can", "may", "можно", "можешь"],
}
# Private places and credential words
PRIVATE_URLS = ["notion.so/", "notion.site/", "docs.google.com/", "drive.google.com/"]
CREDENTIAL_WORDS = ["password", "passwd", "apikey", "api_key", "api-key", "secret", "token", "bearer"]


def lexicon_phrases(lexicon: dict[str, list[str]]) -> list[Phrase]:
    """Whole words or word groups; what is no word (a question mark) may stand beside anything."""
    return [Phrase(kind, text, WORD if _in_word(text[0]) else ANYTHING, WORD if _in_word(text[-1]) else ANYTHING)
            for kind, texts in lexicon.items() for text in texts]


def cue_phrases(kind: str, cue: str) -> list[Phrase]:
    """Phrases of an alternation of literals, each of which may begin or end with a word boundary or a blank."""
    out = []
    for part in cue.replace(r"(^|\s)", "\x01").replace(r"(\s|$)", "\x02").split("|"):
        left = WORD if part.startswith(r"\b") else BLANK if part.startswith("\x01") else ANYTHING
        right = WORD if part.endswith(r"\b") else BLANK if part.endswith("\x02") else ANYTHING
        out.append(Phrase(kind, part.replace(r"\b", "").strip("\x01\x02"), left, right))
    return out


def private_phrases(listed: Iterable[str] = ()) -> list[Phrase]:
    """Private addresses, credential words, and a given list of names of any length (case does not matter)."""
    return [*[Phrase("PRIVATE_URL", u, ANYTHING, ANYTHING, exact_case=True) for u in PRIVATE_URLS],
            *[Phrase("CREDENTIAL_WORD", w, ANYTHING, ANYTHING) for w in CREDENTIAL_WORDS],
            *[Phrase("LISTED_WORD", w, ANYTHING, ANYTHING) for w in listed]]


def _in_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def _beside(text: str, at: int, asked: str) -> bool:
    if asked == ANYTHING or not 0 <= at < len(text):
        return True
    return text[at].isspace() if asked == BLANK else not _in_word(text[at])


def _same_length_lower(text: str) -> str:
    """Lower case with one code point for each, so that offsets stay; a letter whose lower case is longer (İ) is itself."""
    lowered = text.lower()
    return lowered if len(lowered) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


@lru_cache(maxsize=16)
def _automaton(phrases: tuple[Phrase, ...]):
    import ahocorasick
    found = ahocorasick.Automaton()
    by_text: dict[str, list[Phrase]] = {}
    for p in phrases:
        by_text.setdefault(_same_length_lower(p.text), []).append(p)
    for text, same in by_text.items():
        found.add_word(text, (len(text), same))
    if by_text:
        found.make_automaton()
    return found


def hits(text: str, phrases: tuple[Phrase, ...]) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) by place; hits of one kind do not overlap: the first one counts, of two at a place the longer."""
    found = _automaton(phrases)
    if not len(found):
        return
    every = []
    for last, (size, same) in found.iter(_same_length_lower(text)):
        start, end = last + 1 - size, last + 1
        for p in same:
            if (_beside(text, start - 1, p.left) and _beside(text, end, p.right)
                    and (not p.exact_case or text[start:end] == p.text)):
                every.append((start, -end, p.kind))
    ends: dict[str, int] = {}
    for start, minus_end, kind in sorted(set(every)):
        if start >= ends.get(kind, 0):
            ends[kind] = -minus_end
            yield kind, start, -minus_end


def phrase_hits(text: Column, phrases: Iterable[Phrase]) -> Column:
    """All hits of a text with kind, offsets and piece, in the order of the text; null for a missing text."""
    table = tuple(phrases)
    if any(not p.text for p in table):
        raise ValueError("a phrase must not be empty")

    @F.pandas_udf(HIT_TYPE)
    def find(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else [
            {"kind": kind, "start_at": start, "end_at": end, "piece": t[start:end]} for kind, start, end in hits(t, table)])

    return find(text)


def phrase_kinds(text: Column, phrases: Iterable[Phrase]) -> Column:
    """Sorted kinds that occur in a text, without the text; empty for a missing one."""
    table = tuple(phrases)

    @F.pandas_udf("array<string>")
    def kinds(values: pd.Series) -> pd.Series:
        return values.map(lambda t: [] if t is None else sorted({kind for kind, _, _ in hits(t, table)}))

    return kinds(text)
