"""Text helpers on built-in functions: clipping, terms, tokens with stems, markers, redaction."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Stop words and Russian endings in the order they are tried
STOP_WORDS = ("и в во на с со что это как или но не за от до по к из у о об же ли бы он она они мы я ты его ее их "
              "чем чего такой такая такое является есть был была были мой моя мое мои the a an of to is are and or "
              "what who how in on for with").split(" ")
RUSSIAN_ENDINGS = ["иями", "ями", "ами", "ого", "его", "ому", "ему", "ыми", "ими", "ией", "иях", "ешь", "ах", "ях",
                   "ую", "юю", "ая", "яя", "ое", "ее", "ые", "ие", "ий", "ый", "ой", "ей", "ом", "ем", "ам", "ям",
                   "ов", "ев", "ым", "им", "ью", "ть", "ет", "ют", "ут", "ит", "ят", "ал", "ил", "ла", "ло", "ли",
                   "но", "на", "ны", "а", "я", "о", "е", "ы", "и", "у", "ю", "ь", "й"]
TERM = r"[\p{L}\p{N}_]{2,}"
WORD = r"[\p{L}\p{N}][\p{L}\p{N}_'’-]*"
TOKEN = r"[a-zа-я0-9]+(?:[-_][a-zа-я0-9]+)*"
RUSSIAN_STEM = r"^([а-я]{3,}?)(?:" + "|".join(RUSSIAN_ENDINGS) + r")$"
PIECE = r"[^.\n]*[.\n]+|[^.\n]+"
FINE_PIECE = r"[^.,\n]*[.,\n]+|[^.,\n]+"


def clipped(text: Column, limit: int) -> Column:
    """At most ``limit`` code points, with an ellipsis where the text was cut."""
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("…"))).otherwise(text)


def is_clipped(text: Column, limit: int) -> Column:
    return F.coalesce(F.length(text) > limit, F.lit(False))


def clipped_fields(caps: dict[str, int]) -> Column:
    """Comma-separated names of the fields a bounded view has cut."""
    return F.concat_ws(",", *[F.when(is_clipped(F.col(f), cap), F.lit(f)) for f, cap in caps.items()])


def terms(text: Column) -> Column:
    """Search terms: runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def folded(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ё"), F.lit("е"))


def stem(word: Column) -> Column:
    """Russian: reflexive ending, then the first listed ending that leaves three letters.  English: plain suffixes."""
    bare = F.when(F.length(word) > 5, F.regexp_replace(word, r"(ся|сь)$", "")).otherwise(word)
    # the lazy group finds the longest ending; the list is ordered from long to short
    russian = F.when(bare.rlike(RUSSIAN_STEM), F.regexp_extract(bare, RUSSIAN_STEM, 1)).otherwise(bare)
    # plain string tests first: most Latin words are decided without a pattern
    size = F.length(word)
    ending = (F.when(word.endswith("ing"), 3).when(word.endswith("ed") | word.endswith("es"), 2)
              .when(word.endswith("s"), 1).otherwise(0))
    english = F.when((size > 4) & (ending > 0) & word.rlike("^[a-z]+$"), F.left(word, size - ending)).otherwise(word)
    return F.when(word < "а", english).when(word.rlike("^[а-я]+$"), russian).otherwise(word)


def tokens(text: Column) -> Column:
    """Stemmed tokens; hyphenated words count as a whole and by their parts."""
    return _expanded(F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0)))


def token_set(text: Column) -> Column:
    """Distinct tokens of a text; repeated words are dropped before they are stemmed."""
    return F.array_distinct(_expanded(F.array_distinct(F.regexp_extract_all(folded(text), F.lit(TOKEN), F.lit(0)))))


def _expanded(found: Column) -> Column:
    """Plain words by their stem; hyphenated ones as a whole and by the stems of their parts."""
    def kept(word: Column) -> Column:
        return (F.length(word) >= 2) & ~word.isin(STOP_WORDS)

    def parts(token: Column) -> Column:
        return F.concat(F.array(token), F.transform(F.filter(F.split(token, "[-_]"), kept), stem))

    def joined(token: Column) -> Column:
        return token.contains("-") | token.contains("_")

    plain = F.transform(F.filter(found, lambda t: ~joined(t) & kept(t)), stem)
    return F.concat(plain, F.flatten(F.transform(F.filter(found, joined), parts)))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def token_estimate(text: Column) -> Column:
    """Four characters to a token, rounded half up."""
    return F.floor(F.length(text) / 4 + F.lit(0.5)).cast("long")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(folded(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def redacted(text: Column, start: str, end: str, placeholder: str) -> Column:
    """Replace every completed span; a start without its end stays as it is."""
    literal = placeholder.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, "(?s)" + re.escape(start) + ".*?" + re.escape(end), literal)


def redacted_values(value: Column, kind: T.DataType, start: str, end: str, placeholder: str) -> Column:
    """``redacted`` for every string inside a value of any type: fields of structs, members of arrays, values of maps.

    A span must lie in one string; field names and keys of maps stay, and what is missing stays missing.
    """
    def inside(inner: Column, inner_kind: T.DataType) -> Column:
        return redacted_values(inner, inner_kind, start, end, placeholder)

    if not _has_strings(kind):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: inside(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: inside(x, kind.valueType))
    if isinstance(kind, T.StructType):
        fields = F.struct(*[inside(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
        return F.when(value.isNotNull(), fields)
    return redacted(value, start, end, placeholder)


def _has_strings(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_strings(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_strings(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_has_strings(f.dataType) for f in kind.fields)
    return isinstance(kind, T.StringType)


def redacted_frame(df: DataFrame, start: str, end: str, placeholder: str) -> DataFrame:
    """A diagnostic copy of a table: every string of every column, at any depth, with its finished spans replaced."""
    return df.select(*[redacted_values(F.col(f"`{f.name}`"), f.dataType, start, end, placeholder).alias(f.name) for f in df.schema.fields])


def without_suffix(text: Column, suffix: str) -> Column:
    """Strip an exact suffix as often as it is repeated."""
    return F.regexp_replace(text, "(?:" + re.escape(suffix) + r")+\z", "")


def without_block(text: Column, block: str, separator: str = "\n\n") -> Column:
    """Strip a block that was added behind a separator, as often as it is repeated; a text that is the block alone,
    which an empty text gets without a separator, becomes empty."""
    return F.when(text == block, "").otherwise(without_suffix(text, separator + block))


def json_value(raw: Column) -> Column:
    """Parsed JSON, null unless the whole text is one value.

    The parser stops after the first value; only one complete value is valid both as the element of an array
    and as the value of an object.
    """
    element = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))), "$", "array<variant>")
    field = F.try_parse_json(F.concat(F.lit('{"x":'), raw, F.lit("}")))
    return F.when((F.size(element) == 1) & field.isNotNull(), F.try_parse_json(raw))


def has_text(value: Column) -> Column:
    return F.coalesce(F.trim(value) != "", F.lit(False))


# Cues of the two planes a message can ask for (Russian and English)
WORKING_CUES = (r"где мы остановил|что (сейчас )?в работе|что осталось|заблокирован|следующий шаг|"
                r"рабоч[а-яё]* заметк|where did we (stop|leave)|in progress|what('| i)s blocked|next (step|action)|"
                r"working note")
RESEARCH_CUES = (r"эксперимент|исследован|\btce\b|доказательств|not_run|не проверен|research|evidence|candidate|"
                 r"кандидат|experiment")


def message_intent(text: Column, working: str = WORKING_CUES, research: str = RESEARCH_CUES) -> Column:
    work, study = text.rlike("(?iu)" + working), text.rlike("(?iu)" + research)
    return F.when(work & study, "MIXED").when(study, "RESEARCH").when(work, "WORKING").otherwise("DEFAULT")
