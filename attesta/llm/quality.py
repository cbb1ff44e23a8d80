"""Quality rules: a threshold table compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.common import BLANK, HAS_WORD, WORD

WINDOW = 8

# common words of the four languages
STOP_WORDS = sorted(set((
    "the of and to a in is that it for on was with as be this by at are from "
    "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les des en un du une que est pour qui dans par sur au plus ne "
    "el y los se del las por con no una su para es al lo").split()))


@dataclass(frozen=True)
class Rule:
    """A document passes if ``low <= metric <= high``; a missing bound is no bound."""

    metric: str
    low: float | None = None
    high: float | None = None


# thresholds of the method's own verdict; ratios are per word or per line that holds a word
RULES = (
    Rule("n_words", 20, None),
    Rule("mean_word_chars", 2.5, 12.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("shout_ratio", None, 0.5),
    Rule("stop_words", 2, None),
    Rule("stop_word_ratio", 0.03, None),
    Rule("dup_line_ratio", None, 0.4),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("ellipsis_line_ratio", None, 0.3),
)


def _bind(value: Column, body) -> Column:
    """``body`` over ``value`` computed once for a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """Words that lie in an 8-word window found at least twice in the text.

    Equal windows have equal hashes, so a text whose window hashes are all different has none.  Otherwise the windows
    themselves are sorted; equal neighbours are repeats, and the positions they cover are added up in order.
    """
    last = F.size(words) - WINDOW + 1
    places = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(
        F.array().cast("array<int>"))
    hashes = F.transform(places, lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    keyed = F.array_sort(F.transform(places, lambda i: F.struct(
        F.array_join(F.slice(words, i, WINDOW), " ").alias("k"), i.alias("i"))))

    def repeated(rows):
        def place(row, j):
            before = F.when(j > 0, F.get(rows, j - 1)["k"])
            same = row["k"].eqNullSafe(before) | row["k"].eqNullSafe(F.get(rows, j + 1)["k"])
            return F.when(same, row["i"])
        return F.array_sort(F.filter(F.transform(rows, place), lambda p: p.isNotNull()))

    def covered(state, p):
        return F.struct((state["n"] + F.least(F.lit(WINDOW), p - state["last"])).alias("n"), p.alias("last"))

    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    total = F.aggregate(_bind(keyed, repeated), start, covered, lambda state: state["n"])
    unlike = _bind(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(unlike, F.lit(0)).otherwise(total)


def _word_metrics(words: Column) -> Column:
    return F.struct(
        F.size(words).alias("n_words"),
        _repeat_words(words).alias("n_repeat_words"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))).alias("stop_words"))


def _line_metrics(lines: Column) -> Column:
    def share(pattern):
        return F.size(F.filter(lines, lambda line: line.rlike(pattern)))
    return F.struct(
        F.size(lines).alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
        share(r"^[\x20\x09-\x0D]*[-*•]").alias("bullet_lines"),
        share(r"(\.\.\.|…)[\x20\x09-\x0D]*$").alias("ellipsis_lines"))


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def measured(docs: DataFrame) -> DataFrame:
    """``doc_id`` and all metrics of every whole text; a missing text has no words and no lines."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = _bind(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), _word_metrics)
    lines = _bind(F.filter(F.split(text, "\n"), lambda line: line.rlike(HAS_WORD)), _line_metrics)
    base = docs.select(
        "doc_id", words.alias("w"), lines.alias("l"),
        F.length(F.regexp_replace(text, BLANK, "")).alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[!?]{2,}")).alias("shouts"))
    flat = base.select("doc_id", "w.*", "l.*", "word_chars", "n_symbols", "shouts")
    return flat.withColumns({
        "mean_word_chars": _ratio("word_chars", "n_words"),
        "symbol_ratio": _ratio("n_symbols", "n_words"),
        "shout_ratio": _ratio("shouts", "n_words"),
        "stop_word_ratio": _ratio("stop_words", "n_words"),
        "dup_line_ratio": _ratio("n_dup_lines", "n_lines"),
        "bullet_line_ratio": _ratio("bullet_lines", "n_lines"),
        "ellipsis_line_ratio": _ratio("ellipsis_lines", "n_lines")})


def passes(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one boolean expression over the metrics."""
    verdict = F.lit(True)
    for rule in rules:
        if rule.low is not None:
            verdict = verdict & (F.col(rule.metric) >= F.lit(rule.low))
        if rule.high is not None:
            verdict = verdict & (F.col(rule.metric) <= F.lit(rule.high))
    return verdict


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document with its counts, ``base_failed`` and ``kept``; rows with equal ids are judged each on
    their own, and nothing is shuffled."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return (measured(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passes(rules))
            .select("doc_id", *[F.col(c).cast("long").alias(c) for c in counts], "base_failed", "kept"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their own columns, in one scan."""
    row = F.struct(*[F.col(c) for c in docs.columns])
    packed = docs.select(row.alias("doc_id"), F.col("text"))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return measured(packed).where(~failed & passes(rules)).select("doc_id.*")
