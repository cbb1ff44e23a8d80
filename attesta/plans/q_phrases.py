"""Registered queries: one scan for markers, question cues and private words."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import phrases as ph
from attesta.functions import text as tx
from attesta.operators.search_index import INTENTS
from attesta.plans.registry import query
from attesta.sources.lake import pick

# the eight marker types with words of the languages of the given texts
LEXICON = {"PROPOSAL_LET_US": ["de la", "in the"], "REQUEST_PLEASE": ["les", "le"], "QUESTION_MARK": [",", "?"],
           "CONSTRAINT_ONLY_EXACT": ["only", "der"], "CONDITIONAL_IF": ["und", "and"], "BECAUSE": ["que", "with"],
           "PREFERENCE_ALWAYS": ["dans", "un"], "OPTIONAL_CAN": ["est", "et"]}


def _count_sql(kind: str, words: list[str]) -> str:
    if kind == "QUESTION_MARK":
        return "len(regexp_extract_all(text, '[,?]'))"
    # each character between words is doubled, so that neighbours do not share one
    doubled = r"regexp_replace(' ' || lower(text) || ' ', '([^\p{L}\p{N}_])', '\1\1', 'g')"
    listed = "|".join(w.replace(" ", "  ") for w in words)
    return rf"len(regexp_extract_all({doubled}, '[^\p{{L}}\p{{N}}_]({listed})[^\p{{L}}\p{{N}}_]'))"


def _coverage_sql(table: str, key: str) -> str:
    parts = " UNION ALL ".join(f"SELECT {key}, '{k}' AS kind, {_count_sql(k, w)} AS n FROM {table}" for k, w in LEXICON.items())
    return (f"SELECT {key}, kind, count(*) AS messages, count(*) FILTER (WHERE n > 0) AS with_marker, "
            f"CAST(sum(n) AS BIGINT) AS hits FROM ({parts}) GROUP BY 1, 2")


def _coverage(rows, key):
    counts = F.map_from_entries(F.transform(F.array(*map(F.lit, LEXICON)), lambda k: F.struct(
        k, F.size(F.filter("found", lambda h: h["kind"] == k)))))
    found = rows.select(key, ph.phrase_hits(F.col("text"), ph.lexicon_phrases(LEXICON)).alias("found"))
    return found.select(key, F.explode(counts).alias("kind", "n")).groupBy(key, "kind").agg(
        F.count("*").alias("messages"), F.count_if(F.col("n") > 0).alias("with_marker"), F.sum("n").cast("long").alias("hits"))


@query("X13_marker_coverage", needs=("msg",), sql=_coverage_sql("msg", "speaker"))
def marker_coverage(lake):
    """Coverage of all eight marker types over all messages; a missed marker is not an absent act."""
    return _coverage(lake.messages().select("speaker", "text"), "speaker")


@query("X13_document_markers", sql=_coverage_sql("documents", "lang"))
def document_markers(lake):
    """The same scan over all documents by language."""
    return _coverage(lake.texts("documents", "doc_id").select("lang", "text"), "lang")


CUE_WORDS = ["who has it", "следующий шаг", "где искать источник", "what is open, what is done", "сейчас хочу", "почему отличается"]
BOOSTED = sorted({t for _, types, _ in INTENTS for t in types})


def _boost_sql() -> str:
    flags = ", ".join(f"regexp_matches(t, '{cue}') AS c{n}" for n, (cue, _, _) in enumerate(INTENTS))
    sums = []
    for name in BOOSTED:
        terms = " + ".join(f"CASE WHEN c{n} THEN {types[name]} ELSE 0 END" for n, (_, types, _) in enumerate(INTENTS) if name in types)
        sums.append(f"SELECT message_id, '{name}' AS type, round(CAST({terms} AS DOUBLE), 3) AS boost FROM f")
    words = ", ".join(f"'{w}'" for w in CUE_WORDS)
    return (f"WITH q AS (SELECT message_id, replace(lower(text || ' ' || list_extract([{words}], CAST(turn % {len(CUE_WORDS)} + 1 AS INT))), 'ё', 'е') AS t "
            f"FROM msg), f AS (SELECT message_id, {flags} FROM q) SELECT * FROM ({' UNION ALL '.join(sums)}) WHERE boost > 0")


@query("X8_intent_table", needs=("msg",), sql=_boost_sql())
def intent_table(lake):
    """What the cues of each message, with a question after it, add to each record type: one scan for the whole table."""
    asked = lake.messages().select("message_id", tx.folded(F.concat_ws(" ", "text", pick(CUE_WORDS, F.col("turn")))).alias("t"))
    cues = [p for n, (cue, _, _) in enumerate(INTENTS) for p in ph.cue_phrases(str(n), cue)]
    rows = asked.select("message_id", ph.phrase_kinds(F.col("t"), cues).alias("kinds"))
    boosts = F.create_map(*[x for n, (_, types, _) in enumerate(INTENTS) for x in (F.lit(str(n)), F.map_from_arrays(
        F.array(*map(F.lit, types)), F.array(*map(F.lit, types.values()))))])
    each = rows.select("message_id", F.explode("kinds").alias("kind")).select("message_id", F.explode(boosts[F.col("kind")]).alias("type", "b"))
    return each.groupBy("message_id", "type").agg(F.round(F.sum("b"), 3).alias("boost"))


LISTED = ["lytionver", "enstöung", "leau la", "TOKEN"]


@query("V20_listed_names", sql=" UNION ALL ".join(
    [f"SELECT doc_id, 'LISTED_WORD' AS rule FROM documents WHERE {' OR '.join(f'contains(lower(text), lower({w!r}))' for w in LISTED)}",
     f"SELECT doc_id, 'CREDENTIAL_WORD' FROM documents WHERE regexp_matches(lower(text), '({'|'.join(ph.CREDENTIAL_WORDS)})')",
     f"SELECT doc_id, 'PRIVATE_URL' FROM documents WHERE {' OR '.join(f'contains(text, {u!r})' for u in ph.PRIVATE_URLS)}"]))
def listed_names(lake):
    """A list of names, credential words and private addresses in one scan; the rule is reported, the text is not."""
    rows = lake.texts("documents", "doc_id").select("doc_id", ph.phrase_kinds(F.col("text"), ph.private_phrases(LISTED)).alias("kinds"))
    return rows.select("doc_id", F.explode("kinds").alias("rule"))
