"""Registered queries: text functions and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.operators import retrieval as rt
from attesta.operators import search_index as si
from attesta.plans.q_reference import CAVEATS_SQL, EVIDENCE_SQL
from attesta.plans.registry import query


STOP_SQL = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
STEM_SQL = f"""CASE WHEN regexp_matches(p, '^[а-я]+$') THEN
    CASE WHEN regexp_matches(CASE WHEN length(p) > 5 THEN regexp_replace(p, '(ся|сь)$', '') ELSE p END, '{tx.RUSSIAN_STEM}')
      THEN regexp_extract(CASE WHEN length(p) > 5 THEN regexp_replace(p, '(ся|сь)$', '') ELSE p END, '{tx.RUSSIAN_STEM}', 1)
      ELSE CASE WHEN length(p) > 5 THEN regexp_replace(p, '(ся|сь)$', '') ELSE p END END
  WHEN regexp_matches(p, '^[a-z]+$') AND length(p) > 4 THEN regexp_replace(p, '(ing|ed|es|s)$', '') ELSE p END"""


def token_sql(source: str, key: str, text: str) -> str:
    """One row per token of each record, as a list of common tables."""
    return f"""found AS (SELECT {key} AS id, unnest(regexp_extract_all(replace(lower({text}), 'ё', 'е'),
        '{tx.TOKEN}')) AS t FROM {source}),
      split AS (SELECT id, t, unnest(regexp_split_to_array(t, '[-_]')) AS p FROM found),
      tok AS (SELECT id, {STEM_SQL} AS term FROM split WHERE length(p) >= 2 AND p NOT IN ({STOP_SQL})
        UNION ALL SELECT id, t FROM found WHERE regexp_matches(t, '[-_]'))"""


@query("X4_clip", sql="""
SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '…' ELSE text END AS clipped, length(text) > 200 AS truncated,
       length(text) AS total_chars FROM documents""")
def clip(lake):
    text = F.col("text")
    return lake.table("documents").select("doc_id", tx.clipped(text, 200).alias("clipped"), tx.is_clipped(text, 200).alias("truncated"),
                                          F.length(text).cast("long").alias("total_chars"))


@query("X6_terms", sql=r"""
SELECT doc_id, len(t) AS terms, len(list_distinct(t)) AS distinct_terms, array_to_string(t, ' ') AS all_terms
FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]{2,}') AS t FROM documents)""")
def terms(lake):
    rows = lake.table("documents").select("doc_id", tx.terms(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("terms"), F.size(F.array_distinct("t")).cast("long").alias("distinct_terms"),
                       F.concat_ws(" ", "t").alias("all_terms"))


@query("X7_stemmed_tokens", sql="WITH " + token_sql("documents", "doc_id", "text") + """
SELECT id AS doc_id, term, count(*) AS n FROM tok GROUP BY 1, 2""")
def stemmed_tokens(lake):
    return rt.counted_terms(lake.texts("documents", "doc_id").select("doc_id", "text"), "doc_id", tx.tokens(F.col("text")), "n")


@query("X7_russian_stems", sql="WITH words AS (SELECT o_orderkey, list_extract(['исследованиями', 'открытого', 'занимается', 'проверенный', 'ёлка', 'ABC-01'], "
       "CAST(o_orderkey % 6 + 1 AS INT)) || ' ' || o_orderstatus AS w FROM orders), " + token_sql("words", "o_orderkey", "w") + """
SELECT id AS o_orderkey, term, count(*) AS n FROM tok GROUP BY 1, 2""")
def russian_stems(lake):
    from attesta.sources.lake import pick
    words = ["исследованиями", "открытого", "занимается", "проверенный", "ёлка", "ABC-01"]
    rows = lake.table("orders").select("o_orderkey", F.concat_ws(" ", pick(words, F.col("o_orderkey")), "o_orderstatus").alias("w"))
    return rows.select("o_orderkey", F.explode(tx.tokens(F.col("w"))).alias("term")).groupBy("o_orderkey", "term").agg(
        F.count("*").alias("n"))


@query("X8_intent_cues", needs=("msg",), sql=r"""
SELECT message_id, CAST(CASE WHEN regexp_matches(lower(text), '(^|\s)the(\s|$)') THEN 2.0 ELSE 0 END
  + CASE WHEN regexp_matches(lower(text), 'tion') THEN 0.5 ELSE 0 END AS DOUBLE) AS boost FROM msg""")
def intent_cues(lake):
    """A rule table of cues (parameters here) summed per message."""
    rules = [(r"(^|\s)the(\s|$)", 2.0), ("tion", 0.5)]
    total = F.lit(0.0)
    for cue, boost in rules:
        total = total + F.when(F.lower("text").rlike(cue), boost).otherwise(0.0)
    return lake.messages().select("message_id", F.round(total, 3).alias("boost"))


@query("X9_token_estimate", sql="""
SELECT doc_id, length(text) AS chars, CAST(floor(length(text) / 4.0 + 0.5) AS BIGINT) AS approx_tokens FROM documents""")
def token_estimate(lake):
    return lake.table("documents").select("doc_id", F.length("text").cast("long").alias("chars"),
                                          tx.token_estimate(F.col("text")).alias("approx_tokens"))


@query("X10_word_count", sql=r"""
SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}][\p{L}\p{N}_''’-]*')) AS words FROM documents""")
def word_count(lake):
    return lake.table("documents").select("doc_id", tx.word_count(F.col("text")).alias("words"))


@query("X11_redaction", sql=r"""
SELECT page_id, regexp_replace(html, '(?s)<!--.*?-->', '[REDACTED]', 'g') AS html FROM pages""")
def redaction(lake):
    return lake.table("pages").select("page_id", tx.redacted(F.col("html"), "<!--", "-->", "[REDACTED]").alias("html"))


@query("X11_nested_redaction", sql=r"""
WITH r AS (SELECT page_id, regexp_replace(html, '(?s)<p>.*?</p>', '[P]', 'g') AS html, regexp_replace(url, '(?s)<p>.*?</p>', '[P]', 'g') AS url,
  string_split(regexp_replace(html, '(?s)<li>', chr(1), 'g'), chr(1)) AS parts FROM pages)
SELECT page_id, html AS body, url, len(parts) AS members, array_to_string([regexp_replace(x, '(?s)<p>.*?</p>', '[P]', 'g') for x in parts], '|') AS joined FROM r""")
def nested_redaction(lake):
    """A copy of a nested record: the same span replaced in a field, in a map of a struct and in the members of an array."""
    nested = lake.table("pages").select("page_id", F.struct(
        F.create_map(F.lit("url"), "url", F.lit("html"), "html").alias("fields"),
        F.transform(F.split("html", "<li>"), lambda x: F.struct(x.alias("text"), F.length(x).alias("size"))).alias("parts")).alias("value"))
    rows = tx.redacted_frame(nested, "<p>", "</p>", "[P]")
    return rows.select("page_id", F.col("value.fields")["html"].alias("body"), F.col("value.fields")["url"].alias("url"),
                       F.size("value.parts").cast("long").alias("members"), F.array_join("value.parts.text", "|").alias("joined"))


@query("X12_strip_suffix", sql=r"""
SELECT o_orderkey, o_orderpriority AS base FROM orders""")
def strip_suffix(lake):
    block = "\n\n[block]"
    made = F.concat("o_orderpriority", F.repeat(F.lit(block), (F.col("o_orderkey") % 4).cast("int")))
    return lake.table("orders").select("o_orderkey", made.alias("t")).select("o_orderkey", tx.without_suffix(F.col("t"), block).alias("base"))


@query("X12_strip_block", sql="""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 5 = 4 THEN '[block]' || o_orderpriority ELSE o_orderpriority END AS base FROM orders""")
def strip_block(lake):
    """Texts that are the block alone, begin with it, or carry it once or more at their end."""
    block, key = "[block]", F.col("o_orderkey")
    carried = F.concat("o_orderpriority", F.repeat(F.lit("\n\n" + block), (key % 4).cast("int")))
    made = F.when(key % 5 == 0, block).when(key % 5 == 4, F.concat(F.lit(block), carried)).otherwise(carried)
    return lake.table("orders").select("o_orderkey", tx.without_block(made, block).alias("base"))


@query("X14_slug", sql="""
SELECT p_partkey, regexp_replace(regexp_replace(replace(lower(' ' || p_name || ' / ' || p_brand || '!'), 'ё', 'е'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM part""")
def slug(lake):
    return lake.table("part").select("p_partkey", tx.slug(F.concat(F.lit(" "), "p_name", F.lit(" / "), "p_brand", F.lit("!"))).alias("slug"))


@query("X15_json_checks", sql="""
SELECT event_id, event_id % 4 <> 0 AS is_json, event_id % 4 NOT IN (0, 1) AS is_object,
       CASE WHEN event_id % 4 NOT IN (0, 1) THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def json_checks(lake):
    key = F.col("event_id")
    raw = (F.when(key % 4 == 0, F.concat("props", F.lit("x}"))).when(key % 4 == 1, F.concat(F.lit("["), "props", F.lit("]")))
           .otherwise(F.col("props")))
    rows = lake.table("events").select("event_id", raw.alias("raw")).withColumn("v", tx.json_value(F.col("raw")))
    is_object = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    return rows.select("event_id", F.col("v").isNotNull().alias("is_json"), is_object.alias("is_object"),
                       F.when(is_object, F.try_variant_get("v", "$.k", "bigint")).alias("k"))


@query("X16_timestamps", sql="""
SELECT event_id, event_id % 6 <> 0 AS valid, CASE WHEN event_id % 6 <> 0 THEN strftime(ts, '%Y%m%d') END AS utc_day FROM events""")
def timestamps(lake):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T"), F.date_format("ts", "HH:mm:ss"), F.lit("Z"))
    text = F.when(F.col("event_id") % 6 == 0, F.replace(text, F.lit("-01-"), F.lit("-13-"))).otherwise(text)
    rows = lake.table("events").select("event_id", F.try_to_timestamp(text).alias("at"))
    utc = F.to_utc_timestamp("at", F.current_timezone())
    return rows.select("event_id", F.col("at").isNotNull().alias("valid"), F.date_format(utc, "yyyyMMdd").alias("utc_day"))


@query("X19_contains", sql="""
SELECT p_partkey, contains(lower(p_name), 'red') AS has_red, lower(p_type) = 'economy' AS is_economy FROM part""")
def contains(lake):
    return lake.table("part").select("p_partkey", F.lower("p_name").contains("red").alias("has_red"),
                                     (F.lower("p_type") == "economy").alias("is_economy"))


@query("X20_array_helpers", sql="""
SELECT p_partkey, len(w) AS words, len(list_filter(w, lambda x: length(x) > 3)) > 0 AS any_long,
  len(list_filter(w, lambda x: length(x) > 2)) = len(w) AS all_words, array_to_string(list_transform(list_filter(w, lambda x: length(x) > 3), lambda x: upper(x)), '|') AS long_words
FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""")
def array_helpers(lake):
    rows = lake.table("part").select("p_partkey", F.split("p_name", " ").alias("w"))
    long = F.filter("w", lambda x: F.length(x) > 3)
    return rows.select("p_partkey", F.size("w").cast("long").alias("words"), F.exists("w", lambda x: F.length(x) > 3).alias("any_long"),
                       F.forall("w", lambda x: F.length(x) > 2).alias("all_words"),
                       F.concat_ws("|", F.transform(long, lambda x: F.upper(x))).alias("long_words"))


@query("X22_message_intent", needs=("msg",), sql="""
SELECT message_id, CASE WHEN w AND r THEN 'MIXED' WHEN r THEN 'RESEARCH' WHEN w THEN 'WORKING' ELSE 'DEFAULT' END AS intent
FROM (SELECT message_id, regexp_matches(text, '(?i)the|next step') AS w, regexp_matches(text, '(?i)tion|evidence') AS r FROM msg)""")
def message_intent(lake):
    """The patterns are parameters; these two occur in the given messages."""
    return lake.messages().select("message_id", tx.message_intent(F.col("text"), "the|next step", "tion|evidence").alias("intent"))


@query("X22_message_intent_default", needs=("msg",), sql=f"""
SELECT message_id, CASE WHEN w AND r THEN 'MIXED' WHEN r THEN 'RESEARCH' WHEN w THEN 'WORKING' ELSE 'DEFAULT' END AS intent
FROM (SELECT message_id, regexp_matches(text, '(?i){tx.WORKING_CUES.replace("'", "''")}') AS w,
      regexp_matches(text, '(?i){tx.RESEARCH_CUES.replace("'", "''")}') AS r
      FROM (SELECT message_id, text || CASE turn % 4 WHEN 1 THEN ' Where did we stop?' WHEN 2 THEN ' Any evidence?'
        WHEN 3 THEN ' Что в работе, какой эксперимент?' ELSE '' END AS text FROM msg))""")
def message_intent_default(lake):
    turn = F.col("turn") % 4
    asked = F.concat("text", F.when(turn == 1, " Where did we stop?").when(turn == 2, " Any evidence?")
                     .when(turn == 3, " Что в работе, какой эксперимент?").otherwise(""))
    return lake.messages().select("message_id", tx.message_intent(asked).alias("intent"))


# ---- retrieval --------------------------------------------------------------
@query("R1_postings", sql=r"""
WITH w AS (SELECT doc_id AS item_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]+')) AS term FROM documents)
SELECT term, item_id, count(*) AS tf FROM w GROUP BY 1, 2""")
def postings(lake):
    return rt.postings(lake.texts("documents", "doc_id"), "doc_id", F.col("text"))


@query("A11_document_frequency", sql="WITH " + token_sql("documents", "doc_id", "text") + """
SELECT term, count(DISTINCT id) AS documents FROM tok GROUP BY 1""")
def document_frequency(lake):
    return rt.document_frequency(lake.texts("documents", "doc_id"), F.col("text"))


SEARCHES = {"q1": "thread erthand", "q2": "zzz que", "q3": "Éeau"}
SEARCH_SQL = r"""
WITH q AS (SELECT * FROM (VALUES ('q1', 'thread', 2), ('q1', 'erthand', 2), ('q2', 'zzz', 2), ('q2', 'que', 2), ('q3', 'eeau', 1)) AS v(query, term, n)),
d AS (SELECT doc_id AS item_id, lang, regexp_extract_all(strip_accents(lower(text)), '[\p{L}\p{N}_]+') AS toks FROM documents),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avg_len FROM d),
u AS (SELECT item_id, unnest(toks) AS tok FROM d),
tf AS (SELECT q.query, q.term, q.n AS terms, u.item_id, count(*) AS tf FROM u JOIN q ON starts_with(u.tok, q.term) GROUP BY ALL),
df AS (SELECT query, term, count(*) AS df FROM tf GROUP BY 1, 2),
sc AS (SELECT tf.query, tf.item_id, count(*) = max(tf.terms) AS all_terms, sum(
   CASE WHEN ln((st.n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((st.n - df + 0.5) / (df + 0.5)) END
   * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d.toks) / st.avg_len))) AS score
 FROM tf JOIN df ON df.query = tf.query AND df.term = tf.term JOIN d ON d.item_id = tf.item_id CROSS JOIN st WHERE d.lang <> 'es' GROUP BY 1, 2),
m AS (SELECT *, max(all_terms) OVER (PARTITION BY query) AS best FROM sc),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item_id) AS rank FROM m WHERE all_terms = best)
SELECT query, item_id, round(score, 6) AS score, CASE WHEN best THEN 'all' ELSE 'any' END AS match_mode, rank FROM r WHERE rank <= 10"""


def _listed(lake, queries):
    return lake.spark.createDataFrame(list(queries.items()), "query string, text string")


def _searched(lake):
    """Queries of the user over all documents but Spanish ones."""
    index = si.build_index(lake.texts("documents", "doc_id"), "doc_id", {"text": rt.index_tokens(F.col("text"))}, ["lang"])
    return si.search(index, _listed(lake, SEARCHES), rt.query_tokens(F.col("text")), keep=F.col("lang") != "es")


@query("R2_ranked_retrieval", sql=SEARCH_SQL)
def ranked_retrieval(lake):
    return _searched(lake)


@query("J2_hits_with_items", needs=("items", "cur"), sql=SEARCH_SQL.replace("SELECT query, item_id, round(score, 6)", "SELECT query, rank, i.item_id, i.item_type, c.title AS source_title, round(score, 6)")
       .replace("match_mode, rank FROM r", "match_mode FROM r JOIN items i ON i.doc_id = r.item_id JOIN cur c ON c.source_id = i.source_id"))
def hits_with_items(lake):
    """The few hits pick their items and sources."""
    from attesta.operators import reference as ref
    hits = _searched(lake).withColumn("item_id", F.concat(F.lit("d"), "item_id"))
    items = lake.raw_items(False).select("item_id", "item_type", "source_id")
    sources = ref.normalise_sources(lake.current_sources()).select("source_id", F.col("title").alias("source_title"))
    return items.join(hits, "item_id").join(sources, "source_id").select(
        "query", "rank", "item_id", "item_type", "source_title", "score", "match_mode")


ITEM_TOKENS_SQL = r"""
toks AS (SELECT item_id, 0 AS field, regexp_extract_all(strip_accents(lower(claim)), '[\p{L}\p{N}_]+') AS ts FROM items
  UNION ALL SELECT item_id, 1, regexp_extract_all(strip_accents(lower(coalesce(project_id, ''))), '[\p{L}\p{N}_]+') FROM items
  UNION ALL SELECT item_id, 2, regexp_extract_all(strip_accents(lower(item_type)), '[\p{L}\p{N}_]+') FROM items),
u AS (SELECT item_id, field, unnest(ts) AS tok FROM toks)"""


def _item_index(lake):
    """All claims with their project and type, as searched by the reference memory; filters use values at capture."""
    from attesta.operators import reference as ref
    sources = ref.normalise_sources(lake.raw_sources())
    marked = ref.mark_superseded(ref.bind_items(lake.raw_items(), sources, hashed=False), lake.raw_items(False))
    items = ref.with_source(marked, ref.normalise_sources(lake.current_sources())).select(
        "item_id", "project_id", "item_type", "claim", "lifecycle", "source_id", ref.effective("source_surface").alias("surface"),
        ref.effective("source_kind").alias("source_kind"), ref.effective("source_authority_class").alias("authority_class"))
    fields = {name: rt.index_tokens(F.coalesce(name, F.lit(""))) for name in ("claim", "project_id", "item_type")}
    return si.build_index(items, "item_id", fields, [*si.FILTERS, "lifecycle"])


@query("R1_index_fields", needs=("items",), sql="WITH " + ITEM_TOKENS_SQL + """
SELECT tok AS term, item_id, count(*) FILTER (field = 0) AS in_claim, count(*) FILTER (field = 1) AS in_project,
  count(*) FILTER (field = 2) AS in_type FROM u GROUP BY 1, 2""")
def index_fields(lake):
    """The stored postings of the item index, with the count in each field."""
    index = _item_index(lake)
    return index.postings.select("term", "item_id", *[F.col(f"tf{n}").cast("long").alias(name) for n, name in enumerate(("in_claim", "in_project", "in_type"))])


@query("R1_dictionary", needs=("items",), sql="WITH " + ITEM_TOKENS_SQL + """
SELECT tok AS term, count(DISTINCT item_id) AS documents FROM u GROUP BY 1""")
def dictionary(lake):
    return _item_index(lake).terms.select("term", "documents")


def _search_sql(queries: str, keep: str) -> str:
    """Full text search by the definition: every token against every query term."""
    return ITEM_TOKENS_SQL + f""",
lens AS (SELECT item_id, sum(len(ts)) AS length FROM toks GROUP BY 1),
st AS (SELECT count(*) AS n, avg(length) AS avg_len FROM lens),
{queries},
asked AS (SELECT query, unnest(ts) AS term, len(ts) AS n_terms FROM
  (SELECT query, list_distinct(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS ts FROM qs)),
dict AS (SELECT DISTINCT tok FROM u),
exp AS (SELECT t.term, dict.tok FROM (SELECT DISTINCT term FROM asked) t JOIN dict ON starts_with(dict.tok, t.term)),
tf AS (SELECT term, item_id, count(*) AS tf FROM u JOIN exp USING (tok) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
part AS (SELECT term, item_id, greatest(ln((st.n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2
    / (tf + 1.2 * (0.25 + 0.75 * length / avg_len)) AS part
  FROM tf JOIN df USING (term) JOIN lens USING (item_id) CROSS JOIN st),
sc AS (SELECT a.query, p.item_id, count(*) = max(a.n_terms) AS all_terms, round(sum(part), 6) AS score
  FROM asked a JOIN part p USING (term) JOIN e USING (item_id) JOIN qs ON qs.query = a.query WHERE {keep} GROUP BY 1, 2),
m AS (SELECT *, max(all_terms) OVER (PARTITION BY query) AS best FROM sc),
r AS (SELECT query, item_id, score, CASE WHEN best THEN 'all' ELSE 'any' END AS match_mode,
    row_number() OVER (PARTITION BY query ORDER BY score DESC, item_id) AS rank FROM m WHERE all_terms = best)"""


@query("R2_benchmark_search", needs=("items", "cur"), sql="WITH dummy AS (SELECT 1)" + EVIDENCE_SQL + ", " + _search_sql(
    "qs AS (SELECT item_id AS query, text FROM benchmark)", "lifecycle <> 'SUPERSEDED'")
    + " SELECT query, item_id, score, match_mode, rank FROM r WHERE rank <= 10")
def benchmark_search(lake):
    """Every benchmark text as a query over all claims, projects and types."""
    queries = lake.table("benchmark").select(F.col("item_id").alias("query"), "text")
    return si.search(_item_index(lake), queries, rt.query_tokens(F.col("text")))


# queries of users, each with its own filters and limit
FILTERED = [("f1", "the thing", "en", None, None, None, None, None, False, False, 5),
            ("f2", "Éeau que", None, "UNKNOWN", None, None, None, None, True, False, 100),
            ("f3", "of implementation_fact", None, None, None, None, None, None, False, True, 10),
            ("f4", "de zzz", None, None, "RESEARCH_DONOR", None, None, None, False, False, 10),
            ("f5", "der", None, None, None, "RESEARCH", None, None, False, False, None),
            ("f6", "hypothesis en", None, None, None, None, "drive", None, True, False, 7),
            ("f7", "th", None, None, None, None, None, "src1", False, False, 3), ("f8", "- .", None, None, None, None, None, None, False, False, 3)]
FILTERED_SCHEMA = ("query string, text string, project_id string, item_type string, authority_class string, source_kind string, "
                   "surface string, source_id string, include_superseded boolean, implementation_evidence_only boolean, limit int")


def _literal(value) -> str:
    return "NULL" if value is None else str(value) if not isinstance(value, str) else f"'{value}'"


@query("R2_filtered_evidence", needs=("items", "cur"), sql="WITH dummy AS (SELECT 1)" + EVIDENCE_SQL + ", " + _search_sql(
    "qs(query, text, f_project, f_type, f_authority, f_kind, f_surface, f_source, old, proof, most) AS (VALUES "
    + ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in FILTERED) + ")",
    """(f_project IS NULL OR e.project_id = f_project) AND (f_type IS NULL OR e.item_type = f_type)
   AND (f_authority IS NULL OR ea = f_authority) AND (f_kind IS NULL OR ek = f_kind) AND (f_surface IS NULL OR es = f_surface)
   AND (f_source IS NULL OR e.source_id = f_source) AND (old OR lifecycle <> 'SUPERSEDED') AND (NOT proof OR impl)""")
    + " SELECT r.query, rank, score, match_mode, e.item_id, e.item_type, e.project_id, et AS source_title, es AS source_surface, "
      "ea AS authority_class, lifecycle, changed_fields, impl AS is_implementation_evidence, draft AS is_draft, " + CAVEATS_SQL
    + " AS caveats FROM r JOIN e USING (item_id) JOIN qs ON qs.query = r.query WHERE rank <= coalesce(most, 10)")
def filtered_evidence(lake):
    """Searches with filters, limits and fallback; each hit comes with its evidence block."""
    from attesta.operators import reference as ref
    queries = lake.spark.createDataFrame(FILTERED, FILTERED_SCHEMA)
    hits = si.search(_item_index(lake), queries, rt.query_tokens(F.col("text")))
    sources = ref.normalise_sources(lake.raw_sources())
    found = lake.raw_items(False).join(hits.select("item_id").distinct(), "item_id", "left_semi")
    marked = ref.mark_superseded(ref.bind_items(found, sources, hashed=False), lake.raw_items(False))
    blocks = ref.evidence_blocks(marked, ref.normalise_sources(lake.current_sources()))
    return hits.join(blocks, "item_id").select(
        "query", "rank", "score", "match_mode", "item_id", "item_type", "project_id", "source_title", "source_surface",
        "authority_class", "lifecycle", "changed_fields", "is_implementation_evidence", "is_draft", "caveats")


@query("R2_listing", needs=("items",), sql="""
SELECT item_id, project_id, item_type FROM items ORDER BY project_id, item_type, item_id LIMIT 10""")
def listing(lake):
    from attesta.operators import reference as ref
    items = ref.bind_items(lake.raw_items(False), ref.normalise_sources(lake.raw_sources()), hashed=False)
    return rt.listing(items).select("item_id", "project_id", "item_type")


LEX_QUERIES = {"l1": "Who wants the nation thread erthand?", "l2": "what is open now: oneringes-inat token"}


def _lex_records(lake):
    doc = F.col("doc_id")
    kind = F.when(doc % 3 == 0, "OPEN_QUESTION").when(doc % 3 == 1, "USER_IDENTITY").otherwise("CURRENT_PRIORITY")
    status = F.when(doc % 4 == 0, "SUPERSEDED").when(doc % 4 == 1, "CURRENT").otherwise("OPEN")
    return lake.texts("documents", "doc_id").select(
        F.concat(F.lit("d"), doc).alias("id"), kind.alias("type"), status.alias("status"), F.col("text").alias("statement"),
        F.col("lang").alias("keywords"))


LEX_SQL = "WITH rec AS (SELECT 'd' || doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'OPEN_QUESTION' WHEN 1 THEN 'USER_IDENTITY' ELSE 'CURRENT_PRIORITY' END AS type, " \
    "CASE doc_id % 4 WHEN 0 THEN 'SUPERSEDED' WHEN 1 THEN 'CURRENT' ELSE 'OPEN' END AS status, text || ' ' || lang AS body FROM documents), " \
    "allrows AS (SELECT id || '#m' AS rid, body AS t FROM rec UNION ALL SELECT id || '#x', id || ' ' || type || ' ' || status FROM rec " \
    "UNION ALL SELECT 'l1#q', 'Who wants the nation thread erthand?' UNION ALL SELECT 'l2#q', 'what is open now: oneringes-inat token'), " \
    + token_sql("allrows", "rid", "t") + """,
dt AS (SELECT DISTINCT string_split(id, '#')[1] AS id, string_split(id, '#')[2] AS kind, term FROM tok),
q AS (SELECT id AS query, term FROM dt WHERE kind = 'q'),
docs AS (SELECT * FROM dt WHERE kind <> 'q'),
n AS (SELECT count(*) AS n FROM rec),
df AS (SELECT term, count(DISTINCT id) AS df FROM docs GROUP BY 1),
w AS (SELECT q.query, q.term, docs.id, max(CASE WHEN docs.term = q.term AND kind = 'm' THEN 3 WHEN docs.term = q.term THEN 2 ELSE 1 END) AS c
  FROM q JOIN docs ON docs.term = q.term OR (length(q.term) >= 5 AND length(docs.term) >= 5 AND (starts_with(docs.term, q.term) OR starts_with(q.term, docs.term)))
  GROUP BY ALL),
sc AS (SELECT w.query, w.id, sum(CASE c WHEN 3 THEN 1.0 WHEN 2 THEN 0.5 ELSE 0.6 END * ln(1 + n.n / (1 + coalesce(df.df, 0)))) AS lex
  FROM w LEFT JOIN df ON df.term = w.term CROSS JOIN n GROUP BY 1, 2),
b AS (SELECT sc.query, rec.id, rec.type, rec.status, round((lex
   + CASE WHEN query = 'l1' AND type = 'USER_IDENTITY' THEN 2.0 ELSE 0 END
   + CASE WHEN query = 'l2' AND type = 'CURRENT_PRIORITY' THEN 0.5 WHEN query = 'l2' AND type = 'OPEN_QUESTION' THEN 2.0 ELSE 0 END
   + CASE WHEN query = 'l2' AND status = 'CURRENT' THEN 0.5 ELSE 0 END) * CASE WHEN status = 'SUPERSEDED' THEN 0.5 ELSE 1.0 END, 3) AS score
  FROM sc JOIN rec ON rec.id = sc.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank, max(score) OVER (PARTITION BY query) AS best FROM b)
"""


def _lexical_hits(lake):
    return si.lexical_search(si.lexical_index(_lex_records(lake)), _listed(lake, LEX_QUERIES))


@query("R4_lexical_search", sql=LEX_SQL + "SELECT query, id, type, status, score, rank FROM r WHERE rank <= 5 AND score >= 0.4 * best")
def lexical_search(lake):
    return _lexical_hits(lake)


@query("R10_graded_retrieval", sql=LEX_SQL + """
, h AS (SELECT * FROM r WHERE rank <= 5 AND score >= 0.4 * best),
g AS (SELECT h.query, count(*) AS hits, count(*) FILTER (WHERE status <> 'SUPERSEDED' AND type <> 'CURRENT_PRIORITY') AS good_hits,
  bool_or(rank = 1 AND status <> 'SUPERSEDED' AND type <> 'CURRENT_PRIORITY') AS first_good FROM h GROUP BY 1)
SELECT query, hits, good_hits, CASE WHEN good_hits = 0 THEN 'FAIL' WHEN first_good AND good_hits >= 0.6 * hits AND hits <= 5 THEN 'PASS' ELSE 'PARTIAL' END AS grade
FROM g""")
def graded_retrieval(lake):
    """The relevance rule is put to the few hits, not to every record and query."""
    queries = lake.spark.createDataFrame([(q,) for q in LEX_QUERIES], "query string")
    hits = _lexical_hits(lake)
    good = hits.where((F.col("status") != "SUPERSEDED") & (F.col("type") != "CURRENT_PRIORITY")).select("query", "id")
    return rt.grade(hits, good, queries)


@query("A19_retrieval_grade", sql="""
WITH r AS (SELECT user_id AS query, event_id AS id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events),
g AS (SELECT query, count(*) AS hits, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS good_hits,
  bool_or(rank = 1 AND event_type IN ('view', 'click')) AS first_good FROM r WHERE rank <= 5 GROUP BY 1)
SELECT query, hits, good_hits, CASE WHEN good_hits = 0 THEN 'FAIL' WHEN first_good AND good_hits >= 0.6 * hits AND hits <= 5 THEN 'PASS' ELSE 'PARTIAL' END AS grade FROM g""")
def retrieval_grade(lake):
    from attesta.plans.scale import top_k_per_group
    events = lake.table("events").select(F.col("user_id").alias("query"), F.col("event_id").alias("id"), "event_type", "value")
    hits = top_k_per_group(events, ["query"], [F.col("value").desc(), F.col("id").asc()], 5)
    relevant = events.where(F.col("event_type").isin("view", "click"))
    return rt.grade(hits, relevant, events.select("query").distinct())


@query("K5_ratio_cut", sql="""
SELECT event_type, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank
  FROM (SELECT *, max(value) OVER (PARTITION BY event_type) AS best FROM events) WHERE value >= 0.4 * best) WHERE rank <= 5""")
def ratio_cut(lake):
    rows = lake.table("events").select("event_type", "event_id", "value")
    return rt.ratio_cut(rows, "event_type", "value", "event_id", 0.4, 5).select("event_type", "event_id", "rank")


CHUNK_SQL = """
WITH c AS (SELECT doc_id, unnest(range(0, greatest(length(text), 1), 600)) AS start_at, text FROM documents),
ch AS (SELECT doc_id, start_at // 600 AS chunk, start_at, substr(text, CAST(start_at + 1 AS INT), 800) AS piece FROM c)
"""


@query("R8_document_chunks", sql=CHUNK_SQL + "SELECT doc_id, chunk, start_at, sha256(piece) AS piece_hash, length(piece) AS chars FROM ch")
def document_chunks(lake):
    rows = rt.chunks(lake.texts("documents", "doc_id").select("doc_id", "text"))
    return rows.select("doc_id", "chunk", "start_at", F.sha2("piece", 256).alias("piece_hash"), F.length("piece").cast("long").alias("chars"))


@query("R8_relevant_chunks", sql=CHUNK_SQL + r"""
, q AS (SELECT * FROM (VALUES ('c1', 'thread', 2), ('c1', 'token', 2)) AS v(query, term, n)),
d AS (SELECT doc_id || '/' || chunk AS item_id, regexp_extract_all(strip_accents(lower(piece)), '[\p{L}\p{N}_]+') AS toks FROM ch),
st AS (SELECT count(*) AS n, avg(len(toks)) AS avg_len FROM d),
tf AS (SELECT query, term, n AS terms, item_id, count(*) AS tf FROM (SELECT item_id, unnest(toks) AS tok FROM d) u JOIN q ON starts_with(tok, term) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
sc AS (SELECT query, tf.item_id, count(*) = max(terms) AS all_terms, sum(greatest(ln((st.n - df + 0.5) / (df + 0.5)), 1e-6)
  * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks) / avg_len))) AS score FROM tf JOIN df USING (term) JOIN d ON d.item_id = tf.item_id CROSS JOIN st GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item_id) AS rank FROM (SELECT *, max(all_terms) OVER (PARTITION BY query) AS best FROM sc) WHERE all_terms = best)
SELECT query, item_id, round(score, 6) AS score, CASE WHEN best THEN 'all' ELSE 'any' END AS match_mode, rank FROM r WHERE rank <= 5""")
def relevant_chunks(lake):
    rows = rt.chunks(lake.texts("documents", "doc_id").select("doc_id", "text")).withColumn("item_key", F.concat_ws("/", "doc_id", "chunk"))
    index = si.build_index(rows, "item_key", {"piece": rt.index_tokens(F.col("piece"))})
    queries = _listed(lake, {"c1": "thread token"}).withColumn("limit", F.lit(5))
    return si.search(index, queries, rt.query_tokens(F.col("text")))
