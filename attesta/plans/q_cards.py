"""Registered queries: cards and semi-structured documents.

Every page stands for one index document: a header with four flags (some pages break the contract) and two
cards made of its title and its paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.functions import vocabulary as v
from attesta.operators import cards
from attesta.operators import retrieval as rt
from attesta.plans.registry import query
from attesta.session import written

# how a page breaks the contract, by its id: kind 0..13, all others are fine
KINDS = 29


def _flag_lines() -> Column:
    kind = F.col("page_id") % KINDS
    canon = (F.when(kind == 1, "").when(kind == 2, "CANON: `NO`\nCANON: `NO`\n").when(kind == 3, "CANON: `NO`\nCANON=YES\n")
             .when(kind == 4, "CANON: NO\n").when(kind == 5, "see CANON=NO here\n").when(kind == 6, "CANON=YES\n").otherwise("CANON=NO\n"))
    head = F.when(kind == 0, "STATUS: `OTHER`\n").otherwise("STATUS: `RESEARCH_INDEX_ONLY`\n")
    return F.concat(F.lit("# Index\n"), head, canon, F.lit("RUNTIME_AUTHORITY: `NO`\\\nPRIMARY_EVIDENCE=NO\n\n"))


def _title() -> Column:
    return F.regexp_replace(F.regexp_extract("html", r"(?s)<title>([^<]*)</title>", 1), r"\s+", " ")


def _paragraphs() -> Column:
    """The text of all paragraphs of the page's article, without tags; a paragraph ends at its end tag or the next one."""
    article = F.split_part(F.split_part("html", F.lit("<article>"), F.lit(2)), F.lit("</article>"), F.lit(1))
    parts = F.transform(F.slice(F.split(article, "<p>"), 2, F.lit(2**30)), lambda part: F.split_part(part, F.lit("</p>"), F.lit(1)))
    return F.trim(F.regexp_replace(F.regexp_replace(F.array_join(parts, " "), "<[^>]*>", " "), r"\s+", " "))


def index_documents(lake):
    """Index documents built from the pages."""
    key = F.col("page_id")
    kind = key % KINDS
    words = _paragraphs()
    first = F.concat(F.lit("### 1. "), F.col("title"), F.lit("\nSTATUS: open\nQUESTION: "), F.col("words"),
                     F.when(kind == 9, "\nEXECUTION_VERDICT: \n").otherwise("\nEXECUTION_VERDICT: NOT_RUN\n"),
                     F.lit("PRIMARY_EVIDENCE: page "), key,
                     F.lit("\\\nGITHUB_REF: g1 NOTION_REF: n1 DRIVE_REF: d1\n"),
                     F.when(kind == 10, "stray line\n").otherwise(""), F.when(kind == 11, "STATUS: again\n").otherwise(""))
    second = F.concat(F.when(kind == 8, "### 1. copy").otherwise(F.concat(F.lit("### 2. Card "), key)),
                      F.lit("\nSTATUS: done\nEXECUTION_VERDICT: PASS\nPRIMARY_EVIDENCE: url "), F.col("url"),
                      F.lit("\nNOTION_STATUS: seen DRIVE_STATUS: old CONSISTENCY: `MATCH`. LAST_VERIFIED: 2026\n"))
    section = F.when(kind == 7, "## C. Cards\nno card\n").when(kind == 12, F.concat(F.lit("## D. Cards\n"), first, second)).otherwise(
        F.concat(F.lit("## C. Cards\n"), first, second))
    rows = lake.texts("pages", "page_id").select("page_id", "url", _title().alias("title"), words.alias("words"))
    return rows.select("page_id", F.concat(_flag_lines(), section, F.lit("## E. End\nSTATUS: outside\n")).alias("text"))


DOCS_SQL = rf"""
WITH d AS (SELECT page_id, page_id % {KINDS} AS kind, url,
  trim(regexp_replace(split_part(split_part(html, '<title>', 2), '</title>', 1), '\s+', ' ', 'g')) AS title,
  trim(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(split_part(split_part(html, '<article>', 2), '</article>', 1), '<p>')[2:],
    lambda part: split_part(part, '</p>', 1)), ' '), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS words FROM pages),
c AS (SELECT page_id, kind, 1 AS card_number, 1 AS place, title, 'open' AS status, words AS question, CASE WHEN kind = 9 THEN '' ELSE 'NOT_RUN' END AS verdict,
   'page ' || page_id AS evidence, 'g1' AS github, 'n1' AS notion, 'd1' AS drive, NULL AS consistency FROM d WHERE title <> '' AND kind NOT IN (7, 12)
 UNION ALL SELECT page_id, kind, CASE WHEN kind = 8 THEN 1 ELSE 2 END, 2, CASE WHEN kind = 8 THEN 'copy' ELSE 'Card ' || page_id END, 'done', NULL, 'PASS',
   'url ' || url, NULL, NULL, NULL, '`MATCH`.' FROM d WHERE kind NOT IN (7, 12))
"""


def _cards(lake):
    documents = written(index_documents(lake), "documents")
    lines = written(cards.card_lines(documents, "page_id", F.col("text")), "lines")
    return documents, written(cards.cards(lines, cards.card_fields(lines, "page_id"), "page_id"), "cards")


def _served(lake):
    """Cards of valid documents only."""
    documents, rows = _cards(lake)
    status = cards.document_status(documents, rows, "page_id", F.col("text"))
    return rows.join(status.where("parse_status = 'OK'").select("page_id"), "page_id")


@query("S3_document_lines", sql="""
SELECT page_id, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM (SELECT page_id, unnest(regexp_split_to_array(html, '><')) AS line FROM pages) GROUP BY 1""")
def document_lines(lake):
    lines = cards.document_lines(lake.table("pages"), "page_id", F.col("html"), "><")
    return lines.groupBy("page_id").agg(F.count("*").alias("lines"), F.sum(F.length("line").cast("long")).alias("chars"))


@query("W10_carried_headings", sql=r"""
WITH l AS (SELECT page_id, unnest(p) AS line, unnest(range(len(p))) AS line_no FROM (SELECT page_id, regexp_split_to_array(html, '><') AS p FROM pages)),
h AS (SELECT *, CASE WHEN regexp_matches(line, '^h[1-6][^>]*>') THEN regexp_extract(line, '^h[1-6][^>]*>([^<]*)', 1) END AS own FROM l)
SELECT page_id, line_no, last_value(own IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM h""")
def carried_headings(lake):
    lines = cards.document_lines(lake.table("pages"), "page_id", F.col("html"), "><")
    own = F.when(F.col("line").rlike("^h[1-6][^>]*>"), F.regexp_extract("line", "^h[1-6][^>]*>([^<]*)", 1))
    return cards.carry_headings(lines, "page_id", own).select("page_id", "line_no", "heading")


@query("V13_authority_contract", sql=f"""
SELECT page_id, concat_ws(',', CASE kind WHEN 1 THEN 'CANON:MISSING' WHEN 2 THEN 'CANON:DUPLICATE' WHEN 3 THEN 'CANON:CONFLICTING'
   WHEN 4 THEN 'CANON:AMBIGUOUS' WHEN 5 THEN 'CANON:INLINE' WHEN 6 THEN 'CANON:WRONG_VALUE' END,
   CASE WHEN kind = 0 THEN 'STATUS:WRONG_VALUE' END) AS problems FROM (SELECT page_id, page_id % {KINDS} AS kind FROM pages)""")
def authority_contract(lake):
    rows = cards.with_authority_problems(index_documents(lake), "text")
    return rows.select("page_id", F.concat_ws(",", "problems").alias("problems"))


@query("V14_document_status", sql=DOCS_SQL + """
SELECT page_id, CASE WHEN kind IN (0, 12) THEN 'NOT_AN_EVIDENCE_INDEX' WHEN kind BETWEEN 1 AND 6 THEN 'AUTHORITY_CONTRACT_INVALID'
  WHEN kind = 7 THEN 'NO_CARDS_PARSED' WHEN kind = 8 AND title <> '' THEN 'DUPLICATE_CARD_NUMBER' WHEN kind = 9 AND title <> '' THEN 'MALFORMED_CARDS'
  WHEN kind IN (10, 11) AND title <> '' THEN 'UNSUPPORTED_CARD_CONTENT' ELSE 'OK' END AS parse_status FROM d""")
def document_status(lake):
    documents, rows = _cards(lake)
    return cards.document_status(documents, rows, "page_id", F.col("text"))


@query("V15_card_issues", sql=DOCS_SQL + """
SELECT page_id, card_number, CASE WHEN kind = 10 AND place = 1 THEN 1 ELSE 0 END AS unrecognised_lines,
  CASE WHEN kind = 11 AND place = 1 THEN 'STATUS' ELSE '' END AS duplicate_fields,
  CASE WHEN verdict = '' THEN 'EXECUTION_VERDICT' ELSE '' END AS missing_fields FROM c""")
def card_issues(lake):
    _, rows = _cards(lake)
    return rows.select("page_id", F.col("card_number").cast("int").alias("card_number"), F.col("unrecognised_lines").cast("int").alias("unrecognised_lines"),
                       F.concat_ws(",", "duplicate_fields").alias("duplicate_fields"), F.concat_ws(",", "missing_fields").alias("missing_fields"))


@query("P16_card_projection", sql=DOCS_SQL + """
SELECT page_id, card_number, title, status, question, verdict, evidence, github, notion, drive, consistency FROM c""")
def card_projection(lake):
    _, rows = _cards(lake)
    return rows.select("page_id", F.col("card_number").cast("int").alias("card_number"), "title", F.col("fields")["STATUS"].alias("status"),
                       F.col("fields")["QUESTION"].alias("question"), F.col("fields")["EXECUTION_VERDICT"].alias("verdict"),
                       F.col("fields")["PRIMARY_EVIDENCE"].alias("evidence"), F.col("fields")["GITHUB_REF"].alias("github"),
                       F.col("fields")["NOTION_REF"].alias("notion"), F.col("fields")["DRIVE_REF"].alias("drive"), F.col("fields")["CONSISTENCY"].alias("consistency"))


OK_SQL = DOCS_SQL + """
, ok AS (SELECT * FROM c WHERE kind NOT IN (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)),
hit AS (SELECT *, lower(concat_ws(chr(10), title, '', coalesce(question, ''), status, verdict, '', evidence)) AS hay FROM ok)
"""


@query("R5_card_search", sql=OK_SQL + """
SELECT page_id, card_number, title, count(*) OVER () AS matched
  FROM hit WHERE contains(hay, 'page') AND contains(hay, 'not_run') ORDER BY page_id, card_number LIMIT 3""")
def card_search(lake):
    """All terms in the six search fields; the first cards in full and the number of all matches."""
    rows = _served(lake).where(rt.all_terms_match(rt.card_haystack(v.CARD_SEARCH), "NOT_RUN page"))
    rows = written(rows.select("page_id", F.col("card_number").cast("int").alias("card_number"), "title"), "matches")
    matched = rows.agg(F.count("*").alias("matched")).scalar()
    return rows.orderBy("page_id", "card_number").limit(3).withColumn("matched", matched)


@query("R5_paragraph_search", sql=OK_SQL + """
SELECT page_id, card_number, length(question) AS question_chars FROM hit
WHERE contains(hay, 'que') AND contains(hay, 'pour') AND contains(hay, 'dans')""")
def paragraph_search(lake):
    """Terms that only stand in the paragraphs of the pages; all matches."""
    rows = _served(lake).where(rt.all_terms_match(rt.card_haystack(v.CARD_SEARCH), " Pour QUE\tdans "))
    return rows.select("page_id", F.col("card_number").cast("int").alias("card_number"),
                       F.length(F.col("fields")["QUESTION"]).cast("long").alias("question_chars"))


@query("A6_card_totals", sql=OK_SQL + """
SELECT page_id, count(*) AS total_cards, count(*) FILTER (WHERE contains(hay, 'not_run')) AS matched,
  string_agg(CAST(card_number AS VARCHAR), ',' ORDER BY card_number) FILTER (WHERE NOT contains(hay, 'not_run')) AS omitted FROM hit GROUP BY 1""")
def card_totals(lake):
    """Totals per document; the listed numbers are those of one document's cards."""
    rows = _served(lake).withColumn("match", rt.all_terms_match(rt.card_haystack(v.CARD_SEARCH), "not_run"))
    numbers = F.array_sort(F.collect_set(F.when(~F.col("match"), F.col("card_number"))))
    return rows.groupBy("page_id").agg(F.count("*").alias("total_cards"), F.count_if("match").alias("matched"),
                                       F.nullif(F.concat_ws(",", numbers.cast("array<string>")), F.lit("")).alias("omitted"))


@query("R6_card_overview", sql=OK_SQL + """
SELECT page_id, card_number, CASE WHEN length(title) > 120 THEN left(title, 120) || '…' ELSE title END AS title, status, verdict FROM ok
ORDER BY page_id, card_number LIMIT 30""")
def card_overview(lake):
    rows = _served(lake).orderBy("page_id", "card_number").limit(30)
    return rows.select("page_id", F.col("card_number").cast("int").alias("card_number"), tx.clipped(F.col("title"), 120).alias("title"),
                       F.col("fields")["STATUS"].alias("status"), F.col("fields")["EXECUTION_VERDICT"].alias("verdict"))


@query("R6_card_by_number", sql=OK_SQL + "SELECT page_id, title, evidence FROM ok WHERE card_number = 2")
def card_by_number(lake):
    return _served(lake).where("card_number = 2").select("page_id", "title", F.col("fields")["PRIMARY_EVIDENCE"].alias("evidence"))
