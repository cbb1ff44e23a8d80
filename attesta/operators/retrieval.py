"""Tokens and postings of texts, cuts and grades of hits, pieces of documents.  ``search_index`` searches."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.plans.scale import lookup_join, top_k_per_group
from attesta.session import written

INDEX_TERM = r"[\p{L}\p{N}_]+"
QUERY_TERM = r"[\p{L}\p{N}_]{2,}"


def _accents() -> tuple[str, str]:
    """Latin letters with a mark and the bare letters they fold to, by their Unicode decomposition."""
    marked, bare = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and chr(code).islower():
            marked.append(chr(code))
            bare.append(parts[0])
    return "".join(marked), "".join(bare)


def index_fold(text: Column) -> Column:
    """Lower case without diacritics, for the index and for queries alike."""
    marked, bare = _accents()
    lower = F.lower(text)
    # a text of single bytes has no mark
    return F.when(F.octet_length(lower) == F.length(lower), lower).otherwise(F.translate(lower, marked, bare))


def index_tokens(text: Column) -> Column:
    """All terms of a text, for the index."""
    return F.regexp_extract_all(index_fold(text), F.lit(INDEX_TERM), F.lit(0))


def query_tokens(text: Column) -> Column:
    """Terms of two or more letters, digits or underscores, for a query."""
    return F.regexp_extract_all(index_fold(text), F.lit(QUERY_TERM), F.lit(0))


# ---- index ------------------------------------------------------------------
def counted_terms(rows: DataFrame, key: str, found: Column, count: str) -> DataFrame:
    """(``key``, term, ``count``) over the arrays ``found`` of the rows of each key.

    A key that one row has is counted inside that row: its terms are sorted, and each begins where the one before it ends.
    No term of it is moved.  Rows that share a key (a missing one too) are counted together, spread by (key, term)."""
    again = written(rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("again")),
                    "repeated-keys")
    same = F.col(key).eqNullSafe(F.col("again"))
    alone, shared = rows.join(again, same, "left_anti"), rows.join(again, same, "left_semi")
    t, size = F.col("t"), F.size("t")
    firsts = alone.select(key, F.sort_array(found).alias("t")).select(key, "t", F.when(size > 0, F.filter(
        F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))).alias("at"))
    ends = F.coalesce(F.get(F.col("at"), F.col("k") + 1), size)
    # an outer generator: Spark would test the arrays of an inner one first, and so make them twice
    inside = firsts.select(key, "t", "at", F.posexplode_outer("at").alias("k", "i")).where("i is not null").select(
        key, F.get(t, F.col("i")).alias("term"), (ends - F.col("i")).cast("long").alias(count))
    words = shared.select(key, F.explode(found).alias("term"))
    return inside.unionByName(words.groupBy(key, "term").agg(F.count("*").alias(count)))


def postings(items: DataFrame, id_column: str, text: Column) -> DataFrame:
    """(term, item, tf)."""
    rows = items.select(F.col(id_column).alias("item_id"), text.alias("text"))
    return counted_terms(rows, "item_id", index_tokens(F.col("text")), "tf").select("term", "item_id", "tf")


def document_frequency(items: DataFrame, text: Column) -> DataFrame:
    """In how many records each token occurs; repeats inside a record are dropped before any shuffle."""
    return items.select(F.explode(tx.token_set(text)).alias("term")).groupBy("term").agg(
        F.count("*").alias("documents"))


def listing(items: DataFrame, limit: int = 10) -> DataFrame:
    """A search without terms lists by project, type and id."""
    return items.orderBy("project_id", "item_type", "item_id").limit(max(1, min(limit, 100)))


# ---- ranks and grades -------------------------------------------------------
def ratio_cut(rows: DataFrame, key: str, score: str, tie: str, ratio: float, k: int) -> DataFrame:
    """Rows of each key with at least ``ratio`` of its best score, the first ``k`` of them."""
    best = rows.groupBy(key).agg(F.max(score).alias("__best"))
    kept = lookup_join(rows, best, [key], [tie], "inner").where(F.col(score) >= ratio * F.col("__best")).drop("__best")
    return top_k_per_group(kept, [key], [F.col(score).desc(), F.col(tie).asc()], k)


def grade(hits: DataFrame, relevant: DataFrame, queries: DataFrame, largest: int = 5) -> DataFrame:
    """PASS: the first hit is relevant, so are 60 % of all, and they are few.  PARTIAL: any is.  FAIL: none."""
    marked = hits.join(relevant.select("query", "id", F.lit(True).alias("good")), ["query", "id"], "left")
    per_query = marked.groupBy("query").agg(
        F.count("*").alias("hits"), F.count_if(F.col("good")).alias("good_hits"),
        F.max(F.coalesce(F.col("good"), F.lit(False)) & (F.col("rank") == 1)).alias("first_good"))
    out = queries.join(per_query, "query", "left")
    verdict = (F.when(F.coalesce("good_hits", F.lit(0)) == 0, "FAIL")
               .when(F.col("first_good") & (F.col("good_hits") >= 0.6 * F.col("hits")) & (F.col("hits") <= largest), "PASS")
               .otherwise("PARTIAL"))
    return out.select("query", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("good_hits", F.lit(0)).alias("good_hits"),
                      verdict.alias("grade"))


def chunks(documents: DataFrame, size: int = 800, overlap: int = 200) -> DataFrame:
    """Overlapping pieces of whole texts; size and overlap are parameters.

    A text is cut into steps in one pass over it; a piece is a step and the beginning of those that follow."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    steps = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    cut = documents.select("doc_id", F.when(F.size(steps) == 0, F.array(F.lit(""))).otherwise(steps).alias("steps"))
    follows = -(-overlap // step)

    def piece(head: Column, n: Column) -> Column:
        after = F.array_join(F.slice("steps", n + 2, F.lit(follows)), "")
        return F.concat(head, F.left(after, F.lit(overlap)))

    pieces = F.transform("steps", piece) if overlap else F.col("steps")
    return cut.select("doc_id", F.posexplode(pieces).alias("chunk", "piece")).select(
        "doc_id", F.col("chunk").cast("long").alias("chunk"), (F.col("chunk") * step).cast("long").alias("start_at"), "piece")


def card_haystack(fields: list[str]) -> Column:
    return F.lower(F.concat_ws("\n", "title", *[F.coalesce(F.element_at("fields", f), F.lit("")) for f in fields]))


def all_terms_match(haystack: Column, query: str) -> Column:
    """Every blank-separated term occurs somewhere."""
    keep = F.lit(True)
    for term in query.strip().lower().split():
        keep = keep & haystack.contains(term)
    return keep


