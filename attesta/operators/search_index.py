"""A stored inverted index and the searches on it.  Queries are a table; only postings of asked terms are read.

``postings`` holds a row for each (term, item) with its counts by field, stored by bucket (a hash of the term's first
two letters, so that all terms with one prefix share a bucket) and sorted by term.  ``terms`` is the dictionary,
``documents`` has the length and the filter columns of each item.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import text as tx
from attesta.plans.scale import top_k_per_group
from attesta.session import scratch_path, written

BUCKETS = 16            # parts of the stored postings; a large index takes more
NEAR_CHARS = 5          # shortest term that meets others by a common beginning
MOST_HITS = 100
BLOCK_QUERIES = 64      # queries scored at a time ...
SLICE_ITEMS = 512       # ... over so many items
SLICE_ROWS = 200_000    # terms of items that a task holds while it cuts them into slices


@dataclass(frozen=True)
class TextIndex:
    """Tables of an index: ``postings`` (bucket, term, item_id, tf0, tf1, ...), ``terms`` (bucket, term, documents) and
    ``documents`` (item_id, length, attributes); ``fields`` names the counts ``tf<n>`` in their order."""

    fields: tuple[str, ...]
    buckets: int
    postings: DataFrame
    terms: DataFrame
    documents: DataFrame


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.left(term, F.lit(2))), F.lit(buckets)).cast("int")


def build_index(items: DataFrame, id_column: str, fields: dict[str, Column], attributes: list[str] = (),
                path: str | None = None, buckets: int = BUCKETS) -> TextIndex:
    """Cut the ``fields`` (arrays of tokens) of every item into postings and store them.

    Tokens of an item are counted in the task that reads it, so one row per (term, item) is moved, once: a term that
    stands in most items is spread over all tasks, and each task stores its rows of a bucket sorted by term.
    ``path`` keeps the index for later sessions (``open_index``); without it, it lies in the shared scratch folder.
    """
    spark = items.sparkSession
    path = path or scratch_path(spark, "text-index")
    # texts are cut once; the lengths and the postings are both made of the stored tokens
    read = written(items.select(F.col(id_column).alias("item_id"), *attributes,
                                *[F.coalesce(tokens, F.array().cast("array<string>")).alias(f"__{name}")
                                  for name, tokens in fields.items()]), "index-tokens")
    length = sum((F.size(f"__{name}") for name in fields), F.lit(0)).cast("long")
    _store(read.select("item_id", *attributes, length.alias("length")), f"{path}/documents")
    # a row for each field, then for each token: no function runs inside an array
    by_field = read.select("item_id", F.posexplode(F.array(*[f"__{name}" for name in fields])).alias("field", "tokens"))
    counts = [F.count_if(F.col("field") == n).cast("int").alias(f"tf{n}") for n in range(len(fields))]
    counted = (by_field.select("item_id", "field", F.explode("tokens").alias("term"))
               .groupBy("term", "item_id").agg(*counts)
               .select(bucket_of(F.col("term"), buckets).alias("bucket"), "term", "item_id", *[f"tf{n}" for n in range(len(fields))]))
    _store(counted.sortWithinPartitions("bucket", "term", "item_id"), f"{path}/postings", "bucket")
    postings = spark.read.schema(counted.schema).parquet(f"{path}/postings")
    _store(postings.groupBy("bucket", "term").agg(F.count("*").alias("documents")).sortWithinPartitions("bucket", "term"), f"{path}/terms")
    return open_index(spark, path, tuple(fields), buckets)


def _store(df: DataFrame, path: str, *by: str) -> None:
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)


def open_index(spark: SparkSession, path: str, fields: tuple[str, ...], buckets: int = BUCKETS) -> TextIndex:
    documents = spark.read.parquet(f"{path}/documents")
    item = documents.schema["item_id"].dataType.simpleString()
    # an index of no texts has no parts to read a schema from
    counts = ", ".join(f"tf{n} int" for n in range(len(fields)))
    postings = spark.read.schema(f"term string, item_id {item}, {counts}, bucket int").parquet(f"{path}/postings")
    return TextIndex(fields, buckets, postings, spark.read.parquet(f"{path}/terms"), documents)


# ---- from asked terms to postings ------------------------------------------------------------------------------

def asked_parts(index: TextIndex, asked: DataFrame) -> TextIndex:
    """Only the stored parts that an asked term can be in; there are at most as many as the index has."""
    buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]
    inside = F.col("bucket").isin(buckets)
    return replace(index, postings=index.postings.where(inside), terms=index.terms.where(inside))


def prefix_expansions(index: TextIndex, asked: DataFrame, least: int = 1) -> DataFrame:
    """(bucket, term, asked): dictionary terms that begin with an asked term (at least ``least`` letters long).

    A dictionary term gives one row for each length that some asked term has, so this is an equality join."""
    lengths = asked.where(F.length("asked") >= least).agg(F.collect_set(F.length("asked")).alias("l")).scalar()
    one_each = index.terms.select("bucket", "term", F.explode(lengths).alias("n"))
    return (one_each.where(F.col("n") <= F.length("term"))
            .select("bucket", "term", F.left("term", F.col("n")).alias("asked"))
            .join(asked.select("bucket", "asked"), ["bucket", "asked"]))


def asked_terms(index: TextIndex, queries: DataFrame, tokens: Column) -> DataFrame:
    """(query, asked, bucket, n_terms): the different terms of each query."""
    found = queries.select("query", F.array_distinct(tokens).alias("t"))
    return (found.select("query", F.size("t").alias("n_terms"), F.explode("t").alias("asked"))
            .withColumn("bucket", bucket_of(F.col("asked"), index.buckets)))


# ---- full text search ------------------------------------------------------------------------------------------

FILTERS = ["project_id", "item_type", "authority_class", "source_kind", "surface", "source_id"]


def _passes(queries: DataFrame, documents: DataFrame) -> Column:
    """The filters that both the query table and the index have; a missing value filters nothing."""
    keep = F.lit(True)
    for name in FILTERS:
        if name in queries.columns and name in documents.columns:
            keep = keep & (F.col(f"q_{name}").isNull() | F.coalesce(F.col(f"q_{name}") == F.col(name), F.lit(False)))
    if "lifecycle" in documents.columns:
        shown = F.col("q_include_superseded") if "include_superseded" in queries.columns else F.lit(False)
        keep = keep & (F.coalesce(shown, F.lit(False)) | (F.coalesce("lifecycle", F.lit("ACTIVE")) != "SUPERSEDED"))
    if "implementation_evidence_only" in queries.columns:
        keep = keep & (~F.coalesce("q_implementation_evidence_only", F.lit(False)) | F.coalesce(
            (F.col("surface") == "github") & (F.col("authority_class") == "IMPLEMENTATION_EVIDENCE"), F.lit(False)))
    return keep


def search(index: TextIndex, queries: DataFrame, tokens: Column, *, keep: Column | None = None, k1: float = 1.2,
           b: float = 0.75) -> DataFrame:
    """BM25 over prefix terms: ``query, item_id, score, match_mode, rank``.

    ``queries`` has (query, text) and any of ``FILTERS``, ``include_superseded``, ``implementation_evidence_only`` and
    ``limit`` (1 to 100, 10 by default); ``tokens`` cuts its text.  All terms must match; a query of several terms
    without such a hit takes any term.  A prefix counts all its expansions, in all fields, as one term; statistics come
    from all items, the filters apply before the decision between all and any.  Scores have six decimals, equal ones go
    by ``item_id``.  Queries without terms give nothing
    (``retrieval.listing`` lists).
    """
    asked = written(asked_terms(index, queries, tokens), "asked")
    distinct = asked.select("bucket", "asked").distinct()
    parts = asked_parts(index, distinct)
    expanded = prefix_expansions(parts, distinct)
    count = sum((F.col(f"tf{n}") for n in range(1, len(index.fields))), F.col("tf0"))
    hits = written(parts.postings.join(expanded, ["bucket", "term"])
                   .groupBy("asked", "item_id").agg(F.sum(count).alias("tf")), "search-hits")
    n, avg_len = index.documents.agg(F.count("*"), F.coalesce(F.avg("length"), F.lit(0.0))).first()
    idf = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rarity = written(hits.groupBy("asked").agg(F.count("*").alias("df"))
                     .select("asked", F.when(idf <= 0, F.lit(1e-6)).otherwise(idf).alias("idf"))
                     .withColumn("term_id", F.monotonically_increasing_id()), "rarity")
    kept = index.documents if keep is None else index.documents.where(F.coalesce(keep, F.lit(False)))
    tf = F.col("tf").cast("double")
    part = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.lit(avg_len)))
    limit = F.greatest(F.lit(1), F.least(F.coalesce("limit", F.lit(10)) if "limit" in queries.columns else F.lit(10),
                                         F.lit(MOST_HITS)))
    options = [c for c in queries.columns if c in FILTERS or c in ("include_superseded", "implementation_evidence_only")]
    # queries with the same filters share what they ask: an item and a term meet once for all of them
    shared = F.array_sort(F.collect_list(F.to_json(F.struct(F.lit(0), *options), {"ignoreNullFields": "false"})))
    filters = queries.groupBy("query").agg(F.collect_list(F.struct(F.lit(0).alias("q"), *[F.col(c).alias(f"q_{c}") for c in options])).alias("options"),
                                           F.xxhash64(shared).alias("h"), shared.alias("filter"), F.max(limit).alias("q_limit"))
    wanted = written(asked.join(filters, "query").select("filter", "options", "query", "q_limit", "asked", "n_terms"), "wanted")
    terms = wanted.groupBy("filter", "asked").agg(F.first("options").alias("options")).select("filter", "asked", F.inline("options"))
    parts = (hits.join(rarity, "asked").join(terms, "asked").join(kept, "item_id").where(_passes(queries, index.documents))
             .select("filter", "item_id", "term_id", part.alias("part")))
    found = (_best_hits(parts, wanted.join(rarity, "asked"))
             .withColumn("score", F.round("score", 6)).withColumn("all_terms", F.col("found") == F.col("n_terms")))
    order = [F.col("all_terms").desc(), F.col("score").desc(), F.col("item_id").asc()]
    top = written(top_k_per_group(found, ["query"], order, MOST_HITS), "top-hits")
    mode = top.groupBy("query").agg(F.max("all_terms").alias("best"))
    return (top.join(mode, "query").where((F.col("all_terms") == F.col("best")) & (F.col("rank") <= F.col("q_limit")))
            .select("query", "item_id", "score",
                    F.when(F.col("best"), "all").otherwise("any").alias("match_mode"), "rank"))


def _best_hits(parts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``query, item_id, score, found, n_terms, q_limit``: of each slice of items the ``MOST_HITS`` best of each query.

    ``parts`` has (filter, item_id, term_id, part), ``wanted`` (filter, query, q_limit, term_id, n_terms).  Items are cut
    into slices and queries into blocks; each slice meets each block of its filter as two small matrices, so a pair of a
    query and an item is a cell and no row, and what leaves a task is bounded.
    """
    spark = parts.sparkSession
    item_type = parts.schema["item_id"].dataType
    blocks = max(1, -(-wanted.select("query").distinct().count() // BLOCK_QUERIES))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = (parts.repartition(n, "filter", "item_id").sortWithinPartitions("filter", "item_id")
              .mapInArrow(_sliced, "filter array<string>, item_ids array<%s>, items binary, terms binary, parts binary" % item_type.simpleString()))
    asking = wanted.groupBy("filter", F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block")).agg(
        F.collect_list(F.struct("query", "term_id", F.col("n_terms").cast("long").alias("n_terms"), F.col("q_limit").cast("long").alias("q_limit"))).alias("asking"))
    query_type = wanted.schema["query"].dataType.simpleString()
    return slices.join(asking, "filter").select("item_ids", "items", "terms", "parts", "asking").repartition(n).mapInArrow(
        _scored, f"query {query_type}, item_id {item_type.simpleString()}, score double, found long, n_terms long, q_limit long")


def _sliced(batches):
    """Rows sorted by (filter, item) as slices of up to ``SLICE_ITEMS`` items; an item lies in one slice."""
    held, size = [], 0

    def cut(table, last):
        """Slices of the whole items in ``table`` and the rows of its last item, which may go on."""
        ids, filters = table.column("item_id").to_pylist(), table.column("filter").to_pylist()
        starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1] or filters[i] != filters[i - 1]]
        ends = [*starts[1:], len(ids)]
        whole = len(starts) if last else len(starts) - 1
        out, at = [], 0
        while at < whole:
            upto = at
            while upto < whole and upto - at < SLICE_ITEMS and filters[starts[upto]] == filters[starts[at]]:
                upto += 1
            rows = table.slice(starts[at], ends[upto - 1] - starts[at])
            items = np.repeat(np.arange(upto - at, dtype=np.int32), np.diff([*starts[at:upto], ends[upto - 1]]))
            out.append((filters[starts[at]], [ids[i] for i in starts[at:upto]], items.tobytes(),
                        rows.column("term_id").to_numpy().tobytes(), rows.column("part").to_numpy().tobytes()))
            at = upto
        rest = len(ids) if last else starts[-1]
        return out, table.slice(rest)

    def batch(rows, schema):
        columns = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.list_(pa.string())), pa.array(columns[1], pa.list_(schema.field("item_id").type)),
             *[pa.array(c, pa.binary()) for c in columns[2:]]], ["filter", "item_ids", "items", "terms", "parts"])

    for more in batches:
        held.append(more)
        size += more.num_rows
        if size >= SLICE_ROWS:
            rows, rest = cut(pa.Table.from_batches(held), False)
            held, size = rest.to_batches(), rest.num_rows
            for row in rows:
                yield batch([row], more.schema)
    if size:
        for row in cut(pa.Table.from_batches(held), True)[0]:
            yield batch([row], held[0].schema)


def _scored(batches):
    """The best of each query in each pair of a slice and a block."""
    for pairs in batches:
        for n in range(pairs.num_rows):
            ids = pairs.column("item_ids")[n].values
            items, terms, parts = (np.frombuffer(pairs.column(c)[n].as_py(), kind)
                                   for c, kind in (("items", np.int32), ("terms", np.int64), ("parts", float)))
            asking = pairs.column("asking")[n].values
            queries = asking.field("query").dictionary_encode()
            query, term, n_terms, limits = queries.indices.to_numpy(), *[asking.field(f).to_numpy() for f in ("term_id", "n_terms", "q_limit")]
            known, column = np.unique(term, return_inverse=True)
            times = np.zeros((len(queries.dictionary), len(known)))
            np.add.at(times, (query, column), 1)
            at = np.minimum(np.searchsorted(known, terms), len(known) - 1)
            on = known[at] == terms
            cells = at[on] * len(ids) + items[on]
            shape = len(known), len(ids)
            scores = times @ np.bincount(cells, parts[on], shape[0] * shape[1]).reshape(shape)
            there = np.bincount(cells, minlength=shape[0] * shape[1]).reshape(shape)
            found = np.rint(times @ there.astype(float)).astype(np.int64)
            by_id = np.empty(len(ids), np.int64)
            by_id[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
            out = []
            for q in range(len(times)):
                hit = np.flatnonzero(found[q])
                mine = query == q
                most = np.full(len(hit), n_terms[mine].max())
                if n_terms[mine].min() < most[:1].sum():       # one query in several wordings: the longest that matches
                    asked = np.where(there[column[mine]][:, hit] > 0, n_terms[mine][:, None], 0)
                    most = asked.max(axis=0)
                order = np.lexsort((by_id[hit], -np.floor(scores[q, hit] * 1e6 + 0.5), found[q, hit] != most))[:MOST_HITS]
                out.append((np.full(len(order), q), hit[order], scores[q, hit[order]], found[q, hit[order]], most[order],
                            np.full(len(order), limits[mine].max())))
            who, which, score, number, most, limit = (np.concatenate(c) for c in zip(*out))
            yield pa.RecordBatch.from_arrays(
                [queries.dictionary.take(pa.array(who)), ids.take(pa.array(which)), *[pa.array(c) for c in (score, number, most, limit)]],
                ["query", "item_id", "score", "found", "n_terms", "q_limit"])


# ---- lexical search over a record set --------------------------------------------------------------------------

# Question cues and the record types or statuses they favour
INTENTS = [
    (r"(^|\s)кто(\s|$)|\bwho\b", {"USER_IDENTITY": 2.0}, {}),
    (r"хоч|хотел|стремит|\bwant|\bgoal", {"USER_GOAL": 1.5}, {}),
    (r"почему|зачем|\bwhy\b|мотив", {"USER_MOTIVATION": 1.5, "USER_GOAL": 0.5}, {}),
    (r"сейчас|текущ|\bnow\b|\bcurrent", {"CURRENT_PRIORITY": 0.5}, {"CURRENT": 0.5}),
    (r"открыт|остает|неизвест|нерешен|\bopen\b|\bunknown\b|unresolved", {"OPEN_QUESTION": 2.0, "KNOWN_LIMITATION": 0.5}, {}),
    (r"сделан|уже |достигнут|установлен|\bdone\b|achiev|establish", {"RESEARCH_RESULT": 1.5, "KNOWN_LIMITATION": 0.3}, {}),
    (r"куда смотреть|где смотреть|где искать|где найти|источник|where to look|\bsource", {"SOURCE_POINTER": 2.5}, {}),
    (r"отлича|разниц|differ", {"KNOWN_LIMITATION": 0.5, "INVARIANT": 0.3}, {}),
    (r"следующ|дальше|\bnext\b", {"NEXT_ACTION": 1.5}, {}),
]


def intents_of(text: Column) -> Column:
    """Which cues a question has, one truth value for each of ``INTENTS``."""
    lowered = F.translate(F.lower(text), "ё", "е")
    return F.array(*[lowered.rlike(cue) for cue, _, _ in INTENTS])


def intent_boost(cues: Column, type_column: Column, status_column: Column) -> Column:
    """What the cues of a question add to the score of a record."""
    total = F.lit(0.0)
    for n, (_, types, statuses) in enumerate(INTENTS):
        for column, boosts in ((type_column, types), (status_column, statuses)):
            for value, boost in boosts.items():
                total = total + F.when(cues[n] & (column == value), boost).otherwise(0.0)
    return total


def lexical_index(records: DataFrame, path: str | None = None) -> TextIndex:
    """Index of records (id, type, status, statement, keywords): stemmed tokens of the text, and of the meta fields."""
    main = tx.token_set(F.concat_ws(" ", "statement", "keywords"))
    meta = tx.token_set(F.concat_ws(" ", "id", "type", "status"))
    return build_index(records, "id", {"main": main, "meta": meta}, ["type", "status"], path)


def lexical_search(index: TextIndex, queries: DataFrame, *, k: int = 5, ratio: float = 0.4) -> DataFrame:
    """Token overlap weighted by rarity, with meta and near matches, intent boosts and a cut at 40 % of the best.

    A token weighs 1 in the text, 0.5 in the meta fields, 0.6 where a token of five letters or more only shares its
    beginning (either may be the longer one).  ``queries`` has (query, text).
    """
    asked = written(asked_terms(index, queries, tx.tokens(F.col("text"))), "asked")
    distinct = asked.select("bucket", "asked").distinct()
    parts = asked_parts(index, distinct)
    exact = distinct.select("bucket", F.col("asked").alias("term"), "asked")
    long = distinct.where(F.length("asked") > NEAR_CHARS)
    shorter = long.select("bucket", "asked", F.explode(F.transform(
        F.sequence(F.lit(NEAR_CHARS), F.length("asked") - 1), lambda n: F.left("asked", n))).alias("term"))
    near = (prefix_expansions(parts, distinct, NEAR_CHARS).where("term <> asked")
            .unionByName(shorter).withColumn("near", F.lit(True)))
    ways = exact.withColumn("near", F.lit(False)).unionByName(near.select("bucket", "term", "asked", "near"))
    place = F.when(F.col("near"), 1).when(F.col("tf0") > 0, 3).otherwise(2)
    hits = written(parts.postings.join(ways, ["bucket", "term"])
                   .groupBy("asked", "item_id").agg(F.max(place).alias("place")), "lexical-hits")
    n = index.documents.count()
    # a token that only has near matches has no documents of its own
    rarity = (hits.groupBy("asked").agg(F.count_if(F.col("place") > 1).alias("df"))
              .select("asked", F.log(1 + F.lit(n) / (1 + F.col("df"))).alias("idf")))
    weight = F.when(F.col("place") == 3, 1.0).when(F.col("place") == 2, 0.5).otherwise(0.6)
    lexical = (asked.select("query", "asked").join(hits, "asked").join(rarity, "asked")
               .groupBy("query", "item_id").agg(F.sum(weight * F.col("idf")).alias("lex")).where("lex > 0"))
    rows = (lexical.join(index.documents.select("item_id", "type", "status"), "item_id")
            .join(queries.select("query", intents_of(F.col("text")).alias("cues")), "query"))
    score = (F.col("lex") + intent_boost(F.col("cues"), F.col("type"), F.col("status"))) * F.when(
        F.col("status") == "SUPERSEDED", 0.5).otherwise(1.0)
    scored = rows.select("query", F.col("item_id").alias("id"), "type", "status", F.round(score, 3).alias("score")).where("score > 0")
    top = top_k_per_group(scored, ["query"], [F.col("score").desc(), F.col("id").asc()], k)
    # the best row of each query is among its first k, so the cut needs no other pass
    best = top.groupBy("query").agg(F.max("score").alias("best"))
    return top.join(best, "query").where(F.col("score") >= ratio * F.col("best")).drop("best")
