"""Registered queries: message corpora, sampling, span matching and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import spans as sp
from attesta.functions.text import FINE_PIECE, PIECE
from attesta.operators import corpus
from attesta.operators.integrity import missing_references
from attesta.plans.registry import query
from attesta.session import written

LEXICON = {"BECAUSE": r"(que|with)", "REQUEST_PLEASE": r"(the|les) ", "QUESTION_MARK": r"\?"}
# every third fine piece is missing and some are merged with the next one, so that the metrics are not trivial
GOLD_SQL = ", gold AS (SELECT message_id, pos AS span_id, start_at, end_at FROM atoms)"
PRED_SQL = """, pred AS (SELECT message_id, pos AS span_id, start_at - pos % 2 AS start_at, end_at + CASE WHEN pos % 5 = 4 THEN 40 ELSE 0 END AS end_at
  FROM preds WHERE pos % 3 <> 2)"""
PAIRS_SQL = GOLD_SQL + PRED_SQL + """
, ov AS (SELECT g.message_id, g.span_id AS gold_id, p.span_id AS pred_id, g.start_at AS gold_start, p.start_at AS pred_start,
   least(g.end_at, p.end_at) - greatest(g.start_at, p.start_at) AS common, (g.end_at - g.start_at) AS gl, (p.end_at - p.start_at) AS pl
   FROM gold g JOIN pred p ON p.message_id = g.message_id AND p.start_at < g.end_at AND p.end_at > g.start_at),
pairs AS (SELECT *, CAST(common AS DOUBLE) / CAST(gl + pl - common AS DOUBLE) AS iou FROM ov WHERE CAST(common AS DOUBLE) / CAST(gl + pl - common AS DOUBLE) >= 0.5)
"""


def _atoms(lake, pattern=PIECE):
    return corpus.atoms(lake.messages(), pattern)


def _gold(lake):
    return _atoms(lake).select("message_id", F.col("pos").cast("string").alias("span_id"), "start_at", "end_at")


def _pred(lake):
    pos = F.col("pos")
    rows = _atoms(lake, FINE_PIECE).where(pos % 3 != 2)
    return rows.select("message_id", pos.cast("string").alias("span_id"), (F.col("start_at") - pos % 2).alias("start_at"),
                       (F.col("end_at") + F.when(pos % 5 == 4, 40).otherwise(0)).alias("end_at"))


def _pairs(lake):
    return corpus.overlap_pairs(_gold(lake), _pred(lake), "message_id")


@query("C1_atoms", needs=("atoms",), sql="""
SELECT message_id || '#' || pos AS atom_id, speaker, start_at, end_at, sha256(piece) AS content_sha256 FROM atoms""")
def atoms(lake):
    return _atoms(lake).select("atom_id", "speaker", "start_at", "end_at", "content_sha256")


@query("C1_document_spans", sql=r"""
SELECT doc_id, count(*) AS spans, CAST(sum(length(piece)) AS BIGINT) AS chars, CAST(max(length(piece)) AS BIGINT) AS longest FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^.\n]*[.\n]+|[^.\n]+')) AS piece FROM documents) GROUP BY 1""")
def document_spans(lake):
    """The same cut over whole documents of up to 20,000 words."""
    rows = corpus.atoms(lake.texts("documents", "doc_id").select(F.col("doc_id").alias("message_id"), "text"), PIECE)
    size = F.col("end_at") - F.col("start_at")
    return rows.groupBy(F.col("message_id").alias("doc_id")).agg(F.count("*").alias("spans"), F.sum(size).alias("chars"), F.max(size).alias("longest"))


@query("C2_split_children", needs=("preds", "atoms"), sql="""
SELECT a.message_id || '#' || a.pos AS parent_id, p.pos AS child, p.start_at, p.end_at FROM preds p JOIN atoms a
  ON a.message_id = p.message_id AND p.start_at >= a.start_at AND p.start_at < a.end_at""")
def split_children(lake):
    """Fine pieces as children of the sentence they start in: an as-of lookup inside the message, no pairs."""
    from attesta.operators.versions import as_of_values
    def at(df):
        return df.select("message_id", F.col("start_at").alias("at"), F.col("pos").alias("tie"), F.shiftright("start_at", 10).alias("block"), "pos", "end_at")
    parents, children = at(_atoms(lake)), at(_atoms(lake, FINE_PIECE))
    rows = children.withColumn("child_key", F.concat_ws("#", "message_id", "pos", "at", "end_at"))
    found = as_of_values(rows, parents, ["message_id"], "at", "tie", F.col("pos"), [["block"]], "child_key")
    parts = F.split("child_key", "#")
    return found.select(F.concat_ws("#", "message_id", "value").alias("parent_id"), parts[1].cast("long").alias("child"),
                        F.col("at").alias("start_at"), parts[3].cast("long").alias("end_at"))


@query("A20_split_integrity", needs=("preds", "halves", "msg"), sql="""
SELECT m.message_id, count(h.pos) AS children, coalesce(string_agg(h.piece, '' ORDER BY h.pos), '') = any_value(m.text) AS reconstructs, CAST(0 AS BIGINT) AS gaps
FROM msg m LEFT JOIN halves h ON h.message_id = m.message_id GROUP BY 1""")
def split_integrity(lake):
    return corpus.split_integrity(lake.messages(), FINE_PIECE)


@query("C3_blind_inputs", needs=("atoms",), sql="""
SELECT message_id || '#' || pos AS atom_id, speaker AS source, piece AS raw_text, 'NOT_RUN' AS blind_run FROM atoms""")
def blind_inputs(lake):
    """Only listed columns leave; a label column cannot slip through."""
    return _atoms(lake).select("atom_id", F.col("speaker").alias("source"), F.col("piece").alias("raw_text"), F.lit("NOT_RUN").alias("blind_run"))


@query("C4_source_axis", needs=("msg",), sql="SELECT message_id, speaker AS source_axis FROM msg")
def source_axis(lake):
    return lake.messages().select("message_id", F.col("speaker").alias("source_axis"))


@query("F7_sampling_filter", needs=("msg",), sql="""
SELECT message_id FROM msg WHERE speaker = 'USER' AND trim(text) <> '' AND length(text) BETWEEN 20 AND 5000 AND turn >= 2""")
def sampling_filter(lake):
    return _eligible(lake).select("message_id")


def _eligible(lake):
    text = F.col("text")
    return lake.messages().where((F.col("speaker") == "USER") & (F.trim(text) != "") & F.length(text).between(20, 5000) & (F.col("turn") >= 2))


@query("F8_evidence_split", needs=("msg",), sql="""
SELECT CASE WHEN speaker IN ('USER', 'MODEL') AND length(text) > 100 THEN 'kept' ELSE 'excluded' END AS ledger, count(*) AS messages FROM msg GROUP BY 1""")
def evidence_split(lake):
    complete = F.col("speaker").isin("USER", "MODEL") & (F.length("text") > 100)
    kept, excluded = corpus.evidence_split(lake.messages(), complete)
    return (kept.agg(F.count("*").alias("messages")).select(F.lit("kept").alias("ledger"), "messages")
            .unionByName(excluded.agg(F.count("*").alias("messages")).select(F.lit("excluded").alias("ledger"), "messages")))


@query("W8_contiguous_window", needs=("msg",), sql="""
SELECT conv_id, message_id, place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, message_id) AS place FROM msg WHERE speaker = 'USER' AND turn >= 2) WHERE place <= 2""")
def contiguous_window(lake):
    users = lake.messages().where("speaker = 'USER'")
    return corpus.sample_window(users, "conv_id", "turn", 2, F.col("turn") >= 2).select("conv_id", "message_id", "place")


@query("J17_calibration_exclusion", sql="""
SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM benchmark) AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 10 = 0)""")
def calibration_exclusion(lake):
    """By content hash against the calibration texts: the benchmark and every tenth document."""
    docs = lake.table("documents").select("doc_id", "text")
    known = lake.table("benchmark").select("text").unionByName(docs.where("doc_id % 10 = 0").select("text"))
    return corpus.without_calibration(docs, known, "doc_id").select("doc_id")


@query("C5_sample_manifest", needs=("msg",), sql="""
WITH e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, message_id) AS place FROM msg
  WHERE speaker = 'USER' AND trim(text) <> '' AND length(text) BETWEEN 20 AND 5000 AND turn >= 2 AND sha256(text) NOT IN (SELECT sha256(text) FROM benchmark))
SELECT conv_id AS stream, count(*) AS collected, min(turn) AS first_turn, max(turn) AS last_turn, max(length(text)) AS longest FROM e WHERE place <= 3 GROUP BY 1""")
def sample_manifest(lake):
    """What is sampled is written down per stream before anything is annotated."""
    rows = corpus.without_calibration(_eligible(lake), lake.table("benchmark").select("text"), "message_id")
    sample = corpus.sample_window(rows, "conv_id", "turn", 3, F.lit(True))
    return sample.groupBy(F.col("conv_id").alias("stream")).agg(
        F.count("*").alias("collected"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"),
        F.max(F.length("text").cast("long")).alias("longest"))


@query("A12_axis_distribution", needs=("atoms",), sql="SELECT speaker, count(*) AS atoms, count(DISTINCT message_id) AS messages FROM atoms GROUP BY 1")
def axis_distribution(lake):
    return _atoms(lake).groupBy("speaker").agg(F.count("*").alias("atoms"), F.count_distinct("message_id").alias("messages"))


@query("A13_provenance_coverage", needs=("items",), sql="""
SELECT source_id, round(avg(CASE WHEN source_revision IS NOT NULL AND source_content_hash IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM items GROUP BY 1""")
def provenance_coverage(lake):
    from attesta.operators import reference as ref
    rows = ref.bind_items(lake.raw_items(False), ref.normalise_sources(lake.raw_sources()), hashed=False)
    complete = F.col("source_revision_at_capture").isNotNull() & F.col("source_content_hash_at_capture").isNotNull()
    return rows.groupBy("source_id").agg(F.round(F.avg(complete.cast("double")), 6).alias("coverage"))


@query("X17_span_arithmetic", needs=("atoms", "preds"), sql="""
SELECT a.message_id, a.pos, greatest(least(a.end_at, p.end_at) - greatest(a.start_at, p.start_at), 0) AS common,
  round(CAST(greatest(least(a.end_at, p.end_at) - greatest(a.start_at, p.start_at), 0) AS DOUBLE) / (a.end_at - a.start_at + p.end_at - p.start_at
    - greatest(least(a.end_at, p.end_at) - greatest(a.start_at, p.start_at), 0)), 6) AS iou
FROM atoms a JOIN preds p ON p.message_id = a.message_id AND p.pos = a.pos""")
def span_arithmetic(lake):
    a = _atoms(lake).select("message_id", "pos", "start_at", "end_at")
    p = _atoms(lake, FINE_PIECE).select("message_id", "pos", F.col("start_at").alias("ps"), F.col("end_at").alias("pe"))
    spans = (F.col("start_at"), F.col("end_at"), F.col("ps"), F.col("pe"))
    return a.join(p, ["message_id", "pos"]).select("message_id", "pos", sp.overlap(*spans).alias("common"), F.round(sp.iou(*spans), 6).alias("iou"))


@query("J16_span_overlap", needs=("atoms", "preds"), sql="WITH nothing AS (SELECT 1)" + PAIRS_SQL + """
SELECT message_id, gold_id, pred_id, round(iou, 6) AS iou FROM pairs""")
def span_overlap(lake):
    return _pairs(lake).select("message_id", F.col("gold_id").cast("long").alias("gold_id"), F.col("pred_id").cast("long").alias("pred_id"),
                               F.round("iou", 6).alias("iou"))


def _match_sql(rounds: int = 5) -> str:
    """The greedy walk as rounds of pairs that come first for both spans; a pair left over would show as a missing row."""
    text, last = "", "pairs"
    order = "iou DESC, gold_start, pred_start, gold_id, pred_id"
    for i in range(1, rounds + 1):
        text += f""", b{i} AS (SELECT *, row_number() OVER (PARTITION BY message_id, gold_id ORDER BY {order}) AS rg,
          row_number() OVER (PARTITION BY message_id, pred_id ORDER BY {order}) AS rp FROM {last}),
        a{i} AS (SELECT message_id, gold_id, pred_id, iou FROM b{i} WHERE rg = 1 AND rp = 1),
        r{i} AS (SELECT p.* FROM {last} p WHERE NOT EXISTS (SELECT 1 FROM a{i} a WHERE a.message_id = p.message_id AND a.gold_id = p.gold_id)
          AND NOT EXISTS (SELECT 1 FROM a{i} a WHERE a.message_id = p.message_id AND a.pred_id = p.pred_id))"""
        last = f"r{i}"
    taken = " UNION ALL ".join(f"SELECT * FROM a{i}" for i in range(1, rounds + 1))
    return text + f", matched AS ({taken})"


MATCH_SQL = "WITH nothing AS (SELECT 1)" + PAIRS_SQL + _match_sql()
LABEL_SQL = MATCH_SQL + """
, lab AS (SELECT a.speaker AS gold_label, CASE WHEN length(p.piece) % 3 = 0 THEN 'MODEL' ELSE 'USER' END AS pred_label FROM matched m
  JOIN atoms a ON a.message_id = m.message_id AND a.pos = m.gold_id JOIN halves p ON p.message_id = m.message_id AND p.pos = m.pred_id)
"""


@query("W9_one_to_one_match", needs=("atoms", "preds"), sql=MATCH_SQL + """
SELECT message_id, CAST(gold_id AS VARCHAR) AS gold_id, CAST(pred_id AS VARCHAR) AS pred_id, round(iou, 6) AS iou FROM matched""")
def one_to_one_match(lake):
    return corpus.one_to_one(_pairs(lake), "message_id").select("message_id", "gold_id", "pred_id", F.round("iou", 6).alias("iou"))


COUNTS_SQL = GOLD_SQL + PRED_SQL + """
, wide AS (SELECT p.message_id, p.span_id, p.start_at, p.end_at FROM pred p JOIN gold g ON g.message_id = p.message_id AND g.start_at < p.end_at AND g.end_at > p.start_at
   GROUP BY ALL HAVING count(*) > 1)
"""


@query("A14_overlap_counts", needs=("atoms", "preds"), sql="WITH nothing AS (SELECT 1)" + COUNTS_SQL + """
SELECT g.message_id, g.span_id, count(p.span_id) AS partners FROM gold g LEFT JOIN pred p ON p.message_id = g.message_id AND p.start_at < g.end_at AND p.end_at > g.start_at
GROUP BY 1, 2""")
def overlap_counts(lake):
    return corpus.overlap_counts(_gold(lake), _pred(lake), "message_id").select("message_id", F.col("span_id").cast("long").alias("span_id"), "partners")


@query("A14_segmentation_metrics", needs=("atoms", "preds"), sql=MATCH_SQL + """
, wide AS (SELECT p.message_id, p.start_at, p.end_at FROM pred p JOIN gold g ON g.message_id = p.message_id AND g.start_at < p.end_at AND g.end_at > p.start_at
   GROUP BY p.message_id, p.span_id, p.start_at, p.end_at HAVING count(*) > 1),
cnt AS (SELECT count(*) AS n_gold, count(*) FILTER (WHERE (SELECT count(*) FROM pred p WHERE p.message_id = g.message_id AND p.start_at < g.end_at AND p.end_at > g.start_at) > 1) AS split,
   count(*) FILTER (WHERE (SELECT count(*) FROM wide w WHERE w.message_id = g.message_id AND w.start_at < g.end_at AND w.end_at > g.start_at) > 0) AS merged FROM gold g),
tp AS (SELECT count(*) AS tp, avg(iou) AS mean_iou FROM matched)
SELECT n_gold, (SELECT count(*) FROM pred WHERE end_at > start_at) AS n_pred, tp, round(tp / n_gold, 6) AS recall,
  round(tp / (SELECT count(*) FROM pred WHERE end_at > start_at), 6) AS precision, round((n_gold - tp) / n_gold, 6) AS missed_rate, round(mean_iou, 6) AS mean_iou,
  round(split / n_gold, 6) AS over_segmentation, round(merged / n_gold, 6) AS under_segmentation FROM cnt, tp""")
def segmentation_metrics(lake):
    gold, pred = written(_gold(lake), "gold"), written(_pred(lake), "pred")
    matched = corpus.one_to_one(corpus.overlap_pairs(gold, pred, "message_id"), "message_id")
    return corpus.segmentation_metrics(gold, pred, matched, "message_id")


def _matched_labels(lake):
    """Matched spans with the gold and the predicted type (both by simple rules over the span)."""
    matched = corpus.one_to_one(_pairs(lake), "message_id")
    gold = _atoms(lake).select("message_id", F.col("pos").cast("string").alias("gold_id"), F.col("speaker").alias("gold_label"))
    pred = _atoms(lake, FINE_PIECE).select("message_id", F.col("pos").cast("string").alias("pred_id"),
                                           F.when(F.length("piece") % 3 == 0, "MODEL").otherwise("USER").alias("pred_label"))
    return matched.join(gold, ["message_id", "gold_id"]).join(pred, ["message_id", "pred_id"])


@query("J21_typing_on_matches", needs=("atoms", "preds"), sql=LABEL_SQL + """
SELECT gold_label, pred_label, count(*) AS pairs FROM lab GROUP BY 1, 2""")
def typing_on_matches(lake):
    return _matched_labels(lake).groupBy("gold_label", "pred_label").agg(F.count("*").alias("pairs"))


@query("C6_segmentation_report", needs=("atoms", "preds"), sql=LABEL_SQL + """
SELECT 'SOURCE' AS axis, gold_label, pred_label, n, CASE WHEN sum(n) OVER (PARTITION BY gold_label) < 20 THEN 'SPARSE / NOT_ESTIMABLE' ELSE 'ESTIMABLE' END AS status
FROM (SELECT gold_label, pred_label, count(*) AS n FROM lab GROUP BY 1, 2)""")
def segmentation_report(lake):
    """Detection first, typing only on matched spans."""
    labels = _matched_labels(lake)
    return corpus.confusion(labels, "SOURCE", "gold_label", "pred_label", 20)


@query("A15_confusion_matrix", sql="""
WITH r AS (SELECT CAST(l.quality AS VARCHAR) AS g, CASE WHEN d.n_chars > 400 THEN '1' ELSE '0' END AS p FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
c AS (SELECT g, p, count(*) AS n FROM r GROUP BY 1, 2)
SELECT 'QUALITY' AS axis, g AS gold_label, p AS pred_label, n, CASE WHEN sum(n) OVER (PARTITION BY g) < 50 THEN 'SPARSE / NOT_ESTIMABLE' ELSE 'ESTIMABLE' END AS status FROM c""")
def confusion_matrix(lake):
    return corpus.confusion(_quality(lake), "QUALITY", "gold_label", "pred_label", 50)


def _quality(lake):
    docs = lake.table("documents").select("doc_id", F.when(F.col("n_chars") > 400, "1").otherwise("0").alias("pred_label"))
    labels = lake.table("labels").select("doc_id", F.col("quality").cast("string").alias("gold_label"), "toxic")
    return docs.join(labels, "doc_id")


@query("A16_critical_errors", sql="""
SELECT count(*) FILTER (WHERE l.quality = 0 AND d.n_chars > 400) AS promotion, count(*) FILTER (WHERE l.quality = 1 AND d.n_chars <= 400) AS unselected_loss,
  count(*) FILTER (WHERE l.toxic = 0 AND d.n_chars <= 400) AS rejection_fabrication FROM documents d JOIN labels l ON l.doc_id = d.doc_id""")
def critical_errors(lake):
    gold, pred = F.col("gold_label"), F.col("pred_label")
    return corpus.critical_errors(_quality(lake), {
        "promotion": (gold == "0") & (pred == "1"), "unselected_loss": (gold == "1") & (pred == "0"),
        "rejection_fabrication": (F.col("toxic") == 0) & (pred == "0")})


@query("C7_label_surfaces", sql="""
WITH a AS (SELECT doc_id, quality FROM labels WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, toxic FROM labels WHERE doc_id % 4 <> 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN quality IS NULL THEN 'UNKNOWN' WHEN quality = 1 THEN 'PRESENT' ELSE 'NOT_PRESENT' END AS source_presence,
  CASE WHEN toxic IS NULL THEN 'UNKNOWN' WHEN toxic = 1 THEN 'PRESENT' ELSE 'NOT_PRESENT' END AS report_presence,
  CASE WHEN quality IS NULL AND toxic IS NULL THEN 'UNKNOWN' WHEN quality IS NULL OR toxic IS NULL THEN 'UNDERDETERMINED' WHEN quality = toxic THEN 'COMPATIBLE' ELSE 'INCOMPATIBLE' END AS compatibility
FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def label_surfaces(lake):
    labels = lake.table("labels")
    a = labels.where("doc_id % 3 <> 0").select("doc_id", "quality")
    b = labels.where("doc_id % 4 <> 0").select("doc_id", "toxic")
    q, t = F.col("quality"), F.col("toxic")
    status = (F.when(q.isNull() & t.isNull(), "UNKNOWN").when(q.isNull() | t.isNull(), "UNDERDETERMINED")
              .when(q == t, "COMPATIBLE").otherwise("INCOMPATIBLE"))
    return a.join(b, "doc_id", "full_outer").select("doc_id", corpus.presence(q).alias("source_presence"),
                                                    corpus.presence(t).alias("report_presence"), status.alias("compatibility"))


@query("C8_dependency_edges", needs=("msg",), sql="""
SELECT CASE WHEN turn % 2 = 1 THEN 'ANSWERS' ELSE 'CONTINUES' END AS edge_type, count(*) AS edges,
  count(*) FILTER (WHERE turn = 0) AS missing_context FROM msg GROUP BY 1""")
def dependency_edges(lake):
    """Each turn depends on the one before it; an edge without its target is counted as missing context."""
    turns = lake.messages().select("message_id", "conv_id", "turn")
    edges = turns.select("message_id", F.concat_ws(":", "conv_id", F.col("turn") - 1).alias("target"),
                         F.when(F.col("turn") % 2 == 1, "ANSWERS").otherwise("CONTINUES").alias("edge_type"))
    lost = missing_references(edges, turns, "target", "message_id", "message_id").select("message_id", F.lit(True).alias("lost"))
    return edges.join(lost, "message_id", "left").groupBy("edge_type").agg(
        F.count("*").alias("edges"), F.count_if(F.coalesce("lost", F.lit(False))).alias("missing_context"))


@query("X13_markers", needs=("msg",), sql=r"""
WITH k AS (SELECT message_id, text, 'BECAUSE' AS kind, regexp_extract_all(text, '(que|with)') AS hits, regexp_split_to_array(text, '(que|with)') AS gaps FROM msg
  UNION ALL SELECT message_id, text, 'REQUEST_PLEASE', regexp_extract_all(text, '(the|les) '), regexp_split_to_array(text, '(the|les) ') FROM msg),
u AS (SELECT message_id, kind, unnest(hits) AS piece, unnest(list_slice(gaps, 1, len(hits))) AS gap, unnest(range(len(hits))) AS i FROM k),
s AS (SELECT message_id, kind, piece, CAST(sum(length(gap) + length(piece)) OVER (PARTITION BY message_id, kind ORDER BY i) - length(piece) AS BIGINT) AS start_at FROM u)
SELECT message_id, kind, start_at, start_at + length(piece) AS end_at, piece FROM s
UNION ALL SELECT message_id, 'NONE', NULL, NULL, NULL FROM msg WHERE message_id NOT IN (SELECT message_id FROM s)""")
def markers(lake):
    """All markers of a lexicon (a parameter) with offsets, and a NONE row for a message without any."""
    found = F.col("found")
    none = F.array(F.struct(F.lit("NONE").alias("kind"), F.lit(None).cast("long").alias("start_at"), F.lit(None).cast("long").alias("end_at"),
                            F.lit(None).cast("string").alias("piece")))
    rows = lake.messages().select("message_id", sp.markers(F.col("text"), LEXICON).alias("found"))
    return rows.select("message_id", F.explode(F.when(F.size(found) > 0, found).otherwise(none)).alias("m")).select("message_id", "m.*")


@query("V18_freeze_receipt", needs=("msg",), sql="""
SELECT conv_id, count(*) AS items, count(DISTINCT turn) < count(*) AS has_duplicates, max(turn) - min(turn) + 1 > count(DISTINCT turn) AS has_gaps,
  min(turn) = 0 AS starts_at_zero, count(*) FILTER (WHERE trim(text) = '') = 0 AS all_filled FROM msg GROUP BY 1""")
def freeze_receipt(lake):
    distinct = F.count_distinct("turn")
    return lake.messages().groupBy("conv_id").agg(
        F.count("*").alias("items"), (distinct < F.count("*")).alias("has_duplicates"),
        (F.max("turn") - F.min("turn") + 1 > distinct).alias("has_gaps"), (F.min("turn") == 0).alias("starts_at_zero"),
        (F.count_if(F.trim("text") == "") == 0).alias("all_filled"))
