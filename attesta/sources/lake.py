"""The given tables and how they stand for sources, items, relations, work items and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from attesta.functions.vocabulary import (
    AUTHORITY_CLASSES, MAPPED_CURRENTNESS, SOURCE_KINDS, SURFACES, WORK_ROLES, WORK_SURFACES, WORK_TYPES)
from attesta.plans.scale import lookup_join, never_sent


def pick(values: list[str], index: Column) -> Column:
    """The value at ``index`` modulo the length of the list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


class Lake:
    """Reads the given tables of one folder and derives the domain tables from them."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root
        self._schemas: dict[str, StructType] = {}

    def table(self, name: str) -> DataFrame:
        """One table; its schema is read from the files once for each lake, so that later reads start no job."""
        path = f"{self.root}/{name}.parquet"
        if name not in self._schemas:
            self._schemas[name] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[name]).parquet(path)

    def texts(self, name: str, key: str) -> DataFrame:
        """A table of texts for costly row work.

        A table of many splits is read as it lies.  Where a table is one unsplittable file, the session may ask for its
        rows to be dealt first: ``spark.attesta.text.partitions``."""
        asked = self.spark.conf.get("spark.attesta.text.partitions", None)
        rows = self.table(name)
        return rows.repartition(int(asked), key) if asked else rows

    # ---- reference memory -------------------------------------------------
    def raw_sources(self) -> DataFrame:
        """One record per document source, with blanks where a bundle would leave a field empty."""
        n = F.col("n")
        return (self.table("documents").select(F.col("source").alias("source_id")).distinct()
                .withColumn("n", F.expr("substring(source_id, 4)").cast("int"))
                .select(
                    "source_id", F.concat(F.lit("Source "), n).alias("title"),
                    pick(SURFACES, n).alias("surface"), pick(SOURCE_KINDS, n).alias("source_kind"),
                    pick(AUTHORITY_CLASSES, n).alias("authority_class"),
                    F.concat(F.lit("p"), n % 4).alias("project_id"),
                    F.concat(F.lit("loc:"), "source_id").alias("locator"),
                    F.when(n % 5 == 0, "").otherwise(F.concat(F.lit("r"), n % 3)).alias("revision"),
                    F.concat(F.lit("2024-01-"), F.lpad((n % 28 + 1).cast("string"), 2, "0")).alias("as_of"),
                    pick(MAPPED_CURRENTNESS, n).alias("currentness"),
                    F.when(n % 2 == 0, "").otherwise("public").alias("privacy"),
                    F.when(n % 6 == 0, "").otherwise(F.substring(F.sha2("source_id", 256), 1, 16))
                    .alias("content_hash")))

    def current_sources(self) -> DataFrame:
        """The same sources after a later revision of every third one."""
        n = F.expr("substring(source_id, 4)").cast("int")
        moved = n % 3 == 0
        return (self.raw_sources()
                .withColumn("revision", F.when(moved, "r9").otherwise(F.col("revision")))
                .withColumn("as_of", F.when(moved, "2024-03-01").otherwise(F.col("as_of"))))

    def raw_items(self, with_text: bool = True) -> DataFrame:
        """One claim per document; the label decides the type, blanks are left to normalisation.

        Without their texts documents are no larger than the labels, which are never a broadcast then."""
        doc = F.col("doc_id")
        columns = ["doc_id", "lang", "source"] + (["text"] if with_text else [])
        documents = self.table("documents").select(*columns)
        quality = self.table("labels").select("doc_id", "quality")
        quality = quality if with_text else never_sent(quality)
        item_type = (F.when(doc % 97 == 5, "MYSTERY").when(doc % 10 == 3, "IMPLEMENTATION_FACT")
                     .when(doc % 10 == 7, "HUMAN_LENS").when(F.col("quality") == 1, "RESEARCH_RESULT")
                     .when(F.col("quality") == 0, "HYPOTHESIS").otherwise("UNKNOWN"))
        return documents.join(quality, "doc_id", "left").select(
            F.concat(F.lit("d"), doc).alias("item_id"), F.col("source").alias("source_id"),
            F.when(doc % 3 == 0, "").otherwise(F.col("lang")).alias("project_id"),
            item_type.alias("item_type"),
            (F.col("text") if with_text else F.lit(None).cast("string")).alias("claim"),
            F.concat(F.lit("s"), doc % 5).alias("source_section"),
            F.when(doc % 13 == 0, "open PR branch").otherwise("").alias("source_status"),
            F.when(doc % 11 == 0, "verified").when(doc % 2 == 0, "").otherwise("HYPOTHESIS").alias("epistemic_state"),
            F.lit("").alias("authority_scope"), F.lit("").alias("validity"),
            F.when(doc % 4 == 0, "").otherwise((doc % 10).cast("string")).alias("confidence"),
            F.when(doc % 5 == 0, "2024-02-02").otherwise("").alias("as_of"),
            F.when((doc % 25 == 0) & (doc > 0), F.concat(F.lit("d"), doc - 1)).otherwise("").alias("supersedes_item_id"),
            F.lit("").alias("provenance"), doc.alias("line"))

    def relations(self) -> DataFrame:
        """One edge per order line: from the order to the part."""
        kind = (F.when(F.col("l_returnflag") == "R", "DERIVED_FROM")
                .when(F.col("l_returnflag") == "A", "SUPPORTS").otherwise("RELATED_TO"))
        return self.table("lineitem").select(
            F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("edge_id"),
            F.concat(F.lit("o"), "l_orderkey").alias("from_item_id"),
            F.concat(F.lit("p"), "l_partkey").alias("to_item_id"), kind.alias("relation_type"),
            "l_orderkey", "l_partkey", "l_linenumber")

    def revisions(self) -> DataFrame:
        """Revisions of one logical item per customer, in the order of (order date, order key)."""
        return self.table("orders").select(
            F.col("o_custkey").alias("logical_id"), F.col("o_orderkey").alias("revision_no"),
            F.to_date("o_orderdate").alias("at"), F.col("o_orderstatus").alias("status"),
            F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"),
            F.col("o_orderpriority").alias("priority"),
            F.to_date("o_orderdate").alias("day"))

    # ---- working memory ---------------------------------------------------
    def work_projects(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").cast("long").alias("project_id"),
            F.concat(F.lit("N"), "n_nationkey").alias("code"), F.col("n_name").alias("name"))

    def work_sources(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.table("supplier").select(
            F.concat(F.lit("s"), key).alias("source_id"), F.col("s_nationkey").cast("long").alias("project_id"),
            pick(WORK_SURFACES, key).alias("surface"), pick(WORK_ROLES, key).alias("role"),
            F.col("s_name").alias("title"), F.concat(F.lit("loc:"), key).alias("locator"))

    def work_items(self) -> DataFrame:
        """One work item per order, placed in the project of the customer's nation."""
        key = F.col("o_orderkey")
        orders = self.table("orders")
        customers = self.table("customer").select(
            F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("long").alias("project_id"),
            F.col("c_mktsegment").alias("thread"))
        status = (F.when(key % 10 == 6, "CURRENT").when(key % 10 == 7, "BLOCKED").when(key % 10 == 8, "RESOLVED")
                  .when(key % 10 == 9, "UNKNOWN").when(F.col("o_orderstatus") == "O", "OPEN")
                  .when(F.col("o_orderstatus") == "P", "IN_PROGRESS").otherwise("COMPLETED"))
        level = F.substring("o_orderpriority", 1, 1)
        priority = (F.when(level == "1", "P0").when(level == "2", "P1").when(level == "3", "P2")
                    .when(level == "4", "P3").otherwise("TAIL"))
        joined = lookup_join(orders, customers, ["o_custkey"], ["o_orderkey"], "inner", salts=1)
        return joined.select(
            F.concat(F.lit("w"), F.lpad(key.cast("string"), 12, "0")).alias("work_id"), "project_id", "thread",
            pick(WORK_TYPES, key).alias("type"), status.alias("status"), priority.alias("priority"),
            F.concat(F.lit("order "), key).alias("title"),
            F.when(key % 5 == 0, "").otherwise(F.concat(F.lit("note "), key)).alias("status_note"),
            F.when(key % 3 == 0, "").when(key % 3 == 1, "  ").otherwise(F.concat(F.lit("ship "), key)).alias("next_action"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("updated_at"),
            F.when(key % 4 == 0, F.lit(None)).otherwise(F.date_format(F.date_add(F.to_date("o_orderdate"), 3), "yyyy-MM-dd"))
            .alias("resolved_at"),
            F.when(key % 17 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("archived_at"),
            key.alias("order_key"))

    # ---- events and messages ----------------------------------------------
    def governance_events(self) -> DataFrame:
        """Typed events of one scope per user; the conflict key is the parity of ``props.k``."""
        kind = (F.when(F.col("event_type") == "click", "MODEL_PROPOSAL")
                .when(F.col("event_type") == "purchase", "USER_DECISION")
                .when(F.col("event_type") == "error", "RESEARCH_CLAIM")
                .when(F.col("event_type") == "view", "QUERY_RESUME").otherwise("OPEN_LOOP"))
        return self.table("events").select(
            "event_id", "ts", F.col("user_id").alias("scope"), kind.alias("event_type"),
            (F.get_json_object("props", "$.k").cast("long") % 2).alias("parity"),
            F.date_trunc("minute", "ts").alias("minute"))

    def messages(self) -> DataFrame:
        speaker = (F.when(F.col("role") == "user", "USER").when(F.col("role") == "assistant", "MODEL")
                   .when(F.col("role") == "system", "TOOL").otherwise("UNKNOWN"))
        return self.table("conversations").select(
            F.concat_ws(":", "conv_id", "turn").alias("message_id"), "conv_id", "turn", "role",
            speaker.alias("speaker"), "text")
