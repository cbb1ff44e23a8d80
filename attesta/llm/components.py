"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.session import written


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every end of ``links`` (``a, b``): label is the smallest node that can be reached.

    Each round every node takes the smallest label among its neighbours and then its label's label, so long chains
    halve; rounds end when nothing changes.  Each round's result is stored.  Labels and links are narrow, and a node
    with very many links is pre-aggregated in the tasks.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.where("a <> b").distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")),
                     "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        lowered = labels.join(near, "node").select("node", F.col("label").alias("old"),
                                                   F.least("label", "near").alias("label"))
        lowered = written(lowered, "labels")
        if lowered.where("label <> old").limit(1).count() == 0:
            return lowered.select("node", "label")
        up = lowered.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = written(lowered.join(up, "label", "left")
                         .select("node", F.least("label", F.coalesce("next", "label")).alias("label")), "labels")
