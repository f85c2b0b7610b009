"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Labels are broadcast while there are at most so many; beyond, they are joined by shuffles.
FEW_LABELS = 200_000


def components(links: DataFrame, cut: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(v, c) for every end of links (a, b): c is the least v reachable. Labels and links stay on the executors;
    each round is written to the shared scratch folder by cut, and the driver sees counts. While the labels are few (counted), a round
    shuffles once, and its tables have few files."""
    both = cut(links.select("a", "b").where("a != b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a != b")).distinct(), "links")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("c"))
    few = both.count() <= FEW_LABELS  # each label has a link at least
    sent = F.broadcast if few else (lambda df: df)
    packed = (lambda df: df.coalesce(4)) if few else (lambda df: df)
    labels = cut(packed(labels), "labels")
    while True:
        near = both.join(sent(labels.withColumnRenamed("v", "b")), "b").groupBy("a").agg(F.min("c").alias("m"))
        step = near.join(sent(labels), labels["v"] == near["a"]).select("v", F.least("c", "m").alias("d"), F.col("c").alias("before"))
        jump = labels.select(F.col("v").alias("d"), F.col("c").alias("e"))
        new = cut(packed(step.join(sent(jump), "d").select("v", F.least("d", "e").alias("c"), (F.least("d", "e") != F.col("before")).alias("moved"))), "labels")
        moved = new.where("moved").limit(1).count()
        labels = new.select("v", "c")
        if not moved:
            return labels
