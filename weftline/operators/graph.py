"""Connected components of string-keyed links, by repeated minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut


def components(links: DataFrame) -> DataFrame:
    """node and root, its component's smallest node, for links (a, b). Labels jump to their label's
    label in every round, so rounds grow with the logarithm of a component's width."""
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")))
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("m"))
        lower = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.least("root", "m").alias("root"), F.col("root").alias("was"))
        jump = lower.select(F.col("node").alias("root"), F.col("root").alias("top"))
        after = cut(lower.join(jump, "root", "left").select("node", F.least("root", F.coalesce("top", "root")).alias("root"), "was"))
        labels = after.select("node", "root")
        if after.filter("root <> was").isEmpty():
            return labels
