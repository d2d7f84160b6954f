"""Connected components as DataFrame operations: links never leave the executors.

Links of whole numbers that are few enough for one task, whose memory ``ONE_TASK`` bounds, are joined
there at once; more of them, and links of other types, in rounds over all executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import cut


#: Links that one task joins (16 bytes each, and some copies).
ONE_TASK = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, node) for each node that the links a, b join with a smaller one."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low, after = np.minimum(label[i], label[j]), label.copy()
        np.minimum.at(after, label[i], low)
        np.minimum.at(after, label[j], low)
        while (after != after[after]).any():
            after = after[after]
        if (after == label).all():
            joined = label != np.arange(len(nodes))
            return nodes[label[joined]], nodes[joined]
        label = after


def _one_task(links: DataFrame) -> DataFrame | None:
    """node and root for (node, root) links that are cut off already, if they are few."""
    if {f.dataType.simpleString() for f in links.schema} != {"bigint"} or links.count() > ONE_TASK:
        return None

    def work(batches):
        batches = [b for b in batches if b.num_rows]
        if batches:
            table = pa.Table.from_batches(batches)
            root, node = forest(table["node"].to_numpy(), table["root"].to_numpy())
            yield pa.RecordBatch.from_pydict({"node": pa.array(node), "root": pa.array(root)})

    return cut(links.coalesce(1).mapInArrow(work, "node long, root long"))


def roots(parents: DataFrame) -> DataFrame:
    """node, root for a forest of (node, parent) in which each node has one parent at most; a tree's root
    stands for it and is one of its nodes.

    Pointer jumping: the distance to the root halves with every join.
    """
    now = cut(parents.select("node", F.col("parent").alias("root")))
    if (found := _one_task(now)) is not None:
        return found
    while True:
        up = now.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = cut(now.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")))
        now = jumped.select("node", "root")
        if jumped.filter("moved").isEmpty():
            return now


def components(links: DataFrame) -> DataFrame:
    """node, root (its component's smallest node) for links (a, b), by alternating large and small
    stars. Smallest neighbours are aggregated map-side and cut off before they are joined, so that Spark
    can split the join at a node with very many links."""

    def star(edges: DataFrame) -> DataFrame:
        """Links of each node to the smallest of its neighbours and itself."""
        least = cut(edges.groupBy("u").agg(F.min("v").alias("m")))
        return edges.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))

    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    if (found := _one_task(edges.select(F.col("u").alias("node"), F.col("v").alias("root")))) is not None:
        return found
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        near = star(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(near.select("u", F.col("m").alias("v")))
        edges = cut(small.filter("u <> v").distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
