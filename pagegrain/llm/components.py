"""Connected components of links between documents, without a hub meeting in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrain.runtime import shared_folder, ship_package

EDGES = "a long, b long"
#: Edges that one task may resolve; beyond it rounds of contraction go on over the cluster.
LAST_EDGES = 1_000_000


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and for each the smallest node reachable."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(u):
        low = np.minimum(root[u], root[v])
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        apart = root[u] != root[v]
        u, v = u[apart], v[apart]
    return nodes, nodes[root]


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the edges of a task: one edge from each node to the smallest that it reaches there."""
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        a, b = np.concatenate([a, batch["a"].to_numpy(zero_copy_only=False)]), np.concatenate([b, batch["b"].to_numpy(zero_copy_only=False)])
        if len(a) > LAST_EDGES:
            a, b = smallest_reachable(a, b)
            a, b = a[a != b], b[a != b]
    if len(a):
        a, b = smallest_reachable(a, b)
        yield pa.RecordBatch.from_pydict({"a": a[a != b], "b": b[a != b]})


def components(edges: DataFrame, last_edges: int = LAST_EDGES) -> DataFrame:
    """(node, component) of each node with a link: the smallest node that it reaches.

    ``edges`` has columns a and b. Each task first reduces its edges to a forest. While more than ``last_edges`` remain,
    each node is replaced by its smallest neighbour (minima are summed up before the shuffle) and the graph contracts.
    Every round is a table in the shared folder, so a lost executor costs one round at most.
    """
    spark = edges.sparkSession
    ship_package(spark)
    folder, maps = shared_folder(spark, "components"), []
    edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b").mapInArrow(forest, EDGES).write.parquet(f"{folder}/edges-0")
    left = spark.read.parquet(f"{folder}/edges-0")
    for k in range(1, 64):
        if left.count() <= last_edges:
            break
        both = left.union(left.select("b", "a"))
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up")).write.parquet(f"{folder}/up-{k}")
        up = spark.read.parquet(f"{folder}/up-{k}")
        maps.append(up)
        moved = left.join(up.select(F.col("node").alias("a"), F.col("up").alias("a2")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("b2")), "b")
        moved.select(F.col("a2").alias("a"), F.col("b2").alias("b")).filter("a <> b").distinct().mapInArrow(forest, EDGES).write.parquet(f"{folder}/edges-{k}")
        left = spark.read.parquet(f"{folder}/edges-{k}")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in forest(batches):
            roots = np.unique(f["b"].to_numpy())
            yield pa.RecordBatch.from_pydict({"node": np.concatenate([f["a"].to_numpy(), roots]), "component": np.concatenate([f["b"].to_numpy(), roots])})

    found = left.coalesce(1).mapInArrow(label, "node long, component long")  # at most last_edges edges
    for up in reversed(maps):
        found = up.join(found.select(F.col("node").alias("up"), "component"), "up", "left").select("node", F.coalesce("component", "up").alias("component"))
    return found
