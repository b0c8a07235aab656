"""Connected components of a large graph by alternating large-star and small-star steps.

(Kiveris et al., Connected Components in MapReduce and Beyond, 2014.) Edges first shrink to local spanning forests
inside each partition. Every step is a min-aggregation (combined before the shuffle) and an equi-join; its result is
written to the shared folder, so the lineage never grows and no label is ever held by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juristream.llm.common import materialise, tidy

MOST_STEPS = 60


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The graph of edges (a, b) as stars: every node that is not its component's smallest, and that smallest."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(before, root):
            break
    inner = root != np.arange(len(nodes))
    return nodes[inner], nodes[root[inner]]


def _shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps a forest of what it has seen so far, so memory follows the nodes of a partition, not its edges."""
    a = b = np.empty(0, np.int64)
    for batch in batches:
        a, b = local_roots(np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()]))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def connected_components(edges: DataFrame, shrink: bool = True) -> DataFrame:
    """edges: two columns of long ids, in any order, repeated or reflexive. Returns node, component (its smallest
    node) for every node of an edge that joins two different nodes; nodes without such edges don't appear.

    shrink: whether each partition is first reduced to a forest; not needed where edges come as such.
    """
    a, b = edges.columns
    one = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    stars = materialise((one.mapInArrow(tidy(_shrink), "a long, b long") if shrink else one).distinct(), "edges")
    state = None
    for _ in range(MOST_STEPS):
        large = _star(stars.union(stars.select("b", "a")), keep="both")
        stars = materialise(_star(large, keep="small"), "stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = now
    raise RuntimeError(f"no fixed point after {MOST_STEPS} steps")


def _star(edges: DataFrame, keep: str) -> DataFrame:
    """edges a, b. 'both': links every larger neighbour of a to the smallest of a and its neighbours.
    'small' (a > b in all rows): links a and its smaller neighbours to the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    if keep == "both":
        low = low.select("a", F.least("a", "low").alias("low"))
        joined = edges.join(low, "a").where("b > a")
        return joined.select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    joined = edges.join(low, "a")
    return joined.select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*").where("a > b").distinct()
