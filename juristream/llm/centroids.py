"""Operator 12: centroid clustering (Lloyd's rounds) by annulus search.

Centroids are sorted by norm. A vector's distance to the nearest of a few centroids, those around the nearest of some leaders, bounds its distance to
the nearest of all from above; a centroid within that distance of the vector has a norm within it of the vector's (triangle inequality). Binary search finds the centroids of that
annulus, ends included; these are compared exactly. Vectors of a batch are taken in order of their annuli's width and norm, so that neighbours share
most of their annuli and are compared as one product.

Each round is one pass over the vectors, which nothing shuffles: tasks add up their vectors by cluster, and only these sums, a row a cluster and task,
are brought together.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juristream.llm.common import finished, materialise, scope, tidy
from juristream.llm.topk import scaled

#: Rows of vectors that are compared with their annuli together, and rows of a batch whose norms are sorted together.
ROWS, SORTED = 256, 65_536
#: Numbers that all centroids may have together: they are held by the driver and sent to every task.
MOST_NUMBERS = 1 << 24
#: Parts in which tasks' sums of a cluster are added up first.
PARTS = 64
LONG = (1 << 63) - 1


class Annulus:
    """Nearest of integer centroids (ties: the smallest number), by squared Euclidean distance."""

    def __init__(self, centroids: list[list[int]]):
        c = np.array(centroids, dtype=object)
        big = max((abs(x) for row in centroids for x in row), default=0)
        self.exact = c.ndim == 2 and big**2 * 4 * c.shape[1] < 2**52
        self.big = big
        self.whole = c
        if not self.exact:
            return
        c = c.astype(np.float64)
        norms = np.sqrt((c * c).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.c, self.norms = c[self.order], norms[self.order]
        self.squares = (self.c * self.c).sum(axis=1)
        self.compared = 0  # distances computed so far
        # Every so many'th by norm, about the square root of all: drawn from where centroids lie, so their groups are of like size.
        self.leaders = np.arange(0, len(self.c), max(1, math.isqrt(len(self.c))))
        own = self._distances(self.c, self.squares, self.leaders).argmin(axis=1)
        self.around = [np.flatnonzero(own == g) for g in range(len(self.leaders))]
        self.compared = 0

    def _distances(self, x: np.ndarray, squares: np.ndarray, at) -> np.ndarray:
        self.compared += len(x) * len(self.c[at])
        return squares[:, None] - 2 * (x @ self.c[at].T) + self.squares[at]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each row's nearest centroid: integers, exactly. Distances are Python's integers where doubles don't hold them."""
        if not self.exact or x.dtype == object or max(np.abs(x).max(initial=0), self.big) ** 2 * 4 * x.shape[1] >= 2**52:
            whole = np.array([[int(v) for v in row] for row in x], dtype=object).reshape(x.shape)
            every = [[int(d @ d) for d in (row - self.whole)] for row in whole]
            best = [min(range(len(d)), key=d.__getitem__) for d in every]
            return np.array(best, np.int64), np.array([d[b] for d, b in zip(every, best, strict=True)], dtype=object)
        number, distance = np.empty(len(x), np.int64), np.empty(len(x))
        squares = (x * x).sum(axis=1)
        norms = np.sqrt(squares)
        for at in range(0, len(x), SORTED):
            part = slice(at, at + SORTED)
            leader = self._distances(x[part], squares[part], self.leaders).argmin(axis=1)
            bound = np.empty(len(leader))
            for g, some in enumerate(self.around):
                rows = np.flatnonzero(leader == g)
                if not len(rows):
                    continue
                bound[rows] = self._distances(x[at + rows], squares[at + rows], some).min(axis=1)
            bound = np.sqrt(bound) * (1 + 1e-9) + 1e-6
            by = np.lexsort((norms[part], np.frexp(bound)[1]))  # wide annuli apart from narrow ones
            for lo in range(0, len(by), ROWS):
                near = by[lo : lo + ROWS]
                rows = at + near
                first = int(np.searchsorted(self.norms, (norms[rows] - bound[near]).min(), "left"))
                last = int(np.searchsorted(self.norms, (norms[rows] + bound[near]).max(), "right"))
                d = self._distances(x[rows], squares[rows], slice(first, last))
                least = d.min(axis=1)
                number[rows] = np.where(d == least[:, None], self.order[first:last], len(self.c)).min(axis=1)
                distance[rows] = least
        return number, distance.astype(np.int64)


def kept(vectors: DataFrame, dims: int, id_col: str, vector_col: str) -> DataFrame:
    """id, vector of the rows whose vector has `dims` components, none null or non-finite."""
    vector = F.col("vector")
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(vectors[id_col].alias("id"), vectors[vector_col].alias("vector"))
    return rows.where(F.coalesce((F.size(vector) == dims) & ~bad, F.lit(False)))


def first_centroids(rows: DataFrame, k: int, dims: int, scale: float, seed: str) -> list[list[int]]:
    """The vectors with the smallest hashes of their ids, in order of these; null ids last, ties in the order of arrays."""
    name: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    found = rows.select(name.alias("name"), "vector").orderBy(F.col("name").asc_nulls_last(), "vector").limit(k).toArrow()
    x = scaled(found["vector"].combine_chunks(), scale) if len(found) else np.empty((0, dims))
    return [[int(v) for v in row] for row in x]


def _sums(centroids: list[list[int]], scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, totals, counts = Annulus(centroids), {}, {}
        for batch in batches:
            x = scaled(batch.column(0), scale)
            number, _ = search.nearest(x)
            order = np.argsort(number, kind="stable")
            starts = np.append(True, np.diff(number[order]) != 0).nonzero()[0] if len(order) else order
            for some in np.split(order, starts[1:]) if len(order) else []:
                g = int(number[some[0]])
                total = [int(v) for v in x[some].sum(axis=0)]  # whole numbers far below 2 ** 53 or Python's integers
                totals[g] = [a + b for a, b in zip(totals[g], total, strict=True)] if g in totals else total
                counts[g] = counts.get(g, 0) + len(some)
        part = np.full(len(totals), TaskContext.get().partitionId() % PARTS, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(part), pa.array([counts[g] for g in totals], pa.int64()), pa.array([[str(v) for v in t] for t in totals.values()], pa.list_(pa.string()))], names=["cluster", "part", "n", "total"])

    return run


def _add(t: pa.Table) -> pa.Table:
    total = [sum(map(int, column)) for column in zip(*t["total"].to_pylist(), strict=True)]
    return pa.table({"cluster": t["cluster"][:1], "part": t["part"][:1], "n": pa.array([sum(t["n"].to_pylist())], pa.int64()), "total": pa.array([[str(v) for v in total]], pa.list_(pa.string()))})


def moved(rows: DataFrame, centroids: list[list[int]], scale: float) -> list[list[int]]:
    """Centroids after a round: the floor of their vectors' mean, component by component and exactly; those without vectors stay."""
    schema = "cluster int, part int, n long, total array<string>"
    sums = rows.select("vector").mapInArrow(tidy(_sums(centroids, scale)), schema)
    sums = sums.groupBy("cluster", "part").applyInArrow(_add, schema).withColumn("part", F.lit(0)).groupBy("cluster").applyInArrow(_add, schema)
    out = list(centroids)
    for r in sums.collect():  # a row a centroid
        out[r["cluster"]] = [int(v) // r["n"] for v in r["total"]]
    return out


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(
    vectors: DataFrame,
    *,
    k: int = 8,
    rounds: int = 10,
    dims: int = 64,
    scale: float = 1024.0,
    seed: str = "3",
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Cluster the vectors with `dims` components, none null or non-finite, each component x as the integer floor(scale * x).

    Centroids start as the k vectors with the smallest sha256 of `seed:id`. In each round every vector goes to the nearest centroid (squared
    Euclidean distance; ties: the smaller number), and every centroid with vectors to the floor of their mean. Then vectors are assigned once more.

    Returns per kept vector: the id, cluster, distance (squared), cluster_inertia and inertia (distance summed over its cluster, over all),
    centroid (array<string> of integers), centroid_sha256 (of these, joined by commas).

    Rows are vectors of their own even if they repeat an id or a vector; null ids are kept, and start a centroid only if too few others are there.
    Fewer than k vectors: as many centroids. Equal centroids: the smaller number has the vectors. Numbers beyond a long stop at its end; arithmetic
    is exact before that for all finite numbers. An empty table, or one without a vector that is kept, gives an empty one.

    Centroids pass through the driver and are sent to every task; k * dims is held to MOST_NUMBERS."""
    if k * dims > MOST_NUMBERS:
        raise ValueError(f"{k} centroids of {dims} numbers are more than {MOST_NUMBERS} numbers")
    id_type = vectors.schema[id_col].dataType.simpleString()
    with scope():
        rows = materialise(kept(vectors, dims, id_col, vector_col), "kept-vectors")
        centroids = first_centroids(rows, k, dims, scale, seed)
        for _ in range(rounds if centroids else 0):
            before, centroids = centroids, moved(rows, centroids, scale)
            if before == centroids:
                break  # further rounds would change nothing

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = Annulus(centroids)
            for batch in batches:
                number, distance = search.nearest(scaled(batch.column(1), scale))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array([min(LONG, int(d)) for d in distance] if distance.dtype == object else distance, pa.int64())], names=["id", "cluster", "distance"])

        assigned = finished(rows.mapInArrow(tidy(assign), f"id {id_type}, cluster int, distance long"), "assigned")
    inertia = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # a row a centroid
    every = min(LONG, sum(inertia.values()))
    of = [(i, min(LONG, inertia[i]), every, [str(v) for v in c], digest(c)) for i, c in enumerate(centroids) if i in inertia]
    of = vectors.sparkSession.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid array<string>, centroid_sha256 string")
    return assigned.join(F.broadcast(of), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")


def _rounds(rounds: int) -> str:
    """Unrolled in SQL: a<i> are the vectors with their clusters, c<i> the centroids after round i."""
    parts = []
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (
  SELECT r, min(d) AS distance, arg_min(g, struct_pack(d := d, g := g)) AS cluster FROM (
    SELECT v.r, c.g, CAST(list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{i} c
  ) GROUP BY r
)""")
        if i < rounds:
            parts.append(f"""m{i} AS (
  SELECT g, list(x ORDER BY p) AS e FROM (
    SELECT a.cluster AS g, u.p, CAST(floor(CAST(sum(v.e[u.p]) AS DOUBLE) / count(*)) AS BIGINT) AS x
    FROM a{i} a JOIN v USING (r), (SELECT unnest(range(1, 65)) AS p) u GROUP BY a.cluster, u.p
  ) GROUP BY g
), c{i + 1} AS MATERIALIZED (SELECT c.g, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i} m ON m.g = c.g)""")
    return ", ".join(parts)


SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT g, e FROM (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || CAST(vec_id AS VARCHAR)), e) - 1 AS INTEGER) AS g, e FROM v) WHERE g < 8
), {_rounds(10)}, i AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM a10 GROUP BY cluster)
SELECT v.vec_id, a.cluster, a.distance, i.cluster_inertia, (SELECT CAST(sum(distance) AS BIGINT) FROM a10) AS inertia,
  sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a10 a JOIN v USING (r) JOIN i ON i.cluster = a.cluster JOIN c10 c ON c.g = a.cluster
"""
