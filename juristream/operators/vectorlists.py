"""Exact vector search through lists around centres, with a filter.

Points lie in the list of their nearest centre; a list has a radius. By the triangle inequality no point of a list is nearer to a query than the
query's distance to the centre less the radius. A query first meets the lists nearest to it that surely hold enough points of its filter; the score
of the last hit there then rules out every list that lies too far. A filter is a column that both sides have: lists are counted and measured per value
of it, and only rows of one value meet.

Distances are between unit vectors, so their order is that of cosines. Rows without such a distance (numbers that aren't finite) are one list
that every query meets; queries without one meet every list. A list is compared in blocks; how often a point is copied is its list's
number of query blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from juristream.operators.lineage import cut

#: Numbers that all centres of one length of vectors have together at most, and lists (by filter) whose measures are sent to every task.
CENTRE_NUMBERS, MOST_LISTS = 1 << 20, 500_000
#: Distances that a task holds at once, and numbers of vectors that it gives out at once: a row may go to thousands of lists.
HELD, GIVEN = 1 << 20, 1 << 20
#: What distances may differ by, for rounding.
SLACK = 1e-6
ODD = -1


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to norm 1; not-a-number where a norm is nothing to reckon with."""
    with np.errstate(all="ignore"):
        norm = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        return vectors / np.where((norm > 1e-100) & (norm < 1e100), norm, np.nan)


def distances(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    # A product close to 1 loses digits under the root: SLACK is wide enough for them.
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (unit @ centres.T)))


@dataclass
class Lists:
    """Centres by length of vectors, and each list's points and radius by (length, filter)."""

    centres: dict[int, np.ndarray]
    measures: dict[tuple[int, str | None], tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    def nearest(self, dims: int, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's list, and its distance from the centre."""
        numbers, fars, rows = [np.empty(0, np.int32)], [np.empty(0)], max(1, HELD // len(self.centres[dims]))
        for at in range(0, len(vectors), rows):
            d = distances(units(vectors[at : at + rows]), self.centres[dims])
            fit = np.isfinite(d).all(axis=1)
            number = np.where(fit, np.where(np.isfinite(d), d, np.inf).argmin(axis=1), ODD)
            numbers.append(number.astype(np.int32))
            fars.append(np.where(fit, d[np.arange(len(d)), np.maximum(number, 0)], 0.0))
        return np.concatenate(numbers), np.concatenate(fars)

    def wanted(self, dims: int, same: str | None, vector: np.ndarray, limit: int, least: float | None) -> tuple[np.ndarray, np.ndarray]:
        """The lists that a query meets first, and those that it then has to meet if `least` is the score of its last hit (None: it has too few)."""
        number, count, radius = self.measures.get((dims, same), (np.empty(0, np.int32),) * 3)
        if not len(number) or dims not in self.centres:
            return number, number[:0]
        d = distances(units(vector[None]), self.centres[dims])[0]
        if not np.isfinite(d).all():
            return number, number[:0]
        odd = number == ODD
        far = np.where(odd, -np.inf, d[np.maximum(number, 0)] - radius)
        order = np.lexsort((number, np.where(odd, -np.inf, d[np.maximum(number, 0)])))
        before = np.cumsum(count[order]) - count[order]
        first = np.zeros(len(number), bool)
        first[order[before < limit]] = True
        first |= odd
        reach = math.inf if least is None else math.sqrt(max(0.0, 2.0 - 2.0 * min(1.0, least))) + SLACK
        return number[first], number[~first & (far <= reach)]


def by_dims(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    """A batch's rows by the length of their vectors, and these as rows of doubles."""
    sizes = np.diff(batch.column(column).offsets.to_numpy())
    for d in np.unique(sizes).tolist():
        part = batch.take(pa.array(np.flatnonzero(sizes == d)))
        yield d, part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(len(part), d)


def draw_centres(points: DataFrame) -> dict[int, np.ndarray]:
    """About the square root of the points of each length, by their hashes: they only steer the search. Held to CENTRE_NUMBERS numbers."""
    out = {}
    for d, n in points.groupBy("dims").agg(F.count("*").alias("n")).collect():  # a row a length
        k = max(1, min(math.isqrt(n), CENTRE_NUMBERS // d, 4096))
        some = points.where(F.col("dims") == d).select("vector").orderBy(F.xxhash64("vector", "key")).limit(k).toArrow()["vector"].combine_chunks()
        x = units(some.flatten().to_numpy(zero_copy_only=False).reshape(len(some), d))
        x = x[np.isfinite(x).all(axis=1)]
        out[d] = np.unique(x, axis=0) if len(x) else np.eye(1, d)
    return out


def search(points: DataFrame, queries: DataFrame, limit: int, compare: Callable[[DataFrame, DataFrame, list[str]], DataFrame], *, query_rows: int, point_rows: int) -> DataFrame | None:
    """query_id, key, score: enough of what compare() gives for each query (query_id, vector, dims, same) to have its `limit` best points (key, vector, dims, same).

    compare(queries, points, by) scores all pairs that agree in the columns `by`, and gives each query's `limit` best of each. None: there are more lists
    by filter than MOST_LISTS."""
    lists = Lists(draw_centres(points))
    types = {c: points.schema[c].dataType.simpleString() for c in ("key",)} | {"query_id": queries.schema["query_id"].dataType.simpleString()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part, x in by_dims(batch, 1):
                number, far = lists.nearest(d, x)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(number), pa.array(far)], names=["key", "vector", "dims", "same", "list", "far"])

    placed = cut(points.select("key", "vector", "dims", "same").mapInArrow(place, f"key {types['key']}, vector array<double>, dims int, same string, list int, far double"))
    measured = placed.groupBy("dims", "same", "list").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    rows = measured.limit(MOST_LISTS + 1).collect()
    if len(rows) > MOST_LISTS:
        return None
    found: dict[tuple, list] = {}
    for d, same, number, n, radius in rows:
        found.setdefault((d, same), []).append((number, n, radius))
    lists.measures = {k: (np.array([x[0] for x in v], np.int32), np.array([x[1] for x in v], np.int64), np.array([x[2] for x in v])) for k, v in found.items()}

    def dealt_rows(part: pa.RecordBatch, to: list[np.ndarray], rows: int) -> Iterator[pa.RecordBatch]:
        """Each row with each of its lists, at most so many at once."""
        at, number = np.repeat(np.arange(len(to)), [len(t) for t in to]), np.concatenate([*to, np.empty(0, np.int32)])
        for i in range(0, len(at), rows):
            out = part.take(pa.array(at[i : i + rows]))
            yield pa.RecordBatch.from_arrays([*out.columns[:4], pa.array(number[i : i + rows], pa.int32())], names=["query_id", "vector", "dims", "same", "list"])

    def deal(second: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, part, x in by_dims(batch, 1):
                    same, least, rows = part.column(3).to_pylist(), part.column(4).to_pylist(), max(1, GIVEN // max(1, d))
                    for i in range(0, len(part), 256):
                        to = [lists.wanted(d, s, v, limit, z)[int(second)] for s, v, z in zip(same[i : i + 256], x[i : i + 256], least[i : i + 256], strict=True)]
                        yield from dealt_rows(part.slice(i, 256), to, rows)

        return run

    group = ["dims", "same", "list"]
    small = F.broadcast(measured.select(*group, F.ceil(F.col("n") / point_rows).cast("int").alias("pbs")))
    on = lambda a, b: (F.col(f"{a}.dims") == F.col(f"{b}.dims")) & F.col(f"{a}.same").eqNullSafe(F.col(f"{b}.same")) & (F.col(f"{a}.list") == F.col(f"{b}.list"))

    def compared(asked: DataFrame, second: bool) -> DataFrame:
        dealt = asked.select("query_id", "vector", "dims", "same", "least").mapInArrow(deal(second), f"query_id {types['query_id']}, vector array<double>, dims int, same string, list int")
        dealt = cut(dealt)
        need = dealt.groupBy(*group).agg(F.ceil(F.count("*") / query_rows).cast("int").alias("qbs"))  # a row a list at most
        a, b = dealt.alias("a"), placed.select("key", "vector", *group).alias("b")
        q = a.join(F.broadcast(need).alias("n"), on("a", "n")).join(small.alias("s"), on("a", "s")).select("query_id", "a.vector", *[f"a.{c}" for c in group], F.pmod(F.xxhash64("query_id"), F.col("qbs")).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("pbs") - 1)).alias("pb"))
        p = b.join(F.broadcast(need).alias("n"), on("b", "n")).join(small.alias("s"), on("b", "s")).select("key", "b.vector", *[f"b.{c}" for c in group], F.explode(F.sequence(F.lit(0), F.col("qbs") - 1)).alias("qb"), F.pmod(F.xxhash64("key"), F.col("pbs")).cast("int").alias("pb"))
        return compare(q, p, [*group, "qb", "pb"])

    asked = queries.withColumn("least", F.lit(None).cast("double"))
    one = cut(compared(asked, False))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"))
    last = one.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == limit).select("query_id", F.col("score").alias("least"))
    two = compared(asked.drop("least").join(last, "query_id", "left"), True)
    return one.unionByName(two)

