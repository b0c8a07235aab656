"""Operator 10: exact top-k inner-product search by columnar branch and bound.

Candidates lie in vertical layout (one run of memory per dimension). A query adds up its product block of dimensions
by block of dimensions; after each, a candidate stays only if what it has plus the most that the remaining dimensions
can add (the product of both remaining norms) reaches the k-th best score known. Survivors are compacted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juristream.llm.common import materialise, tidy

LIMIT = 1 << 63


def scaled(vectors: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) of rows of one length: as doubles while those are exact for sums of products, else as integers."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    y = np.floor(x * scale)
    if np.isfinite(y).all() and np.abs(y).max(initial=0) ** 2 * y.shape[1] < 2**52:
        return y
    return np.array([[int(v * scale) if v * scale == np.floor(v * scale) else int(np.floor(v * scale)) for v in row] if np.isfinite(row * scale).all() else [int(v) * int(scale) for v in row] for row in x], dtype=object)


def search(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, width: int = 16, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, candidate ids and scores of each query's k best candidates other than itself; ties to smaller ids.

    least: scores that k candidates of each query are known to reach, here or elsewhere; what falls short of them is left out."""
    if q.dtype == object or c.dtype == object:  # beyond what doubles hold exactly: plain integer products
        every = np.clip(q.astype(object) @ c.astype(object).T, -LIMIT, LIMIT - 1)
        out = [(a, c_ids[i], every[n, i]) for n, a in enumerate(q_ids) for i in sorted(np.flatnonzero(c_ids != a), key=lambda i, n=n: (-every[n, i], c_ids[i]))[:k]]
        return tuple(np.array(z, np.int64) for z in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3
    d = q.shape[1]
    starts = list(range(0, d, width))
    columns = np.ascontiguousarray(c.T)
    left_c = [np.sqrt((c[:, s + width :] ** 2).sum(axis=1)) for s in starts]
    left_q = [np.sqrt((q[:, s + width :] ** 2).sum(axis=1)) for s in starts]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, len(q), 64):
        first = q[at : at + 64, :width] @ columns[:width]
        for n in range(len(first)):
            i, partial = at + n, first[n]
            alive = np.flatnonzero(c_ids != q_ids[i])
            if len(alive) > k:
                partial = partial[alive]
                # The k candidates that look best so far give the score to beat.
                probe = alive[np.argpartition(partial + left_q[0][i] * left_c[0][alive], len(alive) - k)[len(alive) - k :]]
                beat = (c[probe] @ q[i]).min()
            else:
                partial, beat = partial[alive], -np.inf
            if least is not None:
                beat = max(beat, least[i])
            for b, s in enumerate(starts):
                if b:
                    partial = partial + q[i, s : s + width] @ columns[s : s + width, alive]
                stay = partial + left_q[b][i] * left_c[b][alive] * (1 + 1e-9) + 1e-6 >= beat
                alive, partial = alive[stay], partial[stay]
            best = np.lexsort((c_ids[alive], -partial))[:k]
            found.append((np.full(len(best), q_ids[i]), c_ids[alive[best]], partial[best].astype(np.int64)))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3


class Plan:
    """What a sample of candidates of one length says: a floor under each query's k-th score, and blocks by norm.

    Candidates lie in bands of norms. A query whose k-th score is at least `floor` has nothing to find in a band of norms
    below floor / |query| (its reach), so it isn't sent there; queries of like reach share a block, so neither are candidates.
    """

    def __init__(self, sample: np.ndarray, ids: np.ndarray, n: int, k: int, candidate_rows: int):
        self.sample, self.ids, self.k = sample, ids, k
        self.exact = sample.dtype != object
        blocks = -(-n // candidate_rows) or 1
        bands = min(32, blocks) if self.exact and len(sample) else 1
        self.subs = -(-blocks // bands)
        norms = np.sort(np.sqrt((sample * sample).sum(axis=1))) if bands > 1 else np.empty(0)
        self.ends = norms[(np.arange(1, bands) * len(norms)) // bands]
        self.tops = np.append(self.ends, np.inf)
        self.reaches = np.empty(0)  # lower ends of query blocks but the first

    def floors(self, q: np.ndarray, q_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each query a score that k candidates reach, and the norm below which no candidate reaches it."""
        none = np.full(len(q), -np.inf)
        if not self.exact or q.dtype == object or len(self.ids) <= self.k:
            return none, none
        out = none.copy()
        for at in range(0, len(q), 256):
            score = q[at : at + 256] @ self.sample.T
            score[self.ids[None, :] == q_ids[at : at + 256, None]] = -np.inf
            out[at : at + 256] = np.partition(score, -self.k, axis=1)[:, -self.k]
        norm = np.sqrt((q * q).sum(axis=1))
        return out, np.where((out > 0) & (norm > 0), out / np.maximum(norm, 1e-300) * (1 - 1e-9) - 1e-6, -np.inf)

    def query_block(self, reach: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.reaches, reach, "right").astype(np.int32)

    def of_query(self, reach: float) -> np.ndarray:
        """The candidate blocks that a query is sent to."""
        return np.arange(int(np.searchsorted(self.tops, reach)) * self.subs, len(self.tops) * self.subs, dtype=np.int32)

    def band(self, c: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, np.sqrt((c * c).sum(axis=1)), "right") if len(self.ends) and c.dtype != object else np.zeros(len(c), np.int64)

    def query_blocks(self, band: int) -> int:
        """How many of the query blocks, from the first, hold a query that a band's candidates may be for."""
        return 1 + int(np.searchsorted(self.reaches, self.tops[band], "right"))


def top_k(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 5,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_rows: int = 16_384,
    candidate_rows: int = 8192,
    sample_rows: int = 4096,
) -> DataFrame:
    """Each query row's k highest integer inner products over all other rows, exactly.

    A sample of at most about `sample_rows` candidates gives each query a floor under its k-th score, which all blocks
    start from. Candidates are dealt into blocks by norm and hash, queries by the norm that they still reach for; each pair of blocks
    that may hold a hit is a group of bounded size, whatever the data look like. A group returns at most k rows a query, and a last window
    keeps the best k.

    Returns query_id, rank (from 1), vec_id, score. Rows with a null id, or whose vector is null, empty or holds null or
    non-finite components take no part; vectors of different lengths aren't compared; rows with the query's own id are
    its own. Repeated rows are candidates each; of query rows that repeat an id the smallest vector asks, in the order of arrays.
    Scores beyond a long stop at its ends. Fewer than k candidates: all. An empty table gives an empty one.
    """
    bad = lambda v: F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    vector = vectors[vector_col]
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vector.alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce((F.size("vector") > 0) & ~bad(F.col("vector")), F.lit(False))).withColumn("dims", F.size("vector"))
    kind = rows.schema["vector"].dataType.simpleString()
    sizes = rows.groupBy("dims").agg(F.count("*").alias("n"), F.count_if("asks").alias("asking")).collect()  # a row per length
    plans: dict[int, Plan] = {}
    for d, n, _ in sizes:
        most = min(n, sample_rows, max(64, (1 << 22) // d))
        some = rows.where((F.col("dims") == d) & (F.pmod(F.xxhash64("id"), F.lit(n)) < most)).select("id", "vector").toArrow()
        x = scaled(some["vector"].combine_chunks(), scale) if len(some) else np.empty((0, d))
        plans[d] = Plan(x, some["id"].to_numpy(), n, k, candidate_rows)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part in by_length(batch):
                least, reach = plans[d].floors(scaled(part.column(1), scale), part.column(0).to_numpy())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.full(len(part), d, np.int32)), pa.array(least), pa.array(reach)], names=["id", "vector", "dims", "least", "reach"])

    asking = rows.where("asks").groupBy("id").agg(F.min("vector").alias("vector"))
    asking = materialise(asking.mapInArrow(tidy(ask), f"id long, vector {kind}, dims int, least double, reach double"), "queries")
    for d, _, n in sizes:
        blocks = -(-n // query_rows)
        if blocks > 1:
            plans[d].reaches = np.unique(asking.where(F.col("dims") == d).approxQuantile("reach", [i / blocks for i in range(1, blocks)], 0.002))

    def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part in by_length(batch):
                plan, reach = plans[d], part.column(4).to_numpy()
                to = [plan.of_query(r) for r in reach.tolist()]
                at = np.repeat(np.arange(len(part)), [len(x) for x in to])
                block = plan.query_block(reach)[at]
                yield sent(part.take(pa.array(at)), part.column(3).take(pa.array(at)), d, True, block, np.concatenate([*to, np.empty(0, np.int32)]))

    def deal_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part in by_length(batch):
                plan = plans[d]
                band = plan.band(scaled(part.column(1), scale))
                sub = (part.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % plan.subs
                times = np.array([plan.query_blocks(b) for b in range(len(plan.tops))])[band]
                at = np.repeat(np.arange(len(part)), times)
                block = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                none = pa.nulls(len(at), pa.float64())
                yield sent(part.take(pa.array(at)), none, d, False, block.astype(np.int32), (band * plan.subs + sub)[at].astype(np.int32))

    def sent(part: pa.RecordBatch, least: pa.Array, d: int, asks: bool, qb: np.ndarray, cb: np.ndarray) -> pa.RecordBatch:
        same = [pa.array(np.full(len(part), d, np.int32)), pa.array(np.full(len(part), asks))]
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), least, *same, pa.array(qb), pa.array(cb)], names=["id", "vector", "least", "dims", "asks", "qb", "cb"])

    def block(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        asks = t["asks"].to_numpy(zero_copy_only=False)
        x, ids = scaled(t["vector"].combine_chunks(), scale), t["id"].to_numpy()
        q, v, score = search(x[asks], ids[asks], x[~asks], ids[~asks], k, least=t["least"].to_numpy()[asks])
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(score, pa.int64())})

    schema = f"id long, vector {kind}, least double, dims int, asks boolean, qb int, cb int"
    dealt = asking.mapInArrow(tidy(deal_queries), schema).unionByName(rows.select("id", "vector").mapInArrow(tidy(deal_candidates), schema))
    found = dealt.groupBy("dims", "qb", "cb").applyInArrow(block, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """A batch's rows (vectors in column 1) by the length of their vectors."""
    sizes = np.diff(batch.column(1).offsets.to_numpy())
    for d in np.unique(sizes).tolist():
        yield d, batch if (sizes == d).all() else batch.take(pa.array(np.flatnonzero(sizes == d)))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
