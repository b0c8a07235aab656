"""Vector search through lists against all pairs: filters, odd vectors, what is read."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from juristream.operators import retrieval, vectorlists

SCHEMA = "key long, vector array<double>, topic string, list int"


def topics(n, dims=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dims))
    rows = []
    for i in range(n):
        t = int(rng.integers(0, 12))
        rows.append((i, (centres[t] + 0.3 * rng.standard_normal(dims)).tolist(), f"t{t % 5}" if i % 17 else None, 0))
    return rows


def plain(points, queries, limit, same):
    out = set()
    for q, v, topic, _ in queries:
        found = []
        for k, w, other, _ in points:
            if same and (topic is None or topic != other) or not v or not w or len(v) != len(w) or any(x is None for x in [*v, *w]):
                continue
            with np.errstate(all="ignore"):
                a, b = np.array(v), np.array(w)
                norm = np.sqrt(float(np.add.accumulate(a * a)[-1])) * np.sqrt(float(np.add.accumulate(b * b)[-1]))
                if norm == 0:
                    continue
                score = float(np.add.accumulate(a * b)[-1]) / norm
            found.append((-math.inf if math.isnan(score) else -score, k))
        out |= {(q, k, i + 1) for i, (_, k) in enumerate(sorted(found)[:limit])}
    return out


@pytest.mark.parametrize("same", [None, "topic"])
def test_search(spark, same):
    points = [*topics(600), (900, None, "t1", 0), (901, [], "t1", 0), (902, [0.0] * 16, "t1", 0), (903, [math.nan] * 16, "t1", 0), (904, [math.inf] + [0.0] * 15, "t2", 0), (905, [1e200] * 16, "t1", 0), (906, [1e-200] * 16, "t2", 0), (907, [1.0, 2.0], "t1", 0), (908, [None] * 16, "t1", 0)]
    points += [(1000 + i, points[5][1], points[5][2], 0) for i in range(9)]
    queries = points[::20] + points[600:]
    df, asked = spark.createDataFrame(points, SCHEMA), spark.createDataFrame(queries, SCHEMA).withColumnRenamed("key", "query_id")
    got = retrieval.vector_top_k(df, asked, key="key", vector="vector", limit=4, same=same, query_rows=7, point_rows=16)
    assert {(r["query_id"], r["key"], r["position"]) for r in got.collect()} == plain(points, queries, 4, same)
    assert retrieval.vector_top_k(df.limit(0), asked, key="key", vector="vector", limit=4, same=same).count() == 0
    assert retrieval.vector_top_k(df, asked.limit(0), key="key", vector="vector", limit=4, same=same).count() == 0


def test_too_many_values_of_a_filter(spark, monkeypatch):
    monkeypatch.setattr(vectorlists, "MOST_LISTS", 3)
    points = topics(200)
    df = spark.createDataFrame(points, SCHEMA)
    got = retrieval.vector_top_k(df, df.where("key % 10 = 0").withColumnRenamed("key", "query_id"), key="key", vector="vector", limit=3, same="topic")
    assert {(r["query_id"], r["key"], r["position"]) for r in got.collect()} == plain(points, points[::10], 3, "topic")


def test_lists_far_away_are_not_read(spark):
    """Of well parted topics a query meets only its own topic's lists; points are copied once for each block of queries."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 32))
    rows = [(i, (centres[i % 40] + 0.05 * rng.standard_normal(32)).tolist(), None, 0) for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs, copies = [], []

    def compare(q, p, by):
        copies.append(p.count())
        both = q.groupBy(*by).count().alias("a").join(p.groupBy(*by).count().alias("b"), by).agg(F.sum(F.col("a.count") * F.col("b.count"))).first()[0]
        pairs.append(both or 0)
        return retrieval._scored_in_blocks(p, q, by, 5)

    ready = df.select("key", "vector", F.size("vector").alias("dims"), F.col("topic").alias("same"))
    vectorlists.search(ready, ready.where("key % 20 = 0").withColumnRenamed("key", "query_id"), 5, compare, query_rows=4096, point_rows=8192)
    assert sum(pairs) < 2000 * 100 / 5
    assert sum(copies) <= 2 * 2000


def test_memory_of_a_batch_is_bounded():
    """Ten thousand vectors and four thousand centres: distances are held for some rows at a time, with the same outcome."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(3)
    lists, x = vectorlists.Lists({16: vectorlists.units(rng.normal(size=(4096, 16)))}), rng.normal(size=(10_000, 16))
    x[5] = np.nan
    tracemalloc.start()
    number, far = lists.nearest(16, x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100_000_000
    some = vectorlists.distances(vectorlists.units(x[:50]), lists.centres[16])
    assert number[5] == vectorlists.ODD and far[5] == 0
    assert all(number[i] == some[i].argmin() for i in range(50) if i != 5)
