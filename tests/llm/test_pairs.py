"""Operators on pairs against brute force: embedding near-dedup (1), SimHash (4), exact top-k (10), components."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from juristream.llm import components, embeddings, simhash, topk

VECTORS = "vec_id long, embedding array<float>, label int, component_id string"


def union(pairs, nodes):
    root = {n: n for n in nodes}

    def up(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = sorted((up(a), up(b)))
        root[b] = a
    return {n: up(n) for n in nodes}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows, n = [], 0
    for _ in range(40):
        centre = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 6))):
            rows.append((n, (centre + 0.12 * rng.standard_normal(16)).tolist()))
            n += 1
    rows += [(n, rows[0][1]), (n + 1, rows[0][1]), (n + 2, [0.0] * 16), (n + 3, None), (n + 4, [math.nan] * 16), (n + 5, [None] * 16), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0]), (n + 8, [1e30] * 16), (n + 9, [])]
    return spark.createDataFrame([(i, v, i % 3, "clash") for i, v in rows], VECTORS)


def test_components(spark):
    pairs = [(1, 2), (2, 3), (9, 3), (4, 4), (7, 8), (8, 7)] + [(100 + i, 101 + i) for i in range(60)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(pairs, "x long, y long")).collect()}
    want = union(pairs, {n for p in pairs for n in p})
    assert {n: c for n, c in want.items() if n != 4} == {n: got.get(n, n) for n in want if n != 4}


def test_embeddings(vectors):
    rows = {r["vec_id"]: r["embedding"] for r in vectors.collect()}
    usable = {i: np.array(v, np.float64) for i, v in rows.items() if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    near = {(a, b) for a, b in itertools.combinations(usable, 2) if len(usable[a]) == len(usable[b]) and usable[a] @ usable[b] / math.sqrt((usable[a] @ usable[a]) * (usable[b] @ usable[b])) >= 0.95}
    want = union(near, rows)
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(vectors).collect()}
    assert set(got) == set(rows)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_links"] for i, r in got.items()} == {i: sum(i in p for p in near) for i in rows}
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())
    assert embeddings.near_duplicates(vectors.limit(0)).count() == 0


def test_isolated_pairs_in_dense_topics(spark):
    """24,000 vectors: a third in a topic of mutual cosine 0.85, a third in one of 0.7, the rest even; isolated pairs in all."""
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.sqrt((x * x).sum(axis=-1, keepdims=True))
    parts = [math.sqrt(c) * unit(rng.standard_normal(64)) + math.sqrt(1 - c) * unit(rng.standard_normal((8000, 64))) for c in (0.85, 0.7, 0.0)]
    x = unit(np.concatenate(parts))
    for at in (0, 8000, 16000):
        own = x[at : at + 400]
        way = rng.standard_normal(own.shape)
        way = unit(way - (way * own).sum(axis=1, keepdims=True) * own)
        x[at + 400 : at + 800] = 0.952 * own + math.sqrt(1 - 0.952**2) * way
    x = x.astype(np.float32)
    y = unit(x.astype(np.float64))
    near = []
    for at in range(0, len(y), 1000):
        p, q = np.nonzero(y[at : at + 1000] @ y.T >= 0.95)
        near += [(a + at, b) for a, b in zip(p.tolist(), q.tolist(), strict=True) if a + at < b]
    rows = spark.createDataFrame(pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    got = {r["vec_id"]: r["component_id"] for r in embeddings.near_duplicates(rows.repartition(8)).collect()}
    want = union(near, range(len(x)))
    assert len(near) >= 1200
    for low, high in ((0, 8000), (8000, 16000), (16000, 24000)):
        pairs = [(a, b) for a, b in near if low <= a < high]
        assert sum(got[a] == got[b] for a, b in pairs) >= 0.99 * len(pairs)
    assert all(want[a] == want[c] for a, c in got.items())


@pytest.mark.parametrize("base", [0.0, 0.6, 0.8])
def test_recall_of_passes(base):
    """Pairs at cosine 0.952 among 20,000 vectors of mutual cosine `base` come within the window of a pass."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.sqrt((x * x).sum(axis=-1, keepdims=True))
    n, k = 20_000, 5000
    x = unit(math.sqrt(base) * unit(rng.standard_normal(64)) + math.sqrt(1 - base) * unit(rng.standard_normal((n, 64))))
    way = rng.standard_normal((k, 64))
    x[k : 2 * k] = 0.952 * x[:k] + math.sqrt(1 - 0.952**2) * unit(way - (way * x[:k]).sum(axis=1, keepdims=True) * x[:k])
    plan = embeddings.Passes(x, n, 0.95, 0.995, 11)
    assert 1 < len(plan.passes) <= 24 and plan.window < n / 4
    met = np.zeros(k, bool)
    for p in plan.passes:
        keys = p.keys(x, rng.integers(0, 1 << embeddings.TIES, n))
        place, part = np.empty(n, np.int64), p.ranges(keys)
        place[np.argsort(keys)] = np.arange(n)
        met |= (np.abs(place[:k] - place[k : 2 * k]) <= plan.window) & (part[:k] == part[k : 2 * k])
    assert met.mean() >= 0.99


def test_links_in_rings(spark):
    """A tight group, a loose one and a chain, larger than a block: links counted by rings are those of all pairs."""
    rng = np.random.default_rng(2)
    unit = lambda x: x / np.sqrt((x * x).sum(axis=-1, keepdims=True))
    tight = unit(rng.standard_normal(16)) + 0.01 * rng.standard_normal((70, 16))
    loose = unit(rng.standard_normal(16)) + 0.05 * rng.standard_normal((90, 16))
    angles = np.linspace(0, 3, 60)
    chain = np.zeros((60, 16))
    chain[:, 0], chain[:, 1] = np.cos(angles), np.sin(angles)
    x = np.concatenate([tight, loose, chain, tight[:5]])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(rows, block=16).collect()}
    close = unit(x) @ unit(x).T >= 0.95
    assert [got[i]["n_links"] for i in range(len(x))] == (close.sum(axis=1) - 1).tolist()
    want = union([(a, b) for a, b in np.argwhere(close).tolist() if a < b], range(len(x)))
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_top_k(vectors):
    rows = {r["vec_id"]: r["embedding"] for r in vectors.collect()}
    usable = {i: [math.floor(256 * x) for x in v] for i, v in rows.items() if v and all(x is not None and math.isfinite(x) for x in v)}
    got = {}
    for r in topk.top_k(vectors, F.col("vec_id") % 10 == 0, query_rows=4, candidate_rows=16).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in (i for i in usable if i % 10 == 0):
        score = lambda v, q=q: max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(usable[q], usable[v], strict=True))))
        best = sorted(((-score(v), v) for v in usable if v != q and len(usable[v]) == len(usable[q])))[:5]
        assert sorted(got.get(q, [])) == [(n, v, -s) for n, (s, v) in enumerate(best, 1)]
    assert topk.top_k(vectors.limit(0), F.lit(True)).count() == 0


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80).collect()]
    odd = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "a b"), (1004, "A b"), (1005, "É b c d e"), (1006, "é b c d e"), (1007, real[0][1]), (1008, real[0][1] + " zusatz"), (1009, "w " * 5000), (None, "null id"), (1010, real[1][1]), (1010, real[1][1])]
    return spark.createDataFrame([(i, t, "clash") for i, t in real + odd], "doc_id long, text string, print string")


def test_fingerprints(texts):
    rows = [(r["doc_id"], r["text"]) for r in texts.collect()]
    prints = [plain_print(t) for _, t in rows]
    assert [simhash.fingerprint(t or "") for _, t in rows] == prints
    groups = union({(a, b) for a, b in itertools.combinations(set(prints), 2) if (a ^ b).bit_count() <= 4}, set(prints))
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[groups[p]] = min(i, least.get(groups[p], i))
    want = sorted(((i, f"{p:016x}", least.get(groups[p])) for (i, _), p in zip(rows, prints, strict=True)), key=repr)
    assert sorted((tuple(r) for r in simhash.near_duplicates(texts).collect()), key=repr) == want
    kept = [r["doc_id"] for r in simhash.one_of_each_group(texts).collect()]
    assert sorted(x for x in kept if x is not None) == sorted(least.values()) and kept.count(None) == 1
    assert simhash.near_duplicates(texts.limit(0)).count() == 0 == simhash.one_of_each_group(texts.limit(0)).count()


def test_all_close_prints_are_linked(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 30).tolist()
    near = [b ^ sum(1 << int(k) for k in rng.choice(62, int(rng.integers(0, 6)), replace=False)) for b in base for _ in range(4)]
    every = sorted({*base, *near})
    want = union([(a, b) for a, b in itertools.combinations(every, 2) if (a ^ b).bit_count() <= 4], every)
    for group_rows in (20_000, 2):  # the second deals every anchor out to parts
        edges = simhash.linked_prints(spark.createDataFrame([(x,) for x in every], "print long"), 4, group_rows)
        assert union([(r["a"], r["b"]) for r in edges.collect()], every) == want
