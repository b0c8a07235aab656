"""Scopes of tables in two threads of one driver; op1 over many small batches, and where its passes don't reach the recall asked for."""

import math
import threading

import numpy as np
import pytest

from juristream.llm import common, embeddings


def test_scopes_of_threads_are_apart(spark):
    """A table that one thread writes in its scope outlives the scope of another."""
    inside, ended, left = threading.Event(), threading.Event(), []

    def other():
        with common.scope():
            common.materialise(spark.range(3), "other")
            inside.set()
            ended.wait(30)

    t = threading.Thread(target=other)
    t.start()
    inside.wait(30)
    with common.scope():
        mine = common.materialise(spark.range(5), "mine")
        with common.scope():
            kept = common.finished(spark.range(7), "kept")
            gone = common.materialise(spark.range(2), "gone")
        ended.set()
        t.join()
        left = [mine.count(), kept.count()]
    assert left == [5, 7]
    for df in (mine, kept, gone):
        with pytest.raises(Exception, match="(?i)not exist|not found|no such"):
            df.count()


def test_ranges_longer_than_a_batch(spark):
    """Windows go on across batches: a range of any length is streamed."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((700, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, x + 0.05 * rng.standard_normal(x.shape)]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(map(tuple, embeddings.near_duplicates(df).collect()))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    unit = np.array([v for _, v in rows])
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    assert sum(links for _, links, *_ in want) == int((unit @ unit.T >= 0.95).sum()) - len(unit)


@pytest.mark.parametrize("held", [0, 1, 40, 299])
def test_window_pairs_behind_a_row(held):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 3))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    a, b = embeddings.window_pairs(x, np.arange(300), 30, 0.9, held)
    close = {(p, q) for p in range(300) for q in range(max(p + 1, held), min(300, p + 31)) if x[p] @ x[q] >= 0.9}
    root = list(range(300))

    def up(n):
        while root[n] != n:
            n = root[n]
        return n

    def parts(pairs):
        root[:] = range(300)
        for p, q in pairs:
            root[max(up(p), up(q))] = min(up(p), up(q))
        return [up(n) for n in range(300)]

    assert parts(zip(a.tolist(), b.tolist(), strict=True)) == parts(close)


def test_recall_that_is_not_reached_is_an_error(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4096, 64))
    x = math.sqrt(0.8) * np.eye(1, 64) + math.sqrt(0.2) * x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    monkeypatch.setattr(embeddings, "MOST_PASSES", 3)
    with pytest.raises(ValueError, match="passes"):
        embeddings.Passes(x, 10**9, 0.95, 0.995, 11)
