"""Rows of frequent values: none is lost, and rare ones are not shuffled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from juristream.operators import frequent
from juristream.plans import texts


def test_packed_hashes_are_counted():
    r = np.random.default_rng(3)
    parts = [r.integers(-(1 << 31), 1 << 31, 5000).astype(np.int32) for _ in range(3)]
    often = np.array([-(1 << 31), (1 << 31) - 1, 0, -1, 1023, 1024], np.int32)
    batches = [frequent.packed(np.concatenate([p, often, often]), 5).to_pylist() for p in parts]
    fields = {s: frequent.field([(x["steps"], x["times"]) for b in batches for x in b if x["shard"] == s], 5) for s in range(frequent.SHARDS)}
    found = {s: {64 * i + k for i, w in enumerate(f.tolist()) for k in range(64) if w >> k & 1} for s, f in fields.items() if f.any()}
    want = {}
    for x in often.view(np.uint32).tolist():
        want.setdefault(x % frequent.SHARDS, set()).add(x // frequent.SHARDS % frequent.FIELD)
    assert found == want


@pytest.mark.parametrize("least", [1, 5])
def test_no_frequent_value_is_lost(spark, least):
    rows = spark.range(20_000).select(F.when(F.col("id") % 4 == 0, F.concat(F.lit("often "), F.col("id") % 700)).when(F.col("id") % 1000 != 1, F.col("id").cast("string")).alias("v"), F.col("id"))
    kept = frequent.maybe_frequent(rows, "v", least)
    assert kept.columns == ["v", "id"]
    exact = lambda df: {tuple(x) for x in df.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect()}
    assert exact(kept) == exact(rows)
    assert kept.count() == 20_000 if least == 1 else kept.count() < 5_200
    assert frequent.maybe_frequent(rows.limit(0), "v", least).count() == 0


def test_rare_ngrams_are_not_shuffled(spark, tmp_path):
    """Texts without a common run: none of their runs reaches the exchange by which runs are counted."""
    words = [[f"w{i}x{k}" for k in range(60)] for i in range(30)]
    rows = [(i, " ".join(w) + (" drei gleiche worte" if i < 6 else "")) for i, w in enumerate(words)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = texts.QUERIES["doc_ngrams"](spark, str(tmp_path))
    assert [tuple(r) for r in df.collect()] == [("drei gleiche worte", 6)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and plan.index("LeftSemi") > plan.index("HashAggregate")
