"""The stored text index against BM25 by definition: segments, merges, blocks that are left out, odd rows."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from juristream.operators import retrieval, textindex
from juristream.plans import retrieval as plans

WORDS = [f"w{i}" for i in range(60)]


def documents(n, start=0, seed=1):
    rng = random.Random(seed)
    return [(start + i, " ".join(rng.choices(WORDS, weights=[1 / (k + 1) for k in range(60)], k=rng.randint(1, 60)))) for i in range(n)]


def plain(docs, queries, limit, k1=1.2, b=0.75):
    words = {k: re.findall(r"\w+", (t or "").lower()) for k, t in docs}
    n, mean = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = []
    for q, text in queries:
        score = {}
        for w in set(re.findall(r"\w+", (text or "").lower())):
            for k, ws in words.items():
                if tf := ws.count(w):
                    score[k] = score.get(k, 0.0) + math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(ws) / mean))
        best = sorted(score, key=lambda k: (-round(score[k], 9), k))[:limit]
        out += [(q, k, round(round(score[k], 9), 5), i + 1) for i, k in enumerate(best)]
    return sorted(out)


QUERIES = [("a", "w0 w1 w50"), ("b", "W7 w7 nothing"), ("c", "w59"), ("d", None), ("e", "absent"), ("f", " ".join(WORDS))]


def found(spark, path, limit=3):
    asked = spark.createDataFrame(QUERIES, "query_id string, text string")
    return sorted((r["query_id"], r["key"], round(r["score"], 5), r["position"]) for r in textindex.search(spark, path, asked, limit=limit).collect())


def test_segments_and_merges(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    assert found(spark, path) == []
    docs = [*documents(150), (1000, None), (1001, "")]
    frame = lambda rows: spark.createDataFrame([(k, t, "clash", 1) for k, t in rows], "doc_id long, text string, term string, block int")
    assert textindex.add(frame(docs), path, key="doc_id", text="text", block=16, folder=500) == 1
    assert found(spark, path) == plain(docs, QUERIES, 3)
    more = documents(60, 200, 2)
    textindex.add(frame(more), path, key="doc_id", text="text", block=16, folder=10**9)
    textindex.add(frame([(5000, None)]), path, key="doc_id", text="text")
    textindex.add(frame([]), path, key="doc_id", text="text")
    every = [*docs, *more, (5000, None)]
    assert found(spark, path) == plain(every, QUERIES, 3)
    for bad in ([(3, "again")], [(7000, "x"), (7000, "y")], [(None, "x")]):
        with pytest.raises(ValueError, match="key"):
            textindex.add(frame(bad), path, key="doc_id", text="text")
    assert textindex.segments(spark, path).count() == 4
    assert textindex.merge(spark, path) == 5
    assert [r["n"] for r in textindex.segments(spark, path).collect()] == [len(every)]
    assert found(spark, path) == plain(every, QUERIES, 3)
    assert found(spark, path, 1000) == plain(every, QUERIES, 1000)
    assert textindex.merge(spark, path) == 5
    textindex.add(frame(documents(20, 9000, 3)), path, key="doc_id", text="text", block=8)
    assert found(spark, path) == plain([*every, *documents(20, 9000, 3)], QUERIES, 3)
    one_by_one = retrieval.bm25(frame(every), spark.createDataFrame(QUERIES, "query_id string, text string"), key="doc_id", text="text", limit=3)
    assert sorted((r["query_id"], r["key"]) for r in one_by_one.collect()) == [x[:2] for x in plain(every, QUERIES, 3)]


def test_only_blocks_that_can_reach_the_top_are_read(spark, tmp_path):
    """Ten documents name a rare word often and are short; the other blocks hold it once, in long ones."""
    path = f"file://{tmp_path}/index"
    docs = [(i, "rare rare rare rare short") for i in range(10)] + [(100 + i, "rare " + " ".join(WORDS) * 3) for i in range(600)]
    textindex.add(spark.createDataFrame(docs, "doc_id long, text string"), path, key="doc_id", text="text", block=32)
    asked = spark.createDataFrame([("q", "rare")], "query_id string, text string")
    s = textindex.Search(spark, path, asked, 5)
    assert s.asked.count() > 15  # blocks with the word
    assert s.first.count() == 1 and s.second.count() == 0
    assert [r["key"] for r in s.hits(spark).orderBy("position").collect()] == [0, 1, 2, 3, 4]


def test_an_interrupted_addition_is_not_seen(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/index"
    docs = spark.createDataFrame(documents(20), "doc_id long, text string")
    textindex.add(docs, path, key="doc_id", text="text")
    before = found(spark, path)

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(textindex, "_commit", broken)
        with pytest.raises(RuntimeError):
            textindex.add(docs.withColumn("doc_id", F.col("doc_id") + 500), path, key="doc_id", text="text")
    assert found(spark, path) == before
    textindex.add(docs.withColumn("doc_id", F.col("doc_id") + 500), path, key="doc_id", text="text")
    assert found(spark, path) == plain([*documents(20), *((k + 500, t) for k, t in documents(20))], QUERIES, 3)


def test_a_block_gives_its_best_documents_and_no_pairs_besides(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    docs = documents(200)
    textindex.add(spark.createDataFrame(docs, "doc_id long, text string"), path, key="doc_id", text="text", block=32)
    asked = spark.createDataFrame([("q", "w0 w1"), ("r", "w0 w2")], "query_id string, text string")
    s = textindex.Search(spark, path, asked, 3)
    read = s.asked.select("query_id", "segment", "block").distinct()
    assert s._scores(read).count() <= 3 * read.count()
    got = [(r["query_id"], r["key"], round(r["score"], 5), r["position"]) for r in s.hits(spark).collect()]
    assert sorted(got) == plain(docs, [("q", "w0 w1"), ("r", "w0 w2")], 3)


def test_texts_stay_where_few_hits_meet_them(spark, sf_dir):
    plan = plans.token_overlap_rerank(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan
