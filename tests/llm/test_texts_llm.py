"""Operators on texts against plain versions: word pieces (2), toxicity (5), repeats (7), BPE (9)."""

import array
import hashlib
import random
import re
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from plain import plain_repeats

from juristream.llm import bpe, induced, passages, queries, toxicity, wordpiece


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 20000")


ODD = [None, "", " ", "a" * 3000, "aba" * 500, "\n \n  x\t y", "日本語テキスト　です", "🙂🙃" * 40, "  a  b   c", "x\u00a0y\u2003z", "don't DON'T 12345 1,2"]


def test_bpe(spark, documents):
    ranks = bpe.parse_ranks(bpe.load_ranks(queries.BPE_RANKS))
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = spark.createDataFrame([(10_000 + i, t, "x") for i, t in enumerate(ODD)] + [(None, "x", "y")], "doc_id long, text string, ids string")
    rows = documents.select("doc_id", "text", F.lit("clash").alias("ids")).limit(60).unionByName(odd)
    want = {}
    for r in rows.collect():
        ids = e.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), ids, hashlib.sha256(array.array("I", ids).tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest(), True)
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.encode(rows, queries.BPE_RANKS, public_tokenizers.PATTERN).collect()}
    assert got == want
    assert bpe.encode(rows.limit(0), queries.BPE_RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_any_ranks():
    """Ranks in any order, so that merges make room for earlier ones; against the rescan for the smallest rank."""
    r = random.Random(2)
    for _ in range(30):
        tokens = {bytes([c]) for c in b"abc"}
        while len(tokens) < 25:
            a, b = r.choice(sorted(tokens)), r.choice(sorted(tokens))
            tokens.add((a + b)[:6])
        order = sorted(tokens - {b"a", b"b", b"c"})
        r.shuffle(order)
        ranks = {t: i for i, t in enumerate([b"a", b"b", b"c", *order])}
        m = bpe.ByteBPE(ranks, r".+")
        pieces = [bytes(r.choice(b"abc") for _ in range(r.randrange(1, 40))) for _ in range(20)]
        for piece, got in zip(pieces, m.encode_pieces(pieces), strict=True):
            parts = [bytes([c]) for c in piece] if piece not in ranks else [piece]
            while True:
                best = min(((ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks), default=None)
                if best is None:
                    break
                i = best[1]
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            assert array.array("I", got).tolist() == [ranks[p] for p in parts]


def test_word_pieces(spark, documents):
    initial, inner = map(set, wordpiece.read_pieces(queries.PIECES))

    def plain(word):
        n, at = 0, 0
        while at < len(word):
            known = inner if at else initial
            end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
            if end is None:
                return None
            n, at = n + 1, end
        return n

    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    rows = documents.select("doc_id", "text").limit(40).unionByName(odd)
    want = {}
    for r in rows.collect():
        words = [w.decode() for w in (r["text"] or "").encode().split()]
        found = [plain(w) for w in words]
        want[r["doc_id"]] = (len(words), sum(1 if x is None else x for x in found), found.count(None))
    assert {r["doc_id"]: tuple(r)[1:] for r in wordpiece.token_counts(rows, queries.PIECES).collect()} == want


@pytest.mark.parametrize("length", [100, 400])
def test_repeats(spark, documents, length, monkeypatch):
    texts = [r["text"] for r in documents.orderBy("doc_id").limit(60).collect()]
    r = random.Random(1)
    passage = "".join(r.choice("äöü abcdef") for _ in range(700))
    texts += [None, "", "kurz", "x" * 1500, passage, "vorn " + passage[:-3], passage + passage, "é" * 450, texts[3], texts[3]]
    df = spark.createDataFrame([(i % 65, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string, row int")
    df = df.withColumn("row", F.monotonically_increasing_id())
    want = sorted((i % 65, *x) for i, x in enumerate(plain_repeats(texts, length)))
    for hot in (passages.HOT_BYTES, 0):  # with 0 every anchor takes the way of hot ones
        monkeypatch.setattr(passages, "HOT_BYTES", hot)
        found = passages.remove_repeats(df, length=length, keep=["doc_id", "n_bytes"], with_kept=True, with_text=True).collect()
        assert sorted((x["doc"]["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) for x in found) == want
        assert all(x["text"] == x["kept"].decode("utf-8", "ignore") for x in found)
    assert passages.remove_repeats(df.limit(0), length=length).count() == 0


def plain_word_repeats(texts, words):
    """The texts without the runs of words that start elsewhere too."""
    places, starts = {}, [[m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t)] for t in texts]
    for i, (t, w) in enumerate(zip(texts, starts, strict=True)):
        for a in range(len(w) - words + 1):
            places.setdefault(tuple(t[x:y] for x, y in w[a : a + words]), []).append((i, w[a][0], w[a + words - 1][1]))
    gone = [set() for _ in texts]
    for i, x, y in (p for found in places.values() if len(found) > 1 for p in found):
        gone[i].update(range(x, y))
    return ["".join(c for k, c in enumerate(t) if k not in g) for t, g in zip(texts, gone, strict=True)]


@pytest.mark.parametrize("hot", [passages.HOT_BYTES, 0])
def test_repeats_of_fifty_words(spark, hot, monkeypatch):
    """Short words: fifty-one of them take fewer than 400 bytes, and blanks between them differ."""
    monkeypatch.setattr(passages, "HOT_BYTES", hot)
    r = random.Random(5)
    some = lambda n: [r.choice("abcdefghäöü") + r.choice("abcdefgh") * r.randrange(4) + str(r.randrange(9)) for _ in range(n)]
    shared, forty_nine, line = some(51), some(49), some(50)
    texts = [" ".join(some(80) + shared + some(30)), "\n".join(shared) + " " + " ".join(some(60)), "\t ".join(some(9) + shared)]
    texts += [" ".join(some(20) + forty_nine + some(20)), " ".join(some(5) + forty_nine + some(70)), " ".join([*some(3), *line, "x", *line]), "ha " * 60, "", "kurz", " ".join(some(300))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc"]["doc_id"]: x["text"] for x in passages.remove_repeats(df, words=50, with_text=True).collect()}
    want = plain_word_repeats(texts, 50)
    assert max(len(" ".join(x).encode()) for x in (shared, line)) < 400
    assert [got[i] for i in range(len(texts))] == want
    assert [want[i] == t for i, t in enumerate(texts)] == [False] * 3 + [True] * 2 + [False] * 2 + [True] * 3
    plain = {x["doc"]["doc_id"]: x["text"] for x in passages.remove_repeats(df, with_text=True).collect()}
    assert all(plain[i] == t for i, t in enumerate(texts))


def test_suffix_arrays():
    r = np.random.default_rng(4)
    for n, letters in ((1, 2), (2, 1), (50, 1), (300, 2), (500, 4), (2000, 26), (3000, 2)):
        t = r.integers(97, 97 + letters, n).astype(np.uint8)
        raw = t.tobytes()
        sa = induced.suffix_array(t)
        assert sa.tolist() == sorted(range(n), key=lambda i, raw=raw: raw[i:])
        common = induced.permuted_prefixes(t, sa)[sa]
        for k in range(1, n):
            a, b = raw[sa[k - 1] :], raw[sa[k] :]
            assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_segments():
    """Against all maximal segments found by halving: the best segment, then left and right of it."""
    r = random.Random(7)

    def plain(scores, lo, hi):
        best = max(((sum(scores[a : b + 1]), -(b - a), -a, b) for a in range(lo, hi) for b in range(a, hi)), default=None)
        if best is None or best[0] <= 1e-12:
            return []
        a, b = -best[2], best[3]
        return [*plain(scores, lo, a), (a, b), *plain(scores, b + 1, hi)]

    for _ in range(60):
        scores = [r.choice([-0.5, -0.5, -0.5, 1.03, 0.71, -1.17]) + r.random() / 1000 for _ in range(25)]
        got = toxicity.segments(list(enumerate(scores)), -0.5)
        assert [(a, b) for a, b, _ in got] == plain(scores, 0, 25)


def test_toxicity(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    df = queries.op5_toxicity(spark, big)
    assert df.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = df.join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hit / sum(r["toxic"] for r in rows) >= 0.85 and hit / max(1, sum(r["predicted"] for r in rows)) >= 0.85
    assert df.where("score < 0 OR score > 1 OR score IS NULL OR predicted <> CAST(score >= 0.3 AS INT)").count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "wort", "c")], "doc_id long, text string, score string")
    model = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [(r["score"], r["predicted"]) for r in toxicity.score(docs, model).collect()] == [(0.0, 0)] * 3
    assert toxicity.score(docs.limit(0), model).count() == 0
