"""Odd rows that the docstrings promise a result for: nulls, repeated ids, empty tables, clashing names, long texts, ties, broken archives."""

import gzip
import itertools
import math
import random
import sys
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from plain import plain_repeats

import corpus_pipeline
from juristream.llm import bpe, common, embeddings, mixing, passages, queries, simhash, topk, toxicity, urls, warc, wordpiece


def test_embeddings_with_repeated_and_null_ids(spark):
    a, b, c = [1.0, 0.0], [0.99, 0.05], [0.0, 1.0]
    rows = [(1, a), (1, c), (2, b), (None, a), (3, c), (3, c), (4, None), (4, a)]
    got = embeddings.near_duplicates(spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<double>, n_links int")).collect()
    # a (ids 1, 4) and b (2) are linked, the three c (1, 3, 3) too; the null id's vector isn't counted
    want = [(None, 0, None, False), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (4, 2, 1, False)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_word_pieces_of_odd_rows(spark):
    rows = spark.createDataFrame([(1, "a b", 5), (1, None, 5), (None, "a b", 5)], "doc_id long, text string, n_words int")
    got = sorted((tuple(r)[:2] for r in wordpiece.token_counts(rows, queries.PIECES).collect()), key=repr)
    assert got == [(1, 0), (1, 2), (None, 2)]
    assert wordpiece.token_counts(rows.limit(0), queries.PIECES).count() == 0


def _archive(tmp_path, name, records):
    path = tmp_path / name
    path.mkdir()
    (path / "a.warc.gz").write_bytes(gzip.compress(b"".join(r + warc.END for r in records)))
    return f"file://{path}"


def test_warc_rows_for_what_is_broken(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked" + warc.END
    field = lambda *more: [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:1>"), ("Page-ID", 1), *more]
    whole = warc.record(field(("WARC-Payload-Digest", warc.sha1(b"abc"))), http + warc.chunked(b"abc"))
    cases = {
        "good": ([whole], [("response", 3, True)]),
        "digest": ([warc.record(field(("WARC-Payload-Digest", "sha1:not base32!")), http + warc.chunked(b"abc"))], [("response", 3, False)]),
        "framing": ([warc.record(field(), http + b"5\r\nab")], [("response", None, False)]),
        "lone": ([warc.record([("WARC-Type", "continuation"), ("WARC-Record-ID", "<urn:2>"), ("WARC-Segment-Origin-ID", "<urn:0>"), ("WARC-Segment-Number", 2), ("WARC-Segment-Total-Length", 9)], b"x")], [("continuation", None, False)]),
        "gap": ([warc.record(field(("WARC-Segment-Number", 1)), http), warc.record([("WARC-Type", "continuation"), ("WARC-Record-ID", "<urn:3>"), ("WARC-Segment-Origin-ID", "<urn:1>"), ("WARC-Segment-Number", 3), ("WARC-Segment-Total-Length", 9)], b"x")], [("response", None, False)]),
        "length": ([whole.replace(b"Content-Length: ", b"Content-Size: "), whole], [("response", 3, True), ("response", None, False)]),
        "type": ([whole.replace(b"WARC-Type: response\r\n", b""), whole], [("response", 3, True), ("unknown", None, False)]),
        "cut": ([whole, whole[:-9]], [("response", 3, True), ("response", None, False)]),
        "noise": ([b"noise", whole], [("response", 3, True), ("unknown", None, False)]),
        "other": ([warc.record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:4>")], b"software"), whole], [("response", 3, True)]),
    }
    for name, (records, want) in cases.items():
        got = warc.read_archive(spark, _archive(tmp_path, name, records)).collect()
        assert sorted(((r["record_type"], r["payload_bytes"], r["verified"]) for r in got), key=repr) == sorted(want, key=repr), name


def test_warc_of_repeated_and_null_ids(spark):
    big, other = "b" * 2000, "c" * 2000
    rows = [(1, big), (1, big), (1, other), (None, big), (None, None), (0, big), (2, other)]
    path = common.shared_path(spark, "test-warc")
    warc.write_archive(spark.createDataFrame([(i, "u", t, "clash") for i, t in rows], "page_id long, url string, html string, refers_to string"), path)
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["verified"]) for r in warc.read_archive(spark, path).collect()), key=repr)
    want = [(1, "response", None, 2000, True)] * 2 + [(1, "revisit", 2, 2000, True), (None, "revisit", 1, 2000, True), (None, "response", None, 0, True), (0, "revisit", 1, 2000, True), (2, "response", None, 2000, True)]
    assert got == sorted(want, key=repr)
    text = "".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    assert f"WARC-Refers-To: {warc.page_record(2, other.encode())}" in text and "WARC-Refers-To: <urn:page:1:" not in text  # page 1 is there twice


def test_simhash_of_a_very_long_text():
    r = random.Random(3)
    words = [r.choice(("a", "b", "c", "dd", "e")) for _ in range(70_000)]  # more than 65,536 shingles
    import xxhash

    votes = np.zeros(64, np.int64)
    for i in range(len(words) - 3):
        h = xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42)
        votes += np.array([h >> b & 1 for b in range(64)])
    assert simhash.fingerprint(" ".join(words)) == sum(1 << b for b in range(64) if 2 * votes[b] > len(words) - 3)


def test_toxicity_against_a_plain_version(spark):
    """Log-odds, calibration, levels and verdicts, worked out here from their formulas."""
    r = random.Random(5)
    bad, good = ["grob", "dumm", "fies"], [f"wort{i}" for i in range(30)]
    docs, labels = [], []
    for i in range(1200):
        toxic = i % 3 == 0
        words = [r.choice(good) for _ in range(r.randrange(3, 40))]
        if toxic:
            words[1:1] = [r.choice(bad) for _ in range(4)]
        docs.append((i, " ".join(words), toxic))
        labels.append((i, 1, int(toxic)))
    df, marks = spark.createDataFrame(docs, "doc_id long, text string, score boolean"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.learn(df, marks, least_z=2.0)
    import zlib

    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    seen = {}
    for i, text, toxic in docs:
        if fold(i) != 2:
            seen.setdefault(text, [i, toxic])
    train = [(t, y) for t, (i, y) in seen.items() if fold(i) in (0, 1)]
    n_toxic, n_clean = sum(y for _, y in train), sum(not y for _, y in train)
    prior = 0.1 * (n_toxic + n_clean)
    for word in (b"grob", b"wort3", b"wort*", b"fies"):
        has = lambda t, word=word: any(word in toxicity.traits(w) for w in toxicity.words_of(t))
        a, b = sum(has(t) for t, y in train if y), sum(has(t) for t, y in train if not y)
        p = prior * (a + b) / (n_toxic + n_clean)
        odds = math.log((a + p) / (n_toxic + prior - a - p + 1)) - math.log((b + p) / (n_clean + prior - b - p + 1))
        z = odds / math.sqrt(1 / (a + p) + 1 / (b + p))
        assert (word in model.scores) == (abs(z) >= 2.0)
        if word in model.scores:
            assert model.scores[word] == pytest.approx(odds - 0.5)
    scorer = toxicity.Scorer(model)
    held = [(t, y) for t, (i, y) in seen.items() if fold(i) == 3]
    clean = [scorer.passages(t) for t, y in held if not y]
    assert model.k == pytest.approx((sum(len(p) for p, _ in clean) + 1) / (sum(n for _, n in clean) + 1))
    # the rate solves sum p exp(rate s) = 1 over the words' scores
    bins = [[0, 0] for _ in model.levels]
    for t, y in held:
        e = scorer.evidence(scorer.passages(t)[0])
        k = next((j for j, top in enumerate(toxicity.BINS) if e <= top), len(toxicity.BINS))
        bins[k][0] += y
        bins[k][1] += 1
    base = (sum(y for _, y in train) + sum(y for _, y in held)) / (len(train) + len(held))
    assert model.levels == pytest.approx(toxicity.rising([t for t, _ in bins], [n for _, n in bins], base))
    assert all(x <= y + 1e-12 for x, y in itertools.pairwise(model.levels))
    odd = df.unionByName(spark.createDataFrame([(None, "grob dumm fies grob", True), (5, "wort1 " * 60_000 + "grob dumm fies grob dumm", True), (5, None, None), (5, None, None)], df.schema))
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(docs) + 4
    for row in got:
        want = scorer.probability(scorer.evidence(scorer.passages(row["doc"]["text"] or "")[0]))
        assert (row["score"], row["predicted"]) == (pytest.approx(want), int(want >= 0.3))
        assert isinstance(row["doc"]["score"], bool | None)  # the input's own column of that name
    by_id = {x["doc"]["doc_id"]: x["predicted"] for x in got[: len(docs)]}
    assert sum(by_id[i] == t for i, _, t in docs) >= 0.95 * len(docs)
    # the long text's few bad words are one significant passage at its end
    long = next(x for x in got if x["doc"]["text"] and len(x["doc"]["text"]) > 300_000)
    assert [(p["first_word"], p["last_word"]) for p in long["passages"]] == [(60_000, 60_004)]
    assert toxicity.score(df.limit(0), model).count() == 0


def test_toxicity_keeps_words_by_order_in_ties(spark):
    docs = spark.createDataFrame([(i, f"{'x' if i % 2 else 'y'} zz") for i in range(800)], "doc_id long, text string").withColumn("text", F.concat("text", F.lit(" k"), F.col("doc_id")))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    one, two = (toxicity.learn(docs.repartition(n), labels, most_words=1).scores for n in (1, 5))
    assert one == two and len(one) == 1


def test_mixing_of_odd_ids(spark):
    rows = spark.createDataFrame([(None, f"a b {i}", "s", i) for i in range(50)] + [(1, "x " * 30_000, None, 0), (1, "y z", None, 0)], "doc_id long, text string, source string, size int")
    got = mixing.mix(rows).collect()
    assert sorted(r["size"] for r in got) == [2, *[3] * 50, 30_000]
    for source, total in (("s", 150), (None, 30_002)):
        mine = [r for r in got if r["doc"]["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 1 and mine[0]["source_size"] == total
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in mine)
    assert mixing.mix(rows.limit(0)).count() == 0


def test_repeats_over_the_seam_of_a_span(spark, monkeypatch):
    r = random.Random(7)
    monkeypatch.setattr(passages, "SPAN", 4096)
    shared = "".join(r.choice("abcdefgh ") for _ in range(900))
    texts = ["".join(r.choice("ijklmnop ") for _ in range(4096 - 450)) + shared + "q" * 5000, shared + "r" * 20_000, "".join(r.choice("stuvwxyz ") for _ in range(9000))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc"]["doc_id"]: tuple(x)[1:] for x in passages.remove_repeats(df, keep=["doc_id"], with_kept=False).collect()}
    # Spark's workers have the module's own SPAN; the function itself is tested at the seam below
    assert [got[i] for i in range(3)] == plain_repeats(texts, 400)
    raw = texts[0].encode()
    places = set()
    for q, a, b in passages.stretches(raw, 400):
        assert a <= q <= b + 400 - passages.ANCHOR
        places |= set(range(a, b + 1))
    assert places == set(range(len(raw) - 400 + 1))


def test_repeats_of_a_text_of_more_than_a_span(spark):
    r = random.Random(9)
    shared = "".join(r.choice("abcdefgh ") for _ in range(800))
    filler = lambda n: "".join(f"{r.getrandbits(64):016x}" for _ in range(n // 16 + 1))[:n]
    long = filler(passages.SPAN - 400) + shared + filler(3000)
    df = spark.createDataFrame([(1, long), (2, shared + "x")], "doc_id long, text string")
    got = {x["doc"]["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"]) for x in passages.remove_repeats(df, keep=["doc_id"]).collect()}
    assert got == {1: (len(long), 800, 1), 2: (801, 800, 1)}


def test_trees_judge_what_no_rule_decides(spark):
    """Hosts without a rule look like those that rules block (digits, parameters) or allow; the trees tell them apart."""
    r = random.Random(4)

    def url(host, bad):
        if bad:
            return f"http://{host}/de/{r.randrange(10**9)}?a={r.randrange(999)}&b={r.randrange(999)}&c=1"
        return f"https://{host}/fr/" + "/".join(r.choice(("guide", "news", "about", "team", "press")) for _ in range(3))

    rows = [(url(f"site{r.randrange(50)}.com", i % 2 == 0), i % 2 == 0) for i in range(1500)]
    free = [(url(f"site{r.randrange(50)}.net", i % 2 == 0), i % 2 == 0) for i in range(400)]
    long = "http://z.net/" + "9" * 50_000
    pages = spark.createDataFrame([(i, u, "clash") for i, (u, _) in enumerate(rows + free)] + [(None, long, "x"), (5, None, "x")], "page_id long, url string, verdict string")
    got = urls.judge(pages, (("allow", "com/fr/"), ("block", "com/de/"))).collect()
    assert len(got) == 1902
    wrong = sum(x["verdict"] != ("block" if free[x["page_id"] - 1500][1] else "allow") for x in got if x["page_id"] is not None and x["page_id"] >= 1500)
    assert wrong <= 8 and all(x["rule"] is None for x in got if x["page_id"] is not None and x["page_id"] >= 1500)
    assert urls.judge(pages.limit(0), ()).count() == 0


def test_bpe_of_a_text_in_slices(monkeypatch):
    ranks = bpe.parse_ranks(bpe.load_ranks(queries.BPE_RANKS))
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    m = bpe.ByteBPE(ranks, public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "TOGETHER", 100)
    r = random.Random(6)
    for _ in range(60):
        text = "".join(r.choice(("a", " ", "  ", "\n", "Wort", "12", "'s", "é", "日本", ".", " ", " x")) for _ in range(r.randrange(400)))
        assert m.encode(text).tolist() == e.encode_ordinary(text)
        assert "".join(m.slices(text)) == text
    assert m.encode("x" * 5000).tolist() == e.encode_ordinary("x" * 5000)


def test_top_k_with_norms_and_repeated_ids(spark):
    """Norms over three powers of ten, so whole bands are out of a query's reach; a repeated id asks with its smallest vector."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((400, 8)) * np.exp(rng.uniform(-4, 4, (400, 1)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, (-x[0]).tolist()), (400, x[3].tolist()), (401, x[3].tolist()), (None, x[5].tolist())]
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<double>, rank long")
    whole = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if i is not None]
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 10 == 0, query_rows=8, candidate_rows=16, sample_rows=64).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = {}
    for i, v in rows:
        if i is not None and i % 10 == 0:
            asked[i] = min(asked.get(i, v), v)
    assert set(got) == set(asked)
    for q, v in asked.items():
        own = [math.floor(256 * c) for c in v]
        best = sorted((-sum(a * b for a, b in zip(own, w, strict=True)), i) for i, w in whole if i != q)[:5]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, an extra column of a clashing name, and no rows at all."""
    text = " ".join(f"wort{i}" for i in range(200))
    rows = [(1, text, "de", "a", 5, 1.5), (1, text, "de", "a", 5, 1.5), (2, None, None, None, None, None), (None, text + " ende", "de", None, 7, 2.0), (None, None, None, None, None, None), (3, "", "de", "b", 0, 0.0), (4, "kurz und gut", "de", "b", 12, 0.0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double"
    for name, some in (("odd", rows), ("none", [])):
        path = f"{tmp_path}/{name}"
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, 0, 1)] if some else [], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        docs = common.table(spark, path, "documents")
        for stage, f in corpus_pipeline.STAGES[:-1]:
            docs = common.materialise(f(spark, docs, path), f"test-{stage}")
            assert docs.columns == [c.split()[0] for c in schema.split(", ")], stage
        final = corpus_pipeline.run(spark, path).collect()
        assert len(final) == docs.count() and (some or not final)
        assert all(r["round_trip"] for r in final)


def test_scopes_delete_what_was_written(spark):
    def there(df):
        path = spark._jvm.org.apache.hadoop.fs.Path(df.inputFiles()[0])
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    with common.scope():
        with common.scope():
            inner = common.materialise(spark.range(3).toDF("x"), "test-inner")
            kept = common.finished(inner, "test-kept")
        assert there(kept) and not there(inner) and kept.count() == 3
    assert not there(kept)
