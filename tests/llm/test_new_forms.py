"""Token files (11), centroid clustering (12) and fill-in-middle (13) against plain versions and SQL, odd rows among them."""

import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from juristream.llm import centroids, infill, queries, tokenfiles, wavelet

FILE = public_tokenizers.path("byte_bpe_50k.json")
DOCUMENTS = "doc_id long, text string, n_tokens string, start int, part double"
ALPHABET = [" ", "  ", "\n", "\t", "\r\n", "\x00", "\x1c", "\u0085", " ", " ", "　", "﻿", "a", "b", "Ab", "é", "×", "÷", "1", "23", "½", "'s", "'", "!", "..", "́", "<|endoftext|>", "中", "文", "\U0001f600", ",", "x.", "ß"]


def library():
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def odd_documents(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "<P>", "a<M", "\U0001f600é中a" * 50, "word " * 60_000, "none" * 20_000]
    texts += ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    rows = [(3 * i, t) for i, t in enumerate(texts)]
    rows += [(7, f"text {i}") for i in range(60)] + [(7, "the same")] * 60 + [(None, "nameless"), (None, None), (-5, "before")]
    return spark.createDataFrame([(i, t, "clash", 1, 2.0) for i, t in rows], DOCUMENTS).repartition(3)


def test_chunks_equal_whole_texts():
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    with open(FILE, encoding="utf-8") as f:
        e = tokenfiles.Encoder(f.read(), True)
    encode, (ids, sizes) = library(), e.encode(pa.array(texts)[50:])
    want = [encode(t) for t in texts[50:]]
    assert sizes.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def test_wavelet():
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 300_000):
        ids = (rng.zipf(1.3, n) % 50_257).astype(np.uint32)
        s = wavelet.Shard(wavelet.build(ids, pa.table({"id": [1, 2], "n": [n, 0]}), 3, 4))
        assert (s.ids() == ids).all() and (s.part, s.number, s.n, s.documents["n"].to_pylist()) == (3, 4, n, [n, 0])
        if n:
            at = rng.integers(0, n, 60)
            assert (s.access(at) == ids[at]).all()
            for token in (1, 7, 50_000, 60_000, 1 << 20, -1, int(ids[-1])):
                assert s.count(token) == (ids == token).sum() and (s.find(token) == np.flatnonzero(ids == token)).all()
                lo, hi = n // 3, n // 2
                assert s.count(token, lo, hi) == (ids[lo:hi] == token).sum() and (s.find(token, lo, hi) == lo + np.flatnonzero(ids[lo:hi] == token)).all()
    s.decompressed = 0
    s.count(7)
    assert s.decompressed <= 2 * s.planes  # of 32
    data = wavelet.build(np.arange(9, dtype=np.uint32), pa.table({"id": [1], "n": [9]}))
    for broken in (data[:-1], b"x" + data[1:], data + b"\n"):
        with pytest.raises(ValueError, match="whole"):
            wavelet.Shard(broken)


def test_token_files(spark, odd_documents, tmp_path):
    path, encode = f"file://{tmp_path}/files", library()
    shards = tokenfiles.write(odd_documents, FILE, path, by_chunks=True, shard_tokens=500)
    rows = odd_documents.select("doc_id", "text").collect()
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, tuple([*encode(r["text"] or ""), 0])) for r in rows)
    got = tokenfiles.documents(spark, path).orderBy("start").collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, tuple(r["ids"])) for r in got) == want
    assert [(r["doc_id"] is None, r["doc_id"] or 0) for r in got] == [x[:2] for x in want]
    every, at = [], 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        every += r["ids"]
        at += r["n_tokens"]
    assert shards.count() > 10 and shards.agg({"tokens": "sum"}).first()[0] == at
    some = [0, 262, every[5], 50_256]
    assert {r["token"]: r["n"] for r in tokenfiles.counts(spark, path, some).collect()} == {t: every.count(t) for t in some}
    token = encode(" word")[0]
    found = tokenfiles.occurrences(spark, path, token).collect()
    assert sorted(r["place"] for r in found) == [i for i, t in enumerate(every) if t == token]
    assert all(r["start"] <= r["place"] for r in found)
    # The same rows in another order give the same files but for rows that are alike.
    again = f"file://{tmp_path}/again"
    tokenfiles.write(odd_documents.repartition(5, "text"), FILE, again, shard_tokens=10**9)
    key = lambda r: (r["start"], r["n_tokens"], r["ids_crc32"])
    assert sorted(map(key, tokenfiles.documents(spark, again, with_ids=False).collect())) == sorted(map(key, got))


def test_token_files_of_nothing(spark, odd_documents, tmp_path):
    path = f"file://{tmp_path}/none"
    assert tokenfiles.write(odd_documents.limit(0), FILE, path).count() == 0
    assert tokenfiles.documents(spark, path).count() == 0


def plain_clusters(rows, k, rounds, dims, scale):
    vectors = [(i, [math.floor(x * scale) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(vectors, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]
    far = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w, strict=True))
    for n in range(rounds + 1):
        at = [min(range(len(c)), key=lambda g, v=v: far(v, c[g])) for _, v in vectors]
        if n < rounds:
            for g in set(at):
                own = [v for (_, v), b in zip(vectors, at, strict=True) if b == g]
                c[g] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    out = [(i, g, far(v, c[g]), centroids.digest(c[g])) for (i, v), g in zip(vectors, at, strict=True)]
    return sorted(out, key=repr), sum(x[2] for x in out)


@pytest.mark.parametrize("top", [1.0, 1e6, 1e200])
def test_clusters(spark, top):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-3, 4, 4) * 0.25 * (i % 5)).tolist()) for i in range(120)]
    rows += [(500, rows[3][1]), (3, rows[3][1]), (None, rows[7][1]), (501, None), (502, []), (503, [1.0] * 3), (504, [None] * 4), (505, [math.nan] * 4), (506, [math.inf] * 4), (507, [top, -top, 0.0, 0.1])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance string").repartition(3)
    for k in (1, 5, 40, 500):
        got = centroids.cluster(df, k=k, rounds=4, dims=4, scale=8.0).collect()
        want, inertia = plain_clusters(rows, k, 4, 4, 8.0)
        assert sorted(((r["vec_id"], r["cluster"], r["distance"], r["centroid_sha256"]) for r in got), key=repr) == sorted(((i, g, min(d, centroids.LONG), s) for i, g, d, s in want), key=repr)
        assert {r["inertia"] for r in got} == {min(centroids.LONG, inertia)}
        assert all(r["cluster_inertia"] == min(centroids.LONG, sum(x[2] for x in want if x[1] == r["cluster"])) for r in got)
    assert centroids.cluster(df.limit(0), dims=4).count() == 0
    with pytest.raises(ValueError, match="numbers"):
        centroids.cluster(df, k=1 << 20, dims=64)


def test_annulus_compares_few():
    rng = np.random.default_rng(4)
    c = (rng.standard_normal((900, 8)) * np.arange(1, 901)[:, None]).round()
    x = (c[rng.integers(0, 900, 4000)] + rng.integers(-2, 3, (4000, 8))).round()
    search = centroids.Annulus(c.astype(int).tolist())
    number, distance = search.nearest(x)
    every = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert search.compared < every.size / 2
    same = centroids.Annulus([[3, 4], [0, 5], [3, 4], [-5, 0]])  # one norm, one of them twice
    assert same.nearest(np.array([[3.0, 4.0], [0.0, 0.0], [-9.0, 0.0]]))[0].tolist() == [0, 0, 3]


def test_runs():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("ab é中\U0001f600") * rng.randint(1, 4) for _ in range(rng.randint(0, 30)))
        runs = infill.Runs(text.encode())
        assert len(runs) == len(text)
        assert [runs.byte(i) for i in range(len(text) + 1)] == [len(text[:i].encode()) for i in range(len(text) + 1)]
        wide = [len(c.encode()) for c in text]
        assert len(runs.width) == sum(a != b for a, b in zip([0, *wide], wide, strict=False))


def test_runs_across_steps(monkeypatch):
    monkeypatch.setattr(infill, "STEP", 5)
    text = "aaé中中\U0001f600\U0001f600b" * 7
    assert [infill.Runs(text.encode()).byte(i) for i in range(len(text) + 1)] == [len(text[:i].encode()) for i in range(len(text) + 1)]


def test_fill_in_middle(odd_documents):
    rows = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    want = []
    for i, text in rows:
        text = text or ""
        h = [int(hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()[j : j + 8], 16) for j in range(0, 32, 8)]
        n = len(text)
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = text[:a], text[a:b], text[b:]
        plain = not n or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90
        form = "plain" if plain else "spm" if h[3] % 100 < 20 else "psm"
        out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((i, n, form, None if plain else a, None if plain else b - a, out, sha(out), sha(text)))
    got = infill.transform(odd_documents)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert {x[2] for x in want} == {"plain", "psm", "spm"}
    assert infill.transform(odd_documents.limit(0)).count() == 0


def test_marks_are_found_where_they_were_put():
    how, rng = infill.Forms(whole=100), random.Random(3)
    for key in range(2000):
        text = "".join(rng.choice("<PSM>") for _ in range(rng.randint(1, 8))).encode()
        _, form, _, _, out = how.apply(key, text)
        assert (form == "plain") == how.marked(text) and how.restore(form, out) == text


@pytest.mark.parametrize("name", ["op12_centroid_clustering", "op13_fill_in_middle"])
def test_registered(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_registered_token_files(spark, sf_dir):
    encode, at = library(), 0
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = queries.QUERIES["op11_token_files"](spark, sf_dir).orderBy("doc_id").collect()
    assert len(got) == len(rows)
    for r, g in zip(rows, got, strict=True):
        ids = np.array([*encode(r["text"] or ""), 0], "<u4")
        assert tuple(g) == (r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
