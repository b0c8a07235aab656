import datetime
import hashlib

import numpy as np
from pyspark.sql import functions as F

from juristream.functions import text as T
from juristream.operators import amendment, claims, evaluation, graph, retrieval, snapshots

H = lambda x: hashlib.sha256(x.encode()).hexdigest()


def infer(spark, premise, hypothesis):
    r = spark.range(1).select(claims.infer(F.lit(premise), F.lit(hypothesis)).alias("r")).first()["r"]
    return r["label"], round(r["score"], 3)


def test_inference(spark):
    assert infer(spark, "mức phạt theo quy định", "phạt 50 triệu") == ("mau_thuan", 0.92)
    assert infer(spark, "người lái xe phải đội mũ", "người lái xe phải đội mũ") == ("khop", 0.95)
    assert infer(spark, "người lái xe phải đội mũ", "không phải người lái xe phải đội mũ")[0] == "mau_thuan"
    assert infer(spark, "xa yb zc", "chưa đủ căn cứ kết luận") == ("khong_ro", 0.85)
    assert infer(spark, "", "abc def") == ("khong_ro", 0.0)


def test_clusters(spark):
    t = lambda n: datetime.datetime(2024, 1, n)
    rows = [("a", "phạt tới 5 triệu khi vượt đèn đỏ ở nội thành", 1), ("b", "Phạt tới 5 triệu khi vượt đèn đỏ ở nội thành!", 2), ("c", "phạt tới 9 triệu khi vượt đèn đỏ ở nội thành", 3), ("d", "không phạt tới 5 triệu khi vượt đèn đỏ ở nội thành", 4)]
    df = spark.createDataFrame([(i, "giao thông", "k", c, t(n), "mau_thuan", 0.9) for i, c, n in rows] + [("e", "giao thông", "k", "x", t(5), "mau_thuan", 0.5)], "ykien_id string, topic string, legal_anchor_id string, claim_text string, created_at timestamp, nli_label string, nli_score double")
    got = {r["ykien_id"]: r for r in claims.cluster_claims(df).collect()}
    assert set(got) == set("abcd") and got["a"]["misconception_id"] == got["b"]["misconception_id"]
    assert len({r["misconception_id"] for r in got.values()}) == 3 and [k for k in "abcd" if got[k]["created"]] == ["a", "c", "d"]


def test_verdicts(spark):
    schema = "lineage_id string, provision_id string, label string, score double, needs_review boolean"
    case = lambda h, c: spark.createDataFrame([(h, c)], f"h struct<{schema.replace(' ', ':').replace(',:', ', ')}>, c struct<{schema.replace(' ', ':').replace(',:', ', ')}>").select(claims.verdict(F.col("h"), F.col("c")).alias("v")).first()["v"]
    assert case(("l", "p1", "khop", 0.9, False), ("l", "p2", "mau_thuan", 0.9, False)) == "OUTDATED_BUT_PREVIOUSLY_TRUE"
    assert case(("l", "p1", "khop", 0.9, False), ("l", "p1", "mau_thuan", 0.9, False)) == "NEEDS_REVIEW"
    assert case(("l", "p1", "mau_thuan", 0.9, False), ("l", "p2", "mau_thuan", 0.9, False)) == "CONTRADICTED"
    assert case(("l", "p1", "khop", 0.6, False), ("l", "p2", "khop", 0.9, False)) == "NEEDS_REVIEW"


def test_risk_counts_copies_once(spark):
    t = datetime.datetime(2024, 1, 1)
    row = lambda i: ("m", f"y{i}", f"c{i}", H("x"), "news", t, 0.0, True, "phạt 5 triệu", "mau_thuan", 0.8, datetime.date(2024, 1, 1))
    df = spark.createDataFrame([row(i) for i in range(3)], "misconception_id string, ykien_id string, content_id string, content_hash string, source_type string, published_at timestamp, engagement_score double, provenance_complete boolean, legal_text string, label string, score double, effective_from date")
    r = claims.risk_scores(df, "2024-02-01").first()
    assert (r["diversity"], r["velocity"], r["legal_impact"], r["source_reach"]) == (0.333333, 0.083333, 0.7, 0.7)
    assert abs(r["risk_score"] - (0.175 + 0.14 + 0.12 + 0.0125 + 0.033333 + 0.1)) < 1e-5 and r["severity"] == "medium"


def test_alerts(spark):
    row = lambda i, text="x", label="mau_thuan", score=0.9, h=None: ("t", "k", "m", f"y{i}", f"p{i}", text, "span", "a span b", "u", label, score, False, h or H(str(i)), 0.9)
    schema = "topic string, khoan_id string, misconception_id string, ykien_id string, bai_dang_id string, claim_text string, evidence_span string, post_content string, post_url string, label string, score double, needs_review boolean, content_hash string, risk_score double"
    rows = [row(0), row(1), row(2), row(3, h=H("0")), row(4, label="khop"), row(5, score=0.2), row(6, h="bad")]
    df = spark.createDataFrame(rows, schema)
    got = claims.alerts(df, threshold=3).collect()
    assert [(r["volume"], r["severity"], r["dedupe_key"]) for r in got] == [(3, "critical", "misconception:m")]
    assert claims.alerts(df, threshold=4).count() == 0
    assert claims.alerts(df, threshold=3, recent=spark.createDataFrame([("misconception:m",)], "dedupe_key string")).count() == 0
    assert claims.alerts(df.limit(0), threshold=1).count() == 0


CHANGES = [("phạt 5 triệu", "phạt 10 triệu", "TIGHTENED"), ("phạt 10 triệu", "phạt 5 triệu", "LOOSENED"), ("một hai ba bốn năm sáu bảy tám chín mười", "một hai ba bốn năm sáu bảy tám chín mười thêm", "REWORDED"), ("ngưỡng 200 triệu", "ngưỡng 500 triệu", "UNCERTAIN"), ("", "x", "ADDED"), ("x", None, "REMOVED"), ("a  b", "a b", "UNCHANGED")]


def test_changes(spark):
    from juristream.functions import arrow

    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(CHANGES)], "i int, a string, b string")
    got = df.select("i", amendment.change_type(F.col("a"), F.col("b"), arrow.token_ratio("a", "b")).alias("c")).orderBy("i").collect()
    assert [r["c"]["type"] for r in got] == [c for *_, c in CHANGES]


def versions(spark, rows):
    df = spark.createDataFrame(rows, "article string, clause string, text string, effective_from date")
    df = df.withColumn("logical_vb_id", F.lit("L")).withColumn("point", F.lit(None).cast("string")).withColumn("level", F.lit("khoan"))
    df = df.withColumn("lineage_id", T.lineage_id(F.col("logical_vb_id"), F.col("article"), F.col("clause"), F.col("point"))).withColumn("text_checksum", T.checksum(F.col("text")))
    return df.withColumn("provision_id", T.version_id(F.col("lineage_id"), F.col("effective_from"), F.col("text_checksum"))).withColumn("effective_to", F.lit(None).cast("date"))


def test_amendment_matching_and_commit(spark):
    d1, d2 = datetime.date(2020, 1, 1), datetime.date(2024, 1, 1)
    old = versions(spark, [("1", "1", "phạt 5 triệu đồng", d1), ("1", "2", "người nộp thuế phải khai", d1), ("2", "1", "bỏ", d1)])
    new = versions(spark, [("1", "1", "phạt 9 triệu đồng", d2), ("1", "2", "người nộp thuế phải khai đủ", d2)])
    pairs = amendment.match(old, new)
    got = {r["old_provision_id"].split("@")[0]: r for r in pairs.collect()}
    assert {k: v["new_provision_id"].split("@")[0] for k, v in got.items()} == {"L::D1.K1": "L::D1.K1", "L::D1.K2": "L::D1.K2"}
    assert got["L::D1.K1"]["change_type"] == "TIGHTENED"
    assert [r["change_type"] for r in amendment.unmatched(old, new, pairs).collect()] == ["REMOVED"]
    ids = {r["lineage_id"] + str(r["effective_from"]): (r["provision_id"], r["text_checksum"]) for r in old.unionByName(new).collect()}
    (a, sa), (b, sb) = ids["L::D1.K12020-01-01"], ids["L::D1.K12024-01-01"]
    ops = spark.createDataFrame([("o", "PAIRED", a, sa, b, sb, "accepted")], "operation_id string, kind string, old_id string, old_checksum string, new_id string, new_checksum string, review_status string")
    none = spark.createDataFrame([], "src string, dst string")
    every = old.unionByName(new)
    after, edges = amendment.commit(ops, every, none)
    assert [(r["src"], r["dst"]) for r in edges.collect()] == [(a, b)]
    assert after.where(F.col("provision_id") == a).first()["effective_to"] == d2
    bad = ops.withColumn("old_checksum", F.lit("no")).withColumn("review_status", F.lit("draft"))
    assert amendment.commit_conflicts(bad, every, none).first()["reasons"] == ["not_accepted", "old_not_exactly_one"]


def test_instructions(spark):
    text = 'Sửa đổi, bổ sung điểm a khoản 2 Điều 5 như sau: thay thế cụm từ "cũ" bằng "mới"; bãi bỏ khoản 3 Điều 6.'
    rows = amendment.parse_instructions(spark.createDataFrame([("d", text, "L"), ("e", None, None)], "doc string, text string, target string")).collect()
    assert [(r["action"], r["target_lineage_id"]) for r in rows] == [("AMEND", "L::D5.K2.Pa"), ("REPLACE", None), ("REPEAL", "L::D6.K3")]
    assert (rows[1]["old_phrase"], rows[1]["new_phrase"]) == ("cũ", "mới")


def test_paths_of_any_length(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 100) for i in range(100)], "src int, dst int")
    assert {r["node"] for r in graph.on_cycles(ring).collect()} == set(range(100))
    path = ring.where("dst <> 0")
    assert {tuple(r) for r in graph.reachable(path).collect()} == {(a, b) for a in range(100) for b in range(a + 1, 100)}
    assert graph.would_close_cycle(path, spark.createDataFrame([(99, 0), (0, 99)], "src int, dst int")).collect() == [(99, 0)]
    assert graph.reachable(ring.limit(0)).count() == 0


def test_vectors_for_many_queries(spark):
    rng = np.random.default_rng(4)
    rows = [(f"p{i}", rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)] + [("zero", [0.0] * 4), ("none", None), ("hole", [1.0, None, 1.0, 1.0]), ("short", [1.0, 2.0])]
    points = spark.createDataFrame(rows, "id string, v array<double>")
    asked = spark.createDataFrame([(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(10_050)], "query_id long, vector array<double>")
    top = lambda q: {(r["query_id"], r["position"]): (r["key"], r["score"]) for r in retrieval.vector_top_k(points, q, key="id", vector="v", limit=5, query_rows=3000, point_rows=20).collect()}
    got = top(asked)
    assert got == top(asked.where("query_id < 5000")) | top(asked.where("query_id >= 5000"))
    assert len(got) > 50_000


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x")], "src string, dst string")
    assert {r["node"]: r["distance"] for r in graph.within_hops(e, spark.createDataFrame([("a",)], "node string"), 2).collect()} == {"a": 0, "b": 1, "c": 2}
    assert [(r["path"], r["hops"]) for r in graph.chains(e).collect()] == [(["a", "b", "c", "d"], 3)]
    assert {r["node"] for r in graph.on_cycles(e).collect()} == {"x", "y"}
    assert graph.would_close_cycle(e, spark.createDataFrame([("d", "a"), ("a", "d")], "src string, dst string")).collect() == [("d", "a")]
    nodes, kept = graph.neighbourhood(e, spark.createDataFrame([("a",)], "node string"), hops=1)
    assert {r["node"]: r["centrality"] for r in nodes.collect()} == {"a": 1.0, "b": 1.0} and kept.count() == 1


def test_fusion(spark):
    schema = "query_id int, provision_id string, lineage_id string, position int"
    lex = spark.createDataFrame([(1, "p1", "l1", 1), (1, "p1b", "l1", 2), (1, "p2", "l2", 3)], schema)
    vec = spark.createDataFrame([(1, "p2", "l2", 1)], schema)
    rows = retrieval.fuse({"lexical": lex, "vector": vec}).orderBy("position").collect()
    assert [(r["lineage_id"], r["provision_id"]) for r in rows] == [("l2", "p2"), ("l1", "p1")]
    assert abs(rows[0]["raw"] - (1 / 63 + 1 / 61)) < 1e-9 and abs(rows[0]["score"] - (1 / 63 + 1 / 61) / (2 / 61)) < 1e-8


def test_evaluation(spark):
    rel = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "z")], "case_id string, id string")
    found = spark.createDataFrame([("q", "x", 1), ("q", "a", 2), ("q", "b", 9)], "case_id string, id string, position int")
    assert {r["case_id"]: (r["recall"], r["rr"]) for r in evaluation.ranking(rel, found, 5).collect()} == {"q": (0.5, 0.5), "r": (0.0, 0.0)}
    rows = spark.createDataFrame([(True, float(i), 50.0) for i in range(1, 121)] + [(False, None, 200.0)], "success boolean, latency_ms double, baseline_latency_ms double")
    r = evaluation.latency(rows).first()
    assert (r["p95"], r["p50"], r["baseline_p95"]) == (114.0, 60.0, 50.0)
    rules = spark.createDataFrame([("m", "min", 0.9, "blocking"), ("k", "max", 1.0, "advisory")], "metric string, operator string, value double, severity string")
    got = evaluation.gates(spark.createDataFrame([("m", 0.95)], "metric string, value double"), rules)
    assert {r["metric"]: r["passed"] for r in got.collect()} == {"m": True, "k": False}
    suites = spark.createDataFrame([("s", 100, 100)], "suite string, n_cases int, least_cases int")
    assert evaluation.release(got, suites).first()["released"]
    p = spark.createDataFrame([("1", "c"), ("2", "c")], "id string, checksum string")
    q = spark.createDataFrame([("1", "d"), ("3", "c"), ("3", "c")], "id string, checksum string")
    assert {r["id"]: r["state"] for r in evaluation.parity(p, q).collect()} == {"1": "differs", "2": "left_only", "3": "repeated"}


def test_snapshots(spark, tmp_path):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "id int, revision int, status string")
    after, lost = snapshots.compare_and_set(old, spark.createDataFrame([(1, 1, "x"), (2, 9, "y")], "id int, revision int, status string"), "id")
    assert {r["id"]: (r["revision"], r["status"]) for r in after.collect()} == {1: (2, "x"), 2: (1, "b")} and [r["id"] for r in lost.collect()] == [2]
    keys = spark.createDataFrame([("d::D1",), ("d",), ("d2::D1",)], "k string")
    assert [r["k"] for r in snapshots.delete_cascade(keys, spark.createDataFrame([("d",)], "root string"), "k").collect()] == ["d2::D1"]
    steps = spark.createDataFrame([(1, 1, "draft"), (1, 2, "approved"), (2, 1, "draft"), (2, 2, "in_review")], "id int, position int, status string")
    assert [(r["id"], r["position"]) for r in snapshots.illegal_steps(steps).collect()] == [(1, 2)]
    root = "file://" + str(tmp_path / "t")
    for version in ("v1", "v2"):
        snapshots.publish(old.withColumn("v", F.lit(version)), root, version)
    assert {r["v"] for r in snapshots.current(spark, root).collect()} == {"v2"}
