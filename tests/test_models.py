"""Models as functions, posts to alerts in one go, sources' caps, contracts and writes on small tables."""

import datetime

import numpy as np
from pyspark.sql import functions as F

from juristream.functions import models
from juristream.operators import claims, contracts, graph, monitor, retrieval, snapshots, writes
from juristream.sources import files
from juristream.streaming import events as stream


def test_models_plug_in(spark):
    rows = spark.createDataFrame([("phạt 5 triệu đồng", "phạt 5 triệu đồng"), ("a", None)], "p string, h string")
    own = rows.select(models.inference(F.col("p"), F.col("h")).alias("r")).collect()
    assert [(r["r"]["label"], r["r"]["model"]) for r in own] == [("khop", "heuristic"), ("khong_ro", "heuristic")]
    got = rows.select(models.inference(F.col("p"), F.col("h"), lambda pairs: [("mau_thuan", 0.6 if b else 0.9) if b else ("odd", 0.9) for a, b in pairs], "m1").alias("r")).collect()
    assert [tuple(r["r"]) for r in got] == [("mau_thuan", 0.6, "m1", True), ("khong_ro", 0.9, "m1", True)]
    v = [np.array(r["v"]) for r in rows.select(models.embedded(F.col("h")).alias("v")).collect()]
    assert len(v[0]) == 64 and abs(np.linalg.norm(v[0]) - 1) < 1e-6 and not v[1].any()
    seen = spark.range(70).select(models.embedded(F.col("id").cast("string"), lambda texts: [[float(len(texts))] for _ in texts]).alias("v")).collect()
    assert max(r["v"][0] for r in seen) <= 32
    clauses = spark.createDataFrame([(1, "Nghiêm cấm bán. Doanh nghiệp phải khai.\nPhạt 5 triệu."), (2, None)], "khoan_id long, text string")
    assert [tuple(r) for r in models.entities(clauses).collect()] == [(1, "hanh_vi_cam", "Nghiêm cấm bán."), (1, "nghia_vu", "Doanh nghiệp phải khai."), (1, "che_tai", "Phạt 5 triệu.")]


def test_posts_to_alerts(spark):
    law = spark.createDataFrame([("p1", "D::D1.K1", "mức phạt vi phạm nồng độ cồn là 5 triệu đồng", datetime.date(2024, 1, 1))], "provision_id string, lineage_id string, text string, effective_from date")
    text = "mức phạt vi phạm nồng độ cồn là 50 triệu đồng, không đúng mức phạt là 5 triệu đồng"
    posts = [("facebook", str(i), text if i < 3 else "không liên quan", "2024-02-01", 5, 0, 0) for i in range(5)] + [("news", "9", "nồng độ cồn", None, 0, 0, 0)]
    df = spark.createDataFrame(posts, "platform string, external_id string, text string, published string, likes long, comments long, shares long").withColumn("published", F.to_timestamp("published"))
    out = monitor.review_posts(df, law, {"cồn": ("nồng độ cồn",)}, current_date="2024-03-01", threshold=1)
    assert sorted(r["label"] for r in out["checked"].collect())[-3:] == ["mau_thuan"] * 3
    assert out["clusters"].select("misconception_id").distinct().count() == 1
    alert = out["alerts"].collect()
    assert len(alert) == 1 and alert[0]["topic"] == "cồn" and alert[0]["volume"] == 1  # copies of one text are one source


def test_signals_and_slugs(spark):
    rows = spark.createDataFrame([("y", "b", "c", "span", "u", "k", "a span", "0" * 64), ("z", " ", "c", "x", "u", "k", "a span", "q")], "ykien_id string, bai_dang_id string, claim_text string, evidence_span string, post_url string, khoan_id string, post_content string, content_hash string")
    assert [tuple(r) for r in monitor.provenance_gaps(rows).collect()] == [("z", ["bai_dang_id", "content_hash", "evidence_not_in_post"])]
    one = spark.range(1).select(monitor.topic_slug(F.lit("  Thuế   TNCN ")).alias("s"), monitor.score_counts(F.lit(0.2), F.lit(True)).alias("a"), monitor.score_counts(F.lit(0.2), F.lit(None).cast("boolean")).alias("b")).first()
    assert tuple(one) == ("thuế tncn", True, False)
    f = spark.createDataFrame([(1, 1, []), (1, 2, ["a"]), (1, 3, ["b"]), (2, 1, [])], "k int, n int, f array<string>")
    assert {r["k"]: r["f"] for r in monitor.first_factors(f, "k", "n", "f").collect()} == {1: ["a"], 2: None}
    law = spark.createDataFrame([("p", "phạt 5 triệu đồng")], "provision_id string, text string")
    asked = spark.createDataFrame([("c", "phạt 5 triệu đồng")], "claim_id string, text string")
    assert monitor.candidate_checks(asked, spark.createDataFrame([("c", "p")], "claim_id string, provision_id string"), law).first()["label"] == "khop"


def test_sources_have_caps(spark):
    rows = spark.createDataFrame([("a", i, f"thuế {i}", f"2024-01-0{i + 1}") for i in range(4)] + [("b", 9, "khác", None)], "channel string, id int, text string, published string").withColumn("published", F.to_timestamp("published"))
    assert files.capped(rows, ["channel"], 2, [F.desc("published")]).count() == 3
    assert files.since(rows, "2024-01-04 12:00:00", 24).count() == 2
    assert {r["topic"] for r in files.on_topic(rows, {"thuế": ("thuế",)}).collect()} == {"thuế"} and files.on_topic(rows, {"thuế": ("thuế",)}, "chung").count() == 5
    assert files.expanded_queries(spark.createDataFrame([("thuế",)], "topic string")).count() == 6
    links = spark.createDataFrame([("u", "T"), ("w", "S")], "url string, title string")
    assert {r["url"]: r["text"] for r in files.with_bodies(links, spark.createDataFrame([("u", "<p>x</p>")], "url string, html string")).collect()} == {"u": "x", "w": "S"}


def test_contracts_of_small_tables(spark):
    answers = spark.createDataFrame([(1, "refused", "why", None), (2, "answered", None, None), (3, "refused", None, "why")], "answer_id int, status string, answer string, reason_code string").withColumn("as_of", F.lit("2024-01-01").cast("date"))
    none = spark.createDataFrame([], "answer_id int, claim_id string, support_status string, citation_ids array<string>")
    cites = spark.createDataFrame([], "answer_id int, citation_id string, node_id string, lineage_id string, article string, clause string, point string, effective_from date, effective_to date, text_checksum string, source_checksum string, supports_claim_ids array<string>")
    assert {r["answer_id"]: r["reasons"] for r in contracts.citation_violations(answers, none, cites).collect()} == {1: ["refusal_with_content"], 2: ["answer_without_content"]}
    urls = ["http://a.org/x", "https://a.org:443", "http://127.0.0.1/", "http://[::1]/", "http://a.org.:8080/", "HTTP://LOCALHOST", "http://x.internal", "javascript:1", "", None, "http://172.16.0.1", "http://172.32.0.1"]
    got = [r["ok"] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select("i", contracts.public_url(F.col("u")).alias("ok")).orderBy("i").collect()]
    assert got == [True, True, False, False, False, False, False, False, False, False, False, True]
    rows = contracts.context_rows(spark.createDataFrame([(1, "head\n[a] x\ny\n[b] z"), (2, None)], "id int, text string")).collect()
    assert [tuple(r) for r in rows] == [(1, 0, "a", "x y"), (1, 1, "b", "z")]


def test_writes_of_small_tables(spark):
    posts = spark.createDataFrame([(2, "Thuế ", None), (1, " thuế", "x"), (3, None, " "), (4, None, "Y")], "post_id int, topic string, source_topic string")
    topics, edges = writes.topics_of_posts(posts)
    assert {r["slug"]: r["name"] for r in topics.collect()} == {"thuế": "thuế", "y": "Y"} and edges.count() == 3
    nodes, done = writes.entity_rows(spark.createDataFrame([(1, {"nghia_vu": ["a", "a", " "], "x": ["b"]}), (2, None)], "khoan_id int, entities map<string,array<string>>"))
    assert [tuple(r) for r in nodes.collect()] == [(1, "nghia_vu", "a", "CO_NGHIA_VU")] and done.count() == 2
    entries = writes.audit_entries(spark.createDataFrame([("u", "publish", "1", "{}")] * 2, "actor string, action string, resource_id string, detail string"), "2024-01-01")
    log = snapshots.insert_new(entries, entries, ["audit_id"])
    assert entries.count() == 1 == log.count()


def test_containment_and_context(spark):
    docs = spark.createDataFrame([("d", "Luật"), ("e", None)], "doc string, title string")
    rows = spark.createDataFrame([("d", "1", "1"), ("d", "1", "10"), ("d", "1", "9"), ("d", "2", None)], "doc string, article string, clause string")
    tree = {r["doc"]: r for r in graph.containment(docs, rows, 2).collect()}
    assert [n["id"] for n in tree["d"]["nodes"]] == ["d", "d::D1", "d::D1.K1", "d::D1.K9"] and len(tree["d"]["edges"]) == 3
    assert [n["label"] for n in tree["e"]["nodes"]] == ["e"] and tree["e"]["edges"] == []
    asked = spark.createDataFrame([(1, "nồng độ cồn"), (2, "xin chào"), (3, "Nghị định 1/2020/NĐ-CP")], "query_id int, text string")
    hits = spark.createDataFrame([(q, "d", f"k{i}", t, 0.1 * i) for q in (1, 2, 3) for i, t in enumerate(("nồng độ cồn", "khác"))], "query_id int, document string, key string, text string, score double")
    kept = sorted((r["query_id"], r["key"]) for r in retrieval.relevant(hits, asked).collect())
    assert kept == [(1, "k0"), (3, "k0"), (3, "k1")] or kept == [(1, "k0"), (2, "k0"), (2, "k1"), (3, "k0"), (3, "k1")]
    got = sorted((r["query_id"], r["key"]) for r in retrieval.select_context(hits.withColumn("position", F.lit(1)), asked).collect())
    assert got == [(1, "k0"), (3, "k0"), (3, "k1")]


def test_clusters_on_a_stream(spark, tmp_path):
    base = "phạt vi phạm nồng độ cồn theo quy định hiện hành của nghị định"
    texts = [base, base + " mới", "hoàn thuế giá trị gia tăng cho doanh nghiệp", base, "hoàn thuế giá trị gia tăng cho các doanh nghiệp"]
    rows = spark.createDataFrame([(str(i), "t", "k", "", t, datetime.datetime(2024, 1, 1, i)) for i, t in enumerate(texts)], "ykien_id string, topic string, anchor string, signature string, normalized string, ts timestamp")
    for i in range(3):
        rows.where(f"CAST(ykien_id AS INT) DIV 2 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    flow = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.cluster_stream(flow).writeStream.format("memory").queryName("clusters").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    got = {r["ykien_id"]: r["founder"] for r in spark.table("clusters").collect()}
    founders = claims.Founders()
    assert got == {str(i): founders.place(t)[0] for i, t in enumerate(texts)} and len(set(got.values())) == 2
