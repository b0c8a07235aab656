"""What an expression uses several times is found once."""

from pyspark.sql import functions as F

from juristream.functions import dialogue
from juristream.operators import claims, retrieval


def test_inference_finds_words_once(spark):
    rows = spark.createDataFrame([("phạt 5 triệu đồng", "phạt 7 triệu đồng")], "p string, h string")
    plan = rows.select(claims.infer(F.col("p"), F.col("h")).alias("r"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") <= 8


def test_a_passage_is_made_plain_once(spark):
    rows = spark.createDataFrame([("mức phạt nồng độ cồn", "Vi phạm nồng độ cồn bị phạt tiền")], "q string, p string")
    profiled = rows.select(dialogue.question_profile(F.col("q")).alias("f"), "p")
    plan = profiled.select(dialogue.profile_fit(F.col("f"), F.col("p")).alias("r"))
    assert plan._jdf.queryExecution().analyzed().toString().split("\n")[0].count("translate(") == 1
    assert plan.first()["r"] == 1.0


def test_questions_go_to_passages_and_passages_nowhere(spark, monkeypatch):
    side = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    passages, hits = spark.range(100).selectExpr("id AS key", "'x' AS text"), spark.range(3).selectExpr("id AS key")
    assert "rightHint=(strategy=broadcast)" in side(passages.join(retrieval._sent(hits), "key"))
    monkeypatch.setattr(retrieval, "bounded", lambda *_: False)
    assert "rightHint=(strategy=merge)" in side(passages.join(retrieval._sent(hits), "key"))
