"""Versions that look alike are scored once, and each still gets its pairs."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from juristream.functions import arrow
from juristream.operators import amendment

VERSION = "provision_id long, logical_vb_id string, article string, clause string, point string, lineage_id string, level string, text string, effective_from string"


def versions(spark, first, n, point=None):
    rows = [(first + i, "d", "1", str(i % 2), point, f"d::D1.K{i % 2}", "khoan", f"phạt {i % 3} triệu đồng", "2020-01-01") for i in range(n)]
    return spark.createDataFrame(rows, VERSION)


def test_words_are_compared_once_a_kind(spark, monkeypatch):
    seen, plain = spark.sparkContext.accumulator(0), arrow.token_ratio.func

    def counted(a: pd.Series, b: pd.Series) -> pd.Series:
        seen.add(len(a))
        return plain(a, b)

    monkeypatch.setattr(amendment.arrow, "token_ratio", F.pandas_udf(counted, DoubleType()))
    old, new = versions(spark, 0, 120), versions(spark, 1000, 90)
    got = {(r["old_provision_id"], r["new_provision_id"]): r["score"] for r in amendment.score_pairs(old, new).collect()}
    assert 0 < seen.value <= 72  # six kinds on either side, in a filter and in the result
    same = lambda i, j: (i % 2 == j % 2, i % 3 == j % 3)
    scores = {}
    for i in range(120):
        for j in range(90):
            scores.setdefault(same(i, j), set()).add(got.pop((i, 1000 + j), None))
    assert not got and all(len(s) == 1 for s in scores.values())
    assert scores[True, True] == {0.65} and scores[False, False] == {None}


def test_named_versions_and_repeated_ids(spark):
    old, new = versions(spark, 0, 4).unionByName(versions(spark, 0, 1)), versions(spark, 1000, 2).withColumn("article", F.lit("2"))
    named = spark.createDataFrame([("d::D1.K0", "r", False, None, None, None)], "target_lineage_id string, reference_id string, complete_coordinates boolean, article string, clause string, point string")
    got = sorted((r["old_provision_id"], r["new_provision_id"], r["explicit"]) for r in amendment.score_pairs(old, new.withColumn("lineage_id", F.lit("d::D1.K0")), named).collect())
    # The first version is there twice, and the first two of one text have one number each.
    assert {k for k, _, _ in got} == {0, 2} and all(e == 1.0 for _, _, e in got) and [g for g in got if g[0] == 0] == [(0, 1000, 1.0)] * 2 + [(0, 1001, 1.0)] * 2
