"""N01 gives a claim once for each known base of it; no task holds all rows of one claim or of one base."""

from collections import Counter

from pyspark.sql import functions as F

from juristream.operators import acceptance, lineage


def test_copies_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(acceptance, "COPIES", 4)
    monkeypatch.setattr(acceptance, "dealt", lambda df, rows, *keys: lineage.dealt(df, rows, *keys, part=2))
    want = {"a": 1, "b": 3, "c": 4, "d": 5, "e": 1001, None: 2}
    rows = spark.createDataFrame(list(want.items()), "v string, n long")
    got = acceptance.repeated(rows, "v", "n", 16)
    assert got.columns == ["v"] and Counter(r["v"] for r in got.collect()) == want
    held = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) == 8 and max(held) < 300
    assert acceptance.repeated(rows.limit(0), "v", "n", 0).count() == 0


def test_rows_of_one_base_are_not_one_task(spark, monkeypatch):
    monkeypatch.setattr(acceptance, "dealt", lambda df, rows, *keys: lineage.dealt(df, rows, *keys, part=50))
    provisions = spark.createDataFrame([("l1",), ("l1",), ("l2",), (None,)], "lineage_id string")
    bases = spark.createDataFrame([(0, "l1")] * 20 + [(0, "l2"), (0, "none"), (0, None), (1, "l2"), (2, "none")], "base int, legal_anchor_id string")
    claim = lambda i, base, label="mau_thuan", end=9, sha="h": (f"y{i}", base, label, 3, end, sha, "u")
    rows = [claim(i, 0) for i in range(400)] + [claim(900, 1), claim(900, 1), claim(901, 2), claim(902, 0, "khop"), claim(903, 0, end=3), claim(904, 0, sha=None), claim(905, None)]
    claims = spark.createDataFrame(rows, "ykien_id string, base int, nli_label string, evidence_start int, evidence_end int, content_hash string, canonical_url string")
    got = acceptance.QUERIES["N01"]({"provisions": provisions, "bases": bases, "claims": claims}, {})
    assert Counter(r["ykien_id"] for r in got.collect()) == {f"y{i}": 21 for i in range(400)} | {"y900": 2}
    held = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) > 6 and max(held) < 8402 / 3
