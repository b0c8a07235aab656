"""The ten-version fixture: what is in force when, in what order, and what breaks."""

import datetime

import pytest
from pyspark.sql import functions as F

from juristream.functions import text as T
from juristream.operators import acceptance, snapshots, temporal

D = datetime.date
ROWS = [
    ("dieu", "5", None, None, "V1", D(2020, 1, 1), None, 1, "Điều về ngưỡng áp dụng."),
    ("khoan", "5", "2", None, "V1", D(2020, 1, 1), None, 1, "Ngưỡng áp dụng được quy định như sau:"),
    ("diem", "5", "2", "a", "V1", D(2020, 1, 1), D(2026, 7, 1), 1, "Ngưỡng áp dụng là 200 triệu đồng."),
    ("diem", "5", "2", "a", "V2", D(2026, 7, 1), D(2027, 1, 1), 2, "Ngưỡng áp dụng là 500 triệu đồng."),
    ("diem", "5", "2", "a", "V3", D(2027, 1, 1), None, 3, "Ngưỡng áp dụng là 700 triệu đồng."),
    ("diem", "5", "2", "b", "V1", D(2020, 1, 1), None, 1, "Điểm b tiếp tục có hiệu lực và không bị sửa đổi."),
    ("khoan", "5", "3", None, "V1", D(2020, 1, 1), None, 1, "Khoản này không có Điểm."),
    ("dieu", "6", None, None, "V1", D(2020, 1, 1), None, 1, "Điều này không có Khoản."),
    ("dieu", "7", None, None, "V3", D(2027, 1, 1), None, 1, "Điều này có hiệu lực trong tương lai."),
    ("dieu", "8", None, None, "V1", D(2020, 1, 1), D(2026, 7, 1), 1, "Điều này bị bãi bỏ từ ngày 01 tháng 07 năm 2026."),
]
SCHEMA = "level string, article string, clause string, point string, source_vb_id string, effective_from date, effective_to date, version_no int, text string, n int"


@pytest.fixture(scope="module")
def provisions(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS, 1)], SCHEMA).withColumn("logical_vb_id", F.lit("FIXTURE-LAW")).withColumn("visibility", F.lit("public")).withColumn("review_status", F.lit("approved"))
    df = df.withColumn("lineage_id", T.lineage_id(F.col("logical_vb_id"), F.col("article"), F.col("clause"), F.col("point"))).withColumn("text_checksum", T.checksum(F.col("text")))
    df = df.withColumn("parent_lineage_id", T.parent_lineage(F.col("lineage_id"))).withColumn("source_checksum", F.sha2("source_vb_id", 256))
    return df.withColumn("provision_id", T.version_id(F.col("lineage_id"), F.col("effective_from"), F.col("text_checksum"))).cache()


@pytest.mark.parametrize("date,want", [("2026-06-30", [3, 6, 7, 8, 10]), ("2026-07-01", [4, 6, 7, 8]), ("2027-01-01", [5, 6, 7, 8, 9]), ("2019-12-31", [])])
def test_leaves_in_reading_order(provisions, date, want):
    assert [r["n"] for r in temporal.law_as_of(provisions, date).collect()] == want


def test_hidden_without_marks(provisions):
    hidden = provisions.withColumn("visibility", F.when(F.col("n") == 6, None).otherwise(F.col("visibility")))
    assert 6 not in [r["n"] for r in temporal.law_as_of(hidden, "2026-07-01").collect()]
    assert 6 in [r["n"] for r in temporal.law_as_of(hidden, "2026-07-01", audience="admin").collect()]
    with pytest.raises(ValueError):
        temporal.visible_to(hidden, "nobody")


def test_chain_and_integrity(provisions):
    point = "FIXTURE-LAW::D5.K2.Pa"
    assert [(r["days"], r["contiguous"]) for r in temporal.transitions(provisions).where(F.col("lineage") == point).orderBy("old_from").collect()] == [(2373, True), (184, True)]
    assert temporal.integrity(provisions).where("n_overlaps + n_gaps + n_not_rising + n_empty > 0").count() == 0
    broken = provisions.withColumn("effective_to", F.when(F.col("n") == 3, F.lit(D(2026, 8, 1))).otherwise(F.col("effective_to")))
    assert temporal.integrity(broken).where("n_overlaps > 0").count() == 1
    assert temporal.ambiguous(temporal.as_of(broken, "2026-07-15")).count() == 1
    assert temporal.complete_chains(provisions).where("complete").count() == 1


def test_contracts(provisions):
    assert temporal.contract_violations(provisions).count() == 0
    odd = provisions.withColumn("text", F.when(F.col("n") == 4, F.lit("anders")).otherwise(F.col("text")))
    assert [r["reasons"] for r in temporal.contract_violations(odd).collect()] == [["checksum"]]


def test_stale_hits_lead_to_the_version_in_force(spark, provisions):
    ids = {r["n"]: r["provision_id"] for r in provisions.collect()}
    hits = spark.createDataFrame([(ids[8], 1), (ids[3], 2), (ids[5], 3)], "provision_id string, position int")
    assert [r["n"] for r in temporal.hydrate(hits, provisions, "2026-07-01").collect()] == [8, 4]
    assert [r["n"] for r in temporal.hydrate(hits, provisions, "2026-07-01", redirect=False).collect()] == [8]


def test_compare(provisions):
    a, b = temporal.as_of(provisions, "2026-06-30"), temporal.as_of(provisions, "2027-01-01")
    assert {r["lineage"].partition("::")[2]: r["status"] for r in temporal.compare(a, b).collect()} == {"D5": "unchanged", "D5.K2": "unchanged", "D5.K2.Pa": "modified", "D5.K2.Pb": "unchanged", "D5.K3": "unchanged", "D6": "unchanged", "D7": "added", "D8": "deleted"}


def test_preflight(spark, provisions):
    stored = provisions.where("n <> 5")
    again = snapshots.preflight(provisions, stored)
    assert {r["outcome"] for r in again.collect()} == {"created", "idempotent"}
    other = provisions.withColumn("text_checksum", F.when(F.col("n") == 4, F.lit("x")).otherwise(F.col("text_checksum")))
    found = {r["outcome"]: r["reason"] for r in snapshots.preflight(other, stored).collect()}
    assert found["conflict"] == "text_changed" and "blocked" in found and "created" not in found


def test_acceptance(spark, provisions):
    ids = {r["n"]: r["provision_id"] for r in provisions.collect()}
    t = {
        "provisions": provisions,
        "contains": provisions.where("parent_lineage_id IS NOT NULL").select(F.col("parent_lineage_id").alias("parent_lineage"), F.col("lineage_id").alias("child_lineage")),
        "supersedes": spark.createDataFrame([(ids[3], ids[4], "r1", "c1"), (ids[4], ids[5], "r2", "c2")], "src string, dst string, review_key string, commit_key string"),
        "reviews": spark.createDataFrame([("r1", "c1", "TIGHTENED", "b1"), ("r2", "c2", "TIGHTENED", "b1")], "review_key string, commit_key string, change_type string, batch_id string"),
        "occurrences": spark.createDataFrame(
            [("y1", "m1", "OUTDATED_BUT_PREVIOUSLY_TRUE", ids[3], "FIXTURE-LAW::D5.K2.Pa", "mau_thuan", 0, 9, "h", "u", ids[4])], "ykien_id string, misconception_id string, verdict string, hist_id string, legal_anchor_id string, nli_label string, evidence_start int, evidence_end int, content_hash string, canonical_url string, curr_id string"
        ).join(provisions.select(F.col("provision_id").alias("hist_id"), F.col("text_checksum").alias("hist_checksum")), "hist_id").join(provisions.select(F.col("provision_id").alias("curr_id"), F.col("text_checksum").alias("curr_checksum")), "curr_id"),
        "items": spark.createDataFrame([("i", ["Brief"], "published")], "id string, labels array<string>, status string"),
        "batches": spark.createDataFrame([("b1", "committed", 2, "u", "t", "c1", "t", False)], "batch_id string, status string, revision int, reviewer_id string, reviewed_at string, commit_key string, committed_at string, auto_approved boolean"),
        "candidates": spark.createDataFrame([("k1", "b1", "accepted", False)], "candidate_id string, batch_id string, status string, auto_approved boolean"),
        "events": spark.createDataFrame([("e1", "b1", "committed", "t")], "event_id string, batch_id string, event_type string, created_at string"),
    }
    p = {"as_of": "2026-07-01", "clause": "FIXTURE-LAW::D5.K2", "lineage": "FIXTURE-LAW::D5.K3", "point_a": "FIXTURE-LAW::D5.K2.Pa", "point_b": "FIXTURE-LAW::D5.K2.Pb", "provision_id": ids[4], "fabricated": "none", "quote": "500 triệu", "claim": "c", "batch_id": "b1"}
    special = {"T04": {"lineage": "FIXTURE-LAW::D6"}, "T07": {"lineage": "FIXTURE-LAW::D7"}, "T08": {"lineage": "FIXTURE-LAW::D8"}}
    got = {k: [r.asDict() for r in q(t, p | special.get(k, {})).collect()] for k, q in acceptance.QUERIES.items()}
    assert [k for k in acceptance.EMPTY if got[k]] == []
    assert got["T01"][0]["n"] == 2 and len(got["T02"][0]["points"]) == 2 and got["T12"] == [{"n": 0}]
    assert got["T05"] == [{"a_versions": [1, 2, 3], "b_versions": [1], "b_ends": []}]
    assert got["T06"] == [{"path": [ids[3], ids[4], ids[5]], "hops": 2}]
    assert got["T07"] == got["T08"] == [{"active": []}]
    assert all(got[k] for k in ("T03", "T04", "T11", "T13", "T15", "T16", "T18", "N01", "PG07")) and got["T14"] == [{"quote_exact": True}]
    assert len(got["T16"]) == 2
