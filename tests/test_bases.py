"""Claims and bases that meet by a key say the same as occurrences that hold both."""

import pytest
from pyspark.sql import functions as F

from juristream.operators import acceptance


@pytest.fixture(scope="module")
def tables(spark):
    provisions = spark.createDataFrame([("a1", "sa1", "a"), ("a2", "sa2", "a"), ("b1", "sb1", "b")], "provision_id string, text_checksum string, lineage_id string")
    bases = spark.createDataFrame(
        [(0, "a1", "sa1", "a2", "sa2", "a"), (0, "a1", "sa1", None, None, "a"), (1, "a1", "sa1", "b1", "sb1", "a"), (1, "b1", "sb1", "b1", "sb1", "b"), (2, "a1", "other", "a2", "sa2", "none"), (3, None, None, "a2", "sa2", None)],
        "base int, hist_id string, hist_checksum string, curr_id string, curr_checksum string, legal_anchor_id string",
    )
    outdated = "OUTDATED_BUT_PREVIOUSLY_TRUE"
    claims = spark.createDataFrame(
        [(f"y{i}", f"m{m}", i % 5, outdated if i % 3 else "SUPPORTED", "mau_thuan" if i % 4 else "khop", 0, i % 2, "h" if i % 7 else None, "u") for i in range(20) for m in range(1 + i % 2)],
        "ykien_id string, misconception_id string, base int, verdict string, nli_label string, evidence_start int, evidence_end int, content_hash string, canonical_url string",
    )
    return {"provisions": provisions, "claims": claims, "bases": bases}


@pytest.mark.parametrize("name", ["T18", "T19", "N01", "N02"])
def test_apart_and_whole(tables, name):
    whole = {"provisions": tables["provisions"], "occurrences": tables["claims"].join(tables["bases"], "base").drop("base")}
    rows = lambda t: sorted(map(repr, acceptance.QUERIES[name](t, {}).collect()))
    assert rows(tables) == rows(whole) != []


def test_bases_are_checked_before_claims_meet_them(tables):
    """Nothing is exchanged after claims and bases have met: their join is the last one."""
    for name in ("T18", "T19", "N01"):
        plan = acceptance.QUERIES[name](tables, {})._jdf.queryExecution().optimizedPlan().toString()
        assert next(line for line in plan.splitlines() if "Join " in line).count("base#") == 2, plan
