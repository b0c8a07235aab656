"""Versions that no base names don't travel to meet the bases, and bases are made without a join."""

import pytest
from pyspark.sql import functions as F

from juristream.operators import acceptance, frequent
from juristream.plans import acceptance as plans


def test_no_wanted_value_is_lost(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 7 > 0, F.concat(F.lit("v"), F.col("id") % 9000)).alias("v"), "id")
    for wanted, least, most in ((range(0, 9000, 90), 180, 260), ((), 0, 0), (None, 2858, 2900)):
        its = spark.createDataFrame([(f"v{i}",) for i in wanted] if wanted is not None else [(None,)], "w string")
        kept = frequent.maybe_among(rows, "v", its, "w")
        assert kept.columns == ["v", "id"] and least <= kept.count() <= most
        exact = rows.join(its, F.col("v").eqNullSafe(F.col("w")), "left_semi")
        assert exact.exceptAll(kept).isEmpty() and kept.count() >= exact.count()


@pytest.mark.parametrize("name", ["T18", "T19"])
def test_versions_that_no_base_names_are_not_exchanged(spark, name):
    versions = [(f"p{i}", f"c{i}", f"l{i // 2}") for i in range(4000)] + [("p0", "c0", "l0"), ("p1", "c1", "l9"), (None, "c", "l"), ("p8", "other", "l4")]
    provisions = spark.createDataFrame(versions, "provision_id string, text_checksum string, lineage_id string")
    pairs = [(0, 0, 1), (0, 2, 2), (1, 4, 6), (2, None, 9), (2, 8, 9), (3, 10, None), (4, 5000, 11), (5, 12, 13)]
    of = lambda k: (None, None) if k is None else (f"p{k}", f"c{k}")
    bases = spark.createDataFrame([(b, *of(h), *of(c), "l") for b, h, c in pairs], "base int, hist_id string, hist_checksum string, curr_id string, curr_checksum string, legal_anchor_id string")
    claims = spark.createDataFrame([(f"y{i}", i % 7, "OUTDATED_BUT_PREVIOUSLY_TRUE") for i in range(14)], "ykien_id string, base int, verdict string")
    df = acceptance.QUERIES[name]({"provisions": provisions, "claims": claims, "bases": bases}, {})
    # As said row by row: a version listed twice counts twice.
    found = lambda k: [x for p, c, x in versions if (p, c) == of(k) and k is not None]
    want = []
    for b, h, c in pairs:
        for x in found(h) or [None]:
            for y in found(c) or [None]:
                sound = x is not None and x == y and h != c
                want += [(f"y{i}", of(h)[0], of(c)[0]) if name == "T18" else (f"y{i}",) for i in (b, b + 7) if sound == (name == "T18")]
    key = lambda rows: sorted(map(repr, map(tuple, rows)))
    assert key(df.collect()) == key(want) and want
    optimized = df._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("Join LeftSemi") == 2, optimized
    assert frequent.maybe_among(provisions, "provision_id", bases, "hist_id").count() < 100


def test_bases_need_no_join(spark, sf_dir):
    bases = plans.tables(spark, sf_dir)["bases"]
    assert "Join" not in bases._jdf.queryExecution().optimizedPlan().toString()
    rows = bases.collect()
    assert {r["legal_anchor_id"] for r in rows} == {r["lineage_id"] for r in plans.tables(spark, sf_dir)["provisions"].select("lineage_id").distinct().collect()}
    assert all(r["hist_id"].startswith(r["legal_anchor_id"] + "@") and (r["curr_id"] is None or r["curr_id"].startswith(r["legal_anchor_id"] + "@")) for r in rows)
