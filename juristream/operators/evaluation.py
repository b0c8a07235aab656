"""Measures of rankings, classes, clusters and latencies, and the gates that a release must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(value: str, share: float) -> Column:
    """The smallest value with at least this share of all at or below it."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {value})")


def ranking(relevant: DataFrame, found: DataFrame, k: int = 5) -> DataFrame:
    """case_id, recall, rr, ndcg at k for relevant (case_id, id) and found (case_id, id, position). Every relevant case counts, found or not."""
    hits = found.where(F.col("position") <= k).groupBy("case_id", "id").agg(F.min("position").alias("position")).join(relevant.select("case_id", "id").distinct(), ["case_id", "id"])
    got = hits.groupBy("case_id").agg(F.count("*").alias("hits"), F.min("position").alias("first"), F.sum(1 / F.log2(F.col("position") + 1)).alias("gain"))
    want = relevant.groupBy("case_id").agg(F.countDistinct("id").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return want.join(got, "case_id", "left").select("case_id", zero(F.col("hits") / F.col("n")).alias("recall"), zero(1 / F.col("first")).alias("rr"), F.round(zero(F.col("gain") / ideal), 9).alias("ndcg"))


def macro(per_case: DataFrame, *measures: str) -> DataFrame:
    """Means over all cases; a case without a value counts as 0."""
    return per_case.agg(F.count("*").alias("n_cases"), *[F.round(F.avg(F.coalesce(m, F.lit(0.0))), 9).alias(m) for m in measures])


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def per_label(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """label, tp, fp, fn, precision, recall, f1 of every label that is expected or predicted; one pass, combined before the shuffle."""
    hit = F.col(expected).eqNullSafe(F.col(predicted))
    sides = F.array(F.struct(F.col(expected).alias("label"), hit.cast("int").alias("tp"), F.lit(0).alias("fp"), (~hit).cast("int").alias("fn")), F.struct(F.col(predicted).alias("label"), F.lit(0).alias("tp"), (~hit).cast("int").alias("fp"), F.lit(0).alias("fn")))
    g = rows.select(F.explode(sides).alias("s")).select("s.*").groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]).where("label IS NOT NULL")
    g = g.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return g.withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def classification(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """n, accuracy, macro_f1."""
    f1 = per_label(rows, expected, predicted).agg(F.round(F.avg("f1"), 9).alias("macro_f1"))
    return rows.agg(F.count("*").alias("n"), F.avg(F.col(expected).eqNullSafe(F.col(predicted)).cast("double")).alias("accuracy")).join(F.broadcast(f1))


def pairwise_clusters(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of pairs in one cluster, from group sizes alone: no pair is ever formed."""
    pairs = lambda *keys: rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")), F.lit(0)).alias("_".join(keys)))
    both = pairs(expected, predicted).toDF("both").join(F.broadcast(pairs(expected).toDF("expected_pairs"))).join(F.broadcast(pairs(predicted).toDF("predicted_pairs")))
    p, r = ratio(F.col("both"), F.col("predicted_pairs")), ratio(F.col("both"), F.col("expected_pairs"))
    return both.select("both", "expected_pairs", "predicted_pairs", p.alias("precision"), r.alias("recall"), ratio(2 * F.col("both"), F.col("expected_pairs") + F.col("predicted_pairs")).alias("f1"))


def exact_sets(rows: DataFrame, expected: str, predicted: str) -> DataFrame:
    """n, accuracy: the share of rows whose two arrays hold the same elements."""
    same = F.array_sort(F.array_distinct(expected)) == F.array_sort(F.array_distinct(predicted))
    return rows.agg(F.count("*").alias("n"), F.avg(F.coalesce(same, F.lit(False)).cast("double")).alias("accuracy"))


def parser_recall(rows: DataFrame) -> DataFrame:
    """recall by level and character coverage over (expected_ids_by_level, predicted_ids_by_level: maps of arrays; expected_character_count, preserved_character_count)."""
    per = rows.select(F.explode("expected_ids_by_level").alias("level", "want"), "predicted_ids_by_level").select("level", F.size(F.array_distinct("want")).alias("n"), F.size(F.array_intersect("want", F.coalesce(F.col("predicted_ids_by_level")[F.col("level")], F.array().cast("array<string>")))).alias("hit"))
    levels = per.groupBy("level").agg(ratio(F.sum("hit"), F.sum("n")).alias("value")).select(F.concat(F.lit("recall_"), "level").alias("metric"), "value")
    chars = rows.agg(F.least(F.lit(1.0), ratio(F.sum("preserved_character_count"), F.sum("expected_character_count"))).alias("value")).select(F.lit("character_coverage").alias("metric"), "value")
    return levels.unionByName(chars)


def citations(rows: DataFrame) -> DataFrame:
    """n, exact_node_accuracy, canonical_validity_rate of cases with what is expected and what was found."""
    valid = F.col("node_exists") & F.col("effective") & F.col("quote_exact") & F.col("supports_claim")
    return rows.agg(F.count("*").alias("n"), F.avg(F.col("expected_node_id").eqNullSafe(F.col("node_id")).cast("double")).alias("exact_node_accuracy"), F.avg(F.coalesce(valid, F.lit(False)).cast("double")).alias("canonical_validity_rate"))


def amendments(rows: DataFrame) -> DataFrame:
    """Pair precision and recall, and precision of what was approved without review, over (expected_pair, predicted_pair, auto_approved, auto_approve_allowed)."""
    e, p = F.col("expected_pair"), F.col("predicted_pair")
    hit = e.isNotNull() & e.eqNullSafe(p)
    return rows.agg(
        ratio(F.count_if(hit), F.count_if(p.isNotNull())).alias("pair_precision"),
        ratio(F.count_if(hit), F.count_if(e.isNotNull())).alias("pair_recall"),
        F.when(F.count_if("auto_approved") == 0, 1.0).otherwise(F.count_if(F.col("auto_approved") & F.col("auto_approve_allowed") & e.eqNullSafe(p)) / F.count_if("auto_approved")).alias("auto_approved_pairing_precision"),
    )


def safety(rows: DataFrame) -> DataFrame:
    """required_refusal_rate, over_refusal_rate, accuracy over (expected_refused, refused)."""
    e, r = F.col("expected_refused"), F.col("refused")
    return rows.agg(ratio(F.count_if(e & r), F.count_if(e)).alias("required_refusal_rate"), ratio(F.count_if(~e & r), F.count_if(~e)).alias("over_refusal_rate"), F.avg((e == r).cast("double")).alias("accuracy"))


def latency(rows: DataFrame) -> DataFrame:
    """n, failure_rate, p50, p95 (of successes), baseline_p95 (of all) and their ratio over (success, latency_ms, baseline_latency_ms); nothing measured fails."""
    ok = rows.where("success")
    a = rows.agg(F.count("*").alias("n"), F.when(F.count("*") == 0, 1.0).otherwise(1 - F.avg(F.col("success").cast("double"))).alias("failure_rate"), nearest_rank("baseline_latency_ms", 0.95).alias("baseline_p95"))
    b = ok.agg(nearest_rank("latency_ms", 0.5).alias("p50"), nearest_rank("latency_ms", 0.95).alias("p95"))
    return a.join(F.broadcast(b)).withColumn("p95_regression_ratio", F.coalesce(F.try_divide("p95", "baseline_p95"), F.lit(float("inf"))))


def gates(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """metric, operator, target, severity, value, passed for rules (metric, operator, value, severity); a metric that is missing fails."""
    m = metrics.select("metric", F.col("value").alias("actual"))
    ok = F.when(F.col("operator") == "min", F.col("actual") >= F.col("value")).when(F.col("operator") == "max", F.col("actual") <= F.col("value")).when(F.col("operator") == "eq", F.abs(F.col("actual") - F.col("value")) < 1e-12)
    return rules.join(m, "metric", "left").select("metric", "operator", F.col("value").alias("target"), "severity", F.col("actual").alias("value"), F.coalesce(ok, F.lit(False)).alias("passed"))


def release(gated: DataFrame, suites: DataFrame) -> DataFrame:
    """released: all blocking gates passed and every suite (suite, n_cases, least_cases) is large enough."""
    a = gated.agg(F.coalesce(F.bool_and(F.col("passed") | (F.col("severity") != "blocking")), F.lit(False)).alias("gates"))
    b = suites.agg(F.coalesce(F.bool_and(F.col("n_cases") >= F.col("least_cases")), F.lit(False)).alias("eligible"))
    return a.join(F.broadcast(b)).withColumn("released", F.col("gates") & F.col("eligible"))


def parity(left: DataFrame, right: DataFrame, key: str = "id", checksum: str = "checksum") -> DataFrame:
    """key, state of two stores: same, differs, left_only, right_only, and repeated where a store has a key twice."""
    side = lambda d, n: d.groupBy(key).agg(F.count("*").alias(f"{n}_n"), F.min(checksum).alias(f"{n}_sum"))
    both = side(left, "l").join(side(right, "r"), key, "full")
    state = F.when((F.col("l_n") > 1) | (F.col("r_n") > 1), "repeated").when(F.col("r_n").isNull(), "left_only").when(F.col("l_n").isNull(), "right_only").when(F.col("l_sum").eqNullSafe(F.col("r_sum")), "same").otherwise("differs")
    return both.select(key, state.alias("state"))


def any_hit_precision(rows: DataFrame, expected: str, predicted: str, k: int = 3) -> DataFrame:
    """n, precision: the share of rows that have one of the expected among their first k."""
    return rows.agg(F.count("*").alias("n"), F.avg(F.arrays_overlap(expected, F.slice(predicted, 1, k)).cast("double")).alias("precision"))


def first_seen_mode(rows: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """key, its most frequent value, n; of equally frequent ones the earliest."""
    g = rows.groupBy(key, value).agg(F.count("*").alias("n"), F.min(position).alias("_at"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "_at")
    return g.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(key, value, "n")


def ablation(per_case: DataFrame, profile: str = "profile", recall: str = "recall") -> DataFrame:
    """delta: the mean recall of the whole ranking (hybrid_graph_rerank) less that of vectors alone; null if either is missing."""
    mean = lambda name: F.avg(F.when(F.col(profile) == name, F.col(recall)))
    return per_case.agg(F.round(mean("hybrid_graph_rerank") - mean("vector"), 9).alias("delta"))
