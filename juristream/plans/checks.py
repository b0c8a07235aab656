"""Queries that measure, judge and check: evaluation measures, claims and alerts, contracts, and what writes add."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juristream.functions import arrow
from juristream.functions import text as T
from juristream.operators import claims, contracts, evaluation, retrieval, snapshots, temporal, writes
from juristream.plans.common import Collected, table
from juristream.plans.law import _LAW, LATER, provisions
from juristream.sources import files

found = Collected()
QUERIES, ORACLES = found.queries, found.oracles

_PREDICTED = "SELECT event_id, event_type AS e, CASE WHEN event_id % 4 = 0 THEN 'view' WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS p FROM events"


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    return table(spark, sf_dir, "events").select(e, kind.alias("expected"), F.when(e % 4 == 0, "view").when(e % 9 != 0, kind).alias("predicted"))


@found.add(f"""
WITH x AS ({_PREDICTED}), l AS (SELECT DISTINCT e AS label FROM x UNION SELECT DISTINCT p FROM x WHERE p IS NOT NULL),
c AS (SELECT label, CAST(count(*) FILTER (e = label AND p = label) AS BIGINT) AS tp, CAST(count(*) FILTER (p = label AND e <> label) AS BIGINT) AS fp, CAST(count(*) FILTER (e = label AND p IS DISTINCT FROM label) AS BIGINT) AS fn FROM l, x GROUP BY 1),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / CAST(2 * tp + fp + fn AS DOUBLE) ELSE 0.0 END AS f1 FROM c)
SELECT label, tp, fp, fn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1 FROM r
""")
def eval_per_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = evaluation.per_label(predicted(spark, sf_dir), "expected", "predicted")
    return g.select("label", "tp", "fp", "fn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@found.add(f"""
WITH x AS ({_PREDICTED}), l AS (SELECT DISTINCT e AS label FROM x UNION SELECT DISTINCT p FROM x WHERE p IS NOT NULL),
c AS (SELECT label, 2.0 * count(*) FILTER (e = label AND p = label) / (count(*) FILTER (e = label) + count(*) FILTER (p = label)) AS f1 FROM l, x GROUP BY 1)
SELECT (SELECT count(*) FROM x) AS n, (SELECT round(avg(CASE WHEN e = p THEN 1.0::DOUBLE ELSE 0.0 END), 9) FROM x) AS accuracy, round(avg(f1), 9) AS macro_f1 FROM c
""")
def eval_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.classification(predicted(spark, sf_dir), "expected", "predicted").withColumn("accuracy", F.round("accuracy", 9))


@found.add("SELECT count(*) AS n_cases, round(avg(coalesce(CASE WHEN c_custkey % 5 > 0 THEN (c_custkey % 7) / 6.0::DOUBLE END, 0)), 9) AS recall, round(avg(c_custkey % 3 / 2.0::DOUBLE), 9) AS rr FROM customer")
def eval_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return evaluation.macro(table(spark, sf_dir, "customer").select(F.when(k % 5 > 0, (k % 7) / 6.0).alias("recall"), ((k % 3) / 2.0).alias("rr")), "recall", "rr")


@found.add("SELECT round(avg(CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal END) - avg(CASE WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal END), 9) AS delta FROM customer")
def eval_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as profiles, balances as recalls."""
    profile = F.when(F.col("c_mktsegment") == "BUILDING", "hybrid_graph_rerank").when(F.col("c_mktsegment") == "MACHINERY", "vector").otherwise("lexical")
    return evaluation.ablation(table(spark, sf_dir, "customer").select(profile.alias("profile"), F.col("c_acctbal").alias("recall")))


@found.add("SELECT count(*) AS n, avg(CASE WHEN p_partkey % 3 > 0 OR len(list_distinct(string_split(p_name, ' '))) = 1 THEN 1.0::DOUBLE ELSE 0.0 END) AS accuracy FROM part")
def eval_exact_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of names, turned round or repeated; in one of three the last different word is missing."""
    w = F.array_distinct(F.split("p_name", " "))
    rows = table(spark, sf_dir, "part").select(w.alias("a"), F.when(F.col("p_partkey") % 3 == 1, F.reverse(w)).when(F.col("p_partkey") % 3 == 2, F.concat(w, w)).otherwise(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(1)))).alias("b"))
    return evaluation.exact_sets(rows, "a", "b")


@found.add("""
WITH s AS (SELECT s_suppkey % 5 + 1 AS d, s_suppkey % 3 + 1 AS got, 3 AS k, s_suppkey % 100 AS want_c, s_suppkey % 90 AS got_c FROM supplier)
SELECT 'recall_dieu' AS metric, round(sum(least(d, got)) / CAST(sum(d) AS DOUBLE), 9) AS value FROM s
UNION ALL SELECT 'recall_khoan', 0.0::DOUBLE
UNION ALL SELECT 'character_coverage', round(least(1.0, sum(got_c) / CAST(sum(want_c) AS DOUBLE)), 9) FROM s
""")
def eval_parser_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    ids = lambda n: F.transform(F.sequence(F.lit(1), n.cast("int")), lambda i: i.cast("string"))
    rows = table(spark, sf_dir, "supplier").select(
        F.create_map(F.lit("dieu"), ids(s % 5 + 1), F.lit("khoan"), ids(F.lit(3))).alias("expected_ids_by_level"), F.create_map(F.lit("dieu"), ids(s % 3 + 1)).alias("predicted_ids_by_level"), (s % 100).alias("expected_character_count"), (s % 90).alias("preserved_character_count")
    )
    return evaluation.parser_recall(rows).withColumn("value", F.round("value", 9))


@found.add("""
SELECT count(*) AS n, avg(CASE WHEN l_partkey % 3 > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS exact_node_accuracy,
       avg(CASE WHEN l_partkey % 2 = 0 AND l_returnflag = 'N' AND l_suppkey % 5 > 0 AND l_linenumber < 6 THEN 1.0::DOUBLE ELSE 0.0 END) AS canonical_validity_rate FROM lineitem
""")
def eval_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("expected_node_id"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey")).otherwise(-1).alias("node_id"), (F.col("l_partkey") % 2 == 0).alias("node_exists"), (F.col("l_returnflag") == "N").alias("effective"), (F.col("l_suppkey") % 5 > 0).alias("quote_exact"),
        (F.col("l_linenumber") < 6).alias("supports_claim"),
    )
    return evaluation.citations(rows)


@found.add("""
WITH r AS (SELECT CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS e, CASE WHEN o_orderkey % 7 > 1 THEN o_custkey WHEN o_orderkey % 7 = 1 THEN -1 END AS p, o_orderstatus = 'F' AS auto, o_orderkey % 2 = 0 AS allowed FROM orders)
SELECT count(*) FILTER (e = p) / CAST(count(p) AS DOUBLE) AS pair_precision, count(*) FILTER (e = p) / CAST(count(e) AS DOUBLE) AS pair_recall, count(*) FILTER (auto AND allowed AND e IS NOT DISTINCT FROM p) / CAST(count(*) FILTER (auto) AS DOUBLE) AS auto_approved_pairing_precision FROM r
""")
def eval_amendments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf_dir, "orders").select(F.when(o % 5 > 0, c).alias("expected_pair"), F.when(o % 7 > 1, c).when(o % 7 == 1, -1).alias("predicted_pair"), (F.col("o_orderstatus") == "F").alias("auto_approved"), (o % 2 == 0).alias("auto_approve_allowed"))
    return evaluation.amendments(rows)


@found.add("""
WITH r AS (SELECT event_type = 'error' AS e, event_type = 'error' AND event_id % 3 > 0 OR event_id % 10 = 0 AS r FROM events)
SELECT count(*) FILTER (e AND r) / CAST(count(*) FILTER (e) AS DOUBLE) AS required_refusal_rate, count(*) FILTER (NOT e AND r) / CAST(count(*) FILTER (NOT e) AS DOUBLE) AS over_refusal_rate, avg(CASE WHEN e = r THEN 1.0::DOUBLE ELSE 0.0 END) AS accuracy FROM r
""")
def eval_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type") == "error"
    return evaluation.safety(table(spark, sf_dir, "events").select(e.alias("expected_refused"), ((e & (F.col("event_id") % 3 > 0)) | (F.col("event_id") % 10 == 0)).alias("refused")))


@found.add("""
WITH m AS (SELECT event_type AS metric, avg(value) AS v FROM events GROUP BY 1), g AS (SELECT bool_and(CASE metric WHEN 'click' THEN v >= 10 WHEN 'view' THEN TRUE ELSE TRUE END) AS gates FROM m WHERE metric IN ('click', 'view')),
s AS (SELECT bool_and(n >= 3) AS eligible FROM (SELECT count(*) AS n FROM events GROUP BY event_type))
SELECT gates, eligible, gates AND eligible AS released FROM g, s
""")
def eval_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rules = spark.createDataFrame([("click", "min", 10.0, "blocking"), ("view", "max", -1.0, "advisory")], "metric string, operator string, value double, severity string")
    suites = events.groupBy(F.col("event_type").alias("suite")).agg(F.count("*").alias("n_cases")).withColumn("least_cases", F.lit(3))
    return evaluation.release(evaluation.gates(events.groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value")), rules), suites)


@found.add("""
WITH t AS (SELECT string_split(p_name, ' ') AS w, p_size FROM part)
SELECT count(*) AS n, avg(CASE WHEN len(list_intersect(w[1:3], [w[len(w)], CASE WHEN p_size % 2 = 0 THEN w[1] ELSE 'none' END])) > 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS precision FROM t
""")
def eval_any_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three words of a name; expected is its last one, and for even sizes the first."""
    w = F.split("p_name", " ")
    rows = table(spark, sf_dir, "part").select(F.array(F.element_at(w, -1), F.when(F.col("p_size") % 2 == 0, F.element_at(w, 1)).otherwise("none")).alias("e"), w.alias("p"))
    return evaluation.any_hit_precision(rows, "e", "p")


# Claims ----------------------------------------------------------------------------------------------------------------

_PAIRS = r"""
WITH t AS (SELECT conv_id, turn, regexp_replace(lower(text), '[0-9%]', '', 'g') AS h, lead(regexp_replace(lower(text), '[0-9%]', '', 'g')) OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
w AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN h || ' không đúng' WHEN turn % 7 = 0 THEN h || ' chưa đủ căn cứ' ELSE h END AS h, CASE WHEN turn % 2 = 0 THEN h ELSE coalesce(n, '') END AS p FROM t),
x AS (SELECT *, list_filter(regexp_extract_all(h, '[\p{L}\p{N}_]+'), lambda x: length(x) > 1) AS hw, list_distinct(list_filter(regexp_extract_all(p, '[\p{L}\p{N}_]+'), lambda x: length(x) > 1)) AS pw FROM w),
y AS (SELECT *, CASE WHEN len(hw) > 0 THEN len(list_filter(hw, lambda x: list_contains(pw, x))) / CAST(len(hw) AS DOUBLE) END AS o FROM x)
SELECT conv_id, turn,
       CASE WHEN len(pw) = 0 OR len(hw) = 0 THEN 'khong_ro' WHEN contains(h, 'chưa đủ căn cứ') THEN 'khong_ro' WHEN contains(h, 'không đúng') AND o >= 0.45 THEN 'mau_thuan' WHEN o >= 0.55 THEN 'khop' ELSE 'khong_ro' END AS label,
       round(CASE WHEN len(pw) = 0 OR len(hw) = 0 THEN 0.0 WHEN contains(h, 'chưa đủ căn cứ') THEN 0.85 WHEN contains(h, 'không đúng') AND o >= 0.45 THEN least(0.95, o) WHEN o >= 0.55 THEN least(0.95, o) ELSE greatest(0.1, o) END, 9) AS score
FROM y
"""


@found.add(_PAIRS)
def nli_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn, sometimes with a denial or an open matter, against itself or the next one."""
    from pyspark.sql import Window

    plain = F.regexp_replace(F.lower("text"), "[0-9%]", "")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", plain.alias("h"), F.lead(plain).over(Window.partitionBy("conv_id").orderBy("turn")).alias("n"))
    h = F.when(F.col("turn") % 3 == 0, F.concat("h", F.lit(" không đúng"))).when(F.col("turn") % 7 == 0, F.concat("h", F.lit(" chưa đủ căn cứ"))).otherwise(F.col("h"))
    rows = rows.select("conv_id", "turn", h.alias("hypothesis"), F.when(F.col("turn") % 2 == 0, F.col("h")).otherwise(F.coalesce("n", F.lit(""))).alias("premise"))
    out = rows.withColumn("r", claims.infer(F.col("premise"), F.col("hypothesis")))
    return out.select("conv_id", "turn", F.col("r.label").alias("label"), F.round("r.score", 9).alias("score"))


_CHECKS = """
WITH c AS (
  SELECT event_id, 'm' || CAST(event_id % 200 AS VARCHAR) AS misconception_id, CASE WHEN event_id % 31 = 0 THEN NULL ELSE 'L' || CAST(event_id % 50 AS VARCHAR) END AS hl, CASE WHEN event_id % 37 = 0 THEN 'Lx' ELSE 'L' || CAST(event_id % 50 AS VARCHAR) END AS cl,
         CASE WHEN event_id % 31 = 0 THEN NULL ELSE 'v' || CAST(event_id % 9 AS VARCHAR) END AS hp, 'v' || CAST(event_id % 4 AS VARCHAR) AS cp,
         CASE WHEN event_id % 200 < 80 THEN 'khop' WHEN event_id % 3 = 0 THEN 'mau_thuan' ELSE 'khop' END AS h, CASE WHEN event_id % 200 < 50 THEN 'khop' WHEN event_id % 2 = 0 THEN 'mau_thuan' ELSE 'khong_ro' END AS k, event_id % 41 = 0 AS r
  FROM events
), v AS (
  SELECT *, CASE WHEN hp IS NULL OR hl <> cl OR r OR (hp = cp AND h <> k) THEN 'NEEDS_REVIEW' WHEN h = 'khop' AND k = 'mau_thuan' AND hp <> cp THEN 'OUTDATED_BUT_PREVIOUSLY_TRUE' WHEN k = 'khop' THEN 'SUPPORTED'
                 WHEN k = 'mau_thuan' AND h = 'mau_thuan' THEN 'CONTRADICTED' ELSE 'UNVERIFIABLE' END AS verdict FROM c
)
"""


def dual_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    v = lambda n: F.concat(F.lit("v"), (e % n).cast("string"))
    lineage = F.concat(F.lit("L"), (e % 50).cast("string"))
    check = lambda lin, p, label: F.struct(lin.alias("lineage_id"), p.alias("provision_id"), label.alias("label"), F.lit(0.9).alias("score"), (e % 41 == 0).alias("needs_review"))
    known = e % 31 != 0
    hist = check(F.when(known, lineage), F.when(known, v(9)), F.when(e % 200 < 80, "khop").when(e % 3 == 0, "mau_thuan").otherwise("khop"))
    curr = check(F.when(e % 37 == 0, "Lx").otherwise(lineage), v(4), F.when(e % 200 < 50, "khop").when(e % 2 == 0, "mau_thuan").otherwise("khong_ro"))
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("m"), (e % 200).cast("string")).alias("misconception_id"), hist.alias("hist"), curr.alias("curr"))
    return rows.select("event_id", "misconception_id", claims.verdict(F.col("hist"), F.col("curr")).alias("verdict"))


@found.add(_CHECKS + "SELECT event_id, verdict FROM v")
def claim_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two checks of a claim, before and now, and what they come to."""
    return dual_checks(spark, sf_dir).select("event_id", "verdict")


@found.add(_CHECKS + "SELECT misconception_id, CASE WHEN bool_or(verdict = 'NEEDS_REVIEW') THEN 'NEEDS_REVIEW' WHEN count(DISTINCT verdict) = 1 THEN min(verdict) ELSE 'PARTIALLY_INCORRECT' END AS verdict FROM v GROUP BY 1")
def claim_cluster_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.cluster_verdicts(dual_checks(spark, sf_dir))


_OCCUR = """
WITH o AS (
  SELECT 'm' || CAST(event_id % 97 AS VARCHAR) AS misconception_id, CAST(event_id AS VARCHAR) AS ykien_id, 'c' || CAST(event_id % 500 AS VARCHAR) AS content_id, CASE WHEN event_id % 6 > 0 THEN 'h' || CAST(event_id % 300 AS VARCHAR) END AS content_hash,
         CASE event_id % 4 WHEN 0 THEN 'news' WHEN 1 THEN 'forum' WHEN 2 THEN 'video' ELSE 'other' END AS source_type, ts AS published_at, CASE WHEN event_id % 5 > 0 THEN (event_id % 10) / 10.0::DOUBLE END AS engagement, event_id % 12 > 0 AS complete,
         CASE event_id % 3 WHEN 0 THEN 'phạt tù ba năm' WHEN 1 THEN 'phạt tiền' ELSE 'khác' END AS legal_text, CASE WHEN event_id % 2 = 0 THEN 'mau_thuan' ELSE 'khop' END AS label, (event_id % 100) / 100.0::DOUBLE AS score, DATE '2024-01-01' + CAST(event_id % 900 AS INTEGER) AS effective_from
  FROM events
)
"""


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    name = lambda kind, n: F.concat(F.lit(kind), (e % n).cast("string"))
    return table(spark, sf_dir, "events").select(
        name("m", 97).alias("misconception_id"), e.cast("string").alias("ykien_id"), name("c", 500).alias("content_id"), F.when(e % 6 > 0, name("h", 300)).alias("content_hash"), F.when(e % 4 == 0, "news").when(e % 4 == 1, "forum").when(e % 4 == 2, "video").otherwise("other").alias("source_type"), F.col("ts").alias("published_at"),
        F.when(e % 5 > 0, (e % 10) / 10.0).alias("engagement_score"), (e % 12 > 0).alias("provenance_complete"), F.when(e % 3 == 0, "phạt tù ba năm").when(e % 3 == 1, "phạt tiền").otherwise("khác").alias("legal_text"), F.when(e % 2 == 0, "mau_thuan").otherwise("khop").alias("label"), ((e % 100) / 100.0).alias("score"),
        F.date_add(F.lit("2024-01-01").cast("date"), (e % 900).cast("int")).alias("effective_from"), (F.when(e % 3 == 0, "zalo").otherwise("fb")).alias("provider"),
    )


@found.add(_OCCUR + """
, s AS (SELECT misconception_id, coalesce(content_hash, content_id) AS who, min(published_at) AS first, bool_or(content_hash IS NOT NULL) AS hashed, count(*) AS n,
               max(CASE source_type WHEN 'news' THEN 0.70::DOUBLE WHEN 'forum' THEN 0.45::DOUBLE WHEN 'video' THEN 0.60::DOUBLE ELSE 0.4::DOUBLE END) AS reach, max(CASE legal_text WHEN 'phạt tù ba năm' THEN 0.9::DOUBLE WHEN 'phạt tiền' THEN 0.7::DOUBLE ELSE 0.45::DOUBLE END) AS impact,
               max(CASE WHEN label = 'mau_thuan' THEN score END) AS contradiction, max(CASE WHEN DATE '2026-01-01' - effective_from <= 90 THEN 1.0::DOUBLE WHEN DATE '2026-01-01' - effective_from <= 365 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS recent,
               sum(coalesce(engagement, 0)) AS engagement, count(*) FILTER (NOT complete) AS incomplete FROM o GROUP BY 1, 2),
g AS (SELECT misconception_id, count(*) FILTER (hashed) AS hashes, sum(n) AS n, max(reach) AS reach, max(impact) AS impact, max(contradiction) AS contradiction, max(recent) AS recent, sum(engagement) AS engagement, sum(incomplete) AS incomplete, count(*) AS sources,
             (floor(epoch(max(first))) - floor(epoch(min(first)))) / 3600 AS hours FROM s GROUP BY 1),
f AS (SELECT misconception_id, round(impact, 6) AS a, round(reach, 6) AS b, round(coalesce(contradiction, 0), 6) AS c,
             round(greatest(0, least(1, (CASE WHEN hashes > 0 THEN hashes ELSE n END) / greatest(1.0, CASE WHEN sources > 1 THEN hours ELSE 24 END) / 0.5)), 6) AS d, round(greatest(0, least(1, (CASE WHEN hashes > 0 THEN hashes ELSE n END) / 3.0)), 6) AS e, round(recent, 6) AS r,
             round(greatest(0, least(1, engagement / n)), 6) AS g, round(greatest(0, least(1, incomplete / CAST(n AS DOUBLE))), 6) AS p FROM g),
t AS (SELECT misconception_id, round(greatest(0.0, least(1.0, round(a * 0.25::DOUBLE, 6) + round(b * 0.2::DOUBLE, 6) + round(c * 0.15::DOUBLE, 6) + round(d * 0.15::DOUBLE, 6) + round(e * 0.1::DOUBLE, 6) + round(r * 0.1::DOUBLE, 6) + round(g * 0.05::DOUBLE, 6) - 0.3::DOUBLE * p)), 6) AS risk FROM f)
SELECT misconception_id, CAST(floor(risk * 10000 + 0.005) AS BIGINT) AS risk FROM t
""")
def claim_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk in ten-thousandths: the sixth digit of a sum of doubles may differ by one."""
    return claims.risk_scores(occurrences(spark, sf_dir), "2026-01-01").select("misconception_id", F.floor(F.col("risk_score") * 10000 + 0.005).alias("risk"))


@found.add(_OCCUR + "SELECT misconception_id, count(*) AS volume, count(DISTINCT coalesce(content_hash, content_id)) AS source_count, count(DISTINCT CASE WHEN CAST(ykien_id AS BIGINT) % 3 = 0 THEN 'zalo' ELSE 'fb' END) AS provider_count FROM o GROUP BY 1")
def claim_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes.counters(occurrences(spark, sf_dir))


_SIGNALS = """
WITH s AS (
  SELECT 't' || CAST(event_id % 3 AS VARCHAR) AS topic, 'k' || CAST(event_id % 40 AS VARCHAR) AS khoan_id, CASE WHEN event_id % 5 > 0 THEN 'm' || CAST(event_id % 40 AS VARCHAR) END AS misconception_id, sha256('x' || CAST(event_id % 600 AS VARCHAR)) AS content_hash, 'claim ' || CAST(event_id % 7 AS VARCHAR) AS claim_text,
         event_id % 11 > 0 AS url, event_id % 13 > 0 AS inside, CASE event_id % 3 WHEN 0 THEN 'mau_thuan' WHEN 1 THEN 'khong_ro' ELSE 'khop' END AS label, CASE WHEN event_id % 4 = 0 THEN 0.3::DOUBLE ELSE 0.8::DOUBLE END AS score, event_id % 8 = 0 AS review, CASE WHEN event_id % 40 < 30 THEN (event_id % 40) / 40.0::DOUBLE END AS risk
  FROM events
), f AS (SELECT * FROM s WHERE url AND inside AND (score >= 0.7 OR review) AND label <> 'khop'),
g AS (SELECT misconception_id, topic, khoan_id, count(*) AS volume, max(risk) AS risk FROM (SELECT misconception_id, topic, khoan_id, content_hash, claim_text, max(risk) AS risk FROM f GROUP BY ALL) GROUP BY 1, 2, 3 HAVING count(*) >= 6),
a AS (SELECT *, CASE WHEN misconception_id IS NOT NULL THEN 'misconception:' || misconception_id ELSE topic || ':' || khoan_id END AS dedupe_key,
             CASE WHEN risk IS NULL THEN CASE WHEN volume >= 18 THEN 'high' WHEN volume >= 12 THEN 'medium' ELSE 'low' END WHEN risk >= 0.85 THEN 'critical' WHEN risk >= 0.7 THEN 'high' WHEN risk >= 0.5 THEN 'medium' ELSE 'low' END AS severity FROM g)
"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    name = lambda kind, n: F.concat(F.lit(kind), (e % n).cast("string"))
    return table(spark, sf_dir, "events").select(
        name("t", 3).alias("topic"), name("k", 40).alias("khoan_id"), F.when(e % 5 > 0, name("m", 40)).alias("misconception_id"), e.cast("string").alias("ykien_id"), e.cast("string").alias("bai_dang_id"), name("claim ", 7).alias("claim_text"), F.lit("span").alias("evidence_span"), F.when(e % 13 > 0, "a span").otherwise("other").alias("post_content"),
        F.when(e % 11 > 0, "u").otherwise(" ").alias("post_url"), F.when(e % 3 == 0, "mau_thuan").when(e % 3 == 1, "khong_ro").otherwise("khop").alias("label"), F.when(e % 4 == 0, 0.3).otherwise(0.8).alias("score"), (e % 8 == 0).alias("needs_review"), F.sha2(name("x", 600), 256).alias("content_hash"), F.when(e % 40 < 30, (e % 40) / 40.0).alias("risk_score"),
    )


@found.add(_SIGNALS + "SELECT topic, khoan_id, misconception_id, volume, dedupe_key, severity FROM a WHERE dedupe_key NOT IN ('misconception:m7', 'misconception:m12', 't1:k10')")
def claim_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of six signals or more; three keys are in their cool-down."""
    recent = spark.createDataFrame([("misconception:m7",), ("misconception:m12",), ("t1:k10",)], "dedupe_key string")
    return claims.alerts(signals(spark, sf_dir), threshold=6, recent=recent).select("topic", "khoan_id", "misconception_id", "volume", "dedupe_key", "severity")


@found.add(_SIGNALS + """
, x AS (SELECT a.dedupe_key AS alert_id, e.event_id, CASE WHEN event_id % 5 > 0 THEN 'm' || CAST(event_id % 40 AS VARCHAR) END AS m FROM a JOIN events e ON a.khoan_id = 'k' || CAST(e.event_id % 40 AS VARCHAR) AND a.topic = 't' || CAST(e.event_id % 3 AS VARCHAR))
SELECT DISTINCT alert_id, 'BAO_GOM_TIN_HIEU' AS kind, CAST(event_id AS VARCHAR) AS target FROM x WHERE event_id % 2 = 0
UNION SELECT DISTINCT alert_id, 'CANH_BAO_VE', m FROM x WHERE m IS NOT NULL AND m <> 'm7'
""")
def claim_alert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from alerts to the signals of their topic and clause; of these only even ones are there, and one misconception isn't."""
    every = signals(spark, sf_dir)
    found_ = claims.alerts(every, threshold=6).select(F.col("dedupe_key").alias("alert_id"), "topic", "khoan_id")
    of = found_.join(every.select("topic", "khoan_id", "ykien_id", "misconception_id"), ["topic", "khoan_id"])
    grouped = of.groupBy("alert_id", "topic", "khoan_id").agg(F.collect_list(F.struct("ykien_id", "misconception_id")).alias("signals"))
    known = every.where("CAST(ykien_id AS BIGINT) % 2 = 0").select("ykien_id")
    return writes.alert_edges(grouped, known, every.where("misconception_id IS NOT NULL AND misconception_id <> 'm7'").select("misconception_id").distinct())


@found.add(r"""
WITH c AS (SELECT CAST(conv_id * 100 + turn AS VARCHAR) AS ykien_id, conv_id * 100 + turn AS n, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)
SELECT ykien_id, CASE WHEN n % 5 = 0 THEN 'canonical_url_missing,' ELSE '' END || CASE WHEN n % 7 = 0 THEN 'hash_malformed,' ELSE '' END || CASE WHEN n % 7 = 0 OR n % 11 = 0 THEN 'hash_differs,' ELSE '' END || CASE WHEN n % 3 = 0 THEN 'offsets_differ,' ELSE '' END AS reasons
FROM c WHERE length(t) > 40 AND NOT contains(substr(t, 1, 13), '  ') AND (n % 5 = 0 OR n % 7 = 0 OR n % 11 = 0 OR n % 3 = 0)
""")
def claim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as posts, a span of ten characters as evidence; some offsets, hashes and addresses are broken."""
    n = F.col("conv_id") * 100 + F.col("turn")
    rows = table(spark, sf_dir, "conversations").select(n.alias("n"), T.canonical(F.col("text")).alias("post_content")).where("length(post_content) > 40")
    span = F.substring("post_content", 4, 10)
    return claims.evidence_violations(rows.select(
        F.col("n").cast("string").alias("ykien_id"), "post_content", span.alias("evidence_span"), span.alias("claim_text"), F.when(F.col("n") % 3 == 0, 2).otherwise(3).alias("evidence_start"), F.when(F.col("n") % 3 == 0, 13).otherwise(13).alias("evidence_end"), F.when(F.col("n") % 5 > 0, "u").alias("canonical_url"), F.lit("k").alias("legal_anchor_id"),
        F.when(F.col("n") % 7 == 0, "short").when(F.col("n") % 11 == 0, "0" * 64).otherwise(F.sha2("post_content", 256)).alias("content_hash"),
    )).select("ykien_id", F.concat(F.array_join("reasons", ","), F.lit(",")).alias("reasons"))


@found.add(r"""
SELECT 'post-' || substr(sha256(CASE event_type WHEN 'click' THEN 'news' WHEN 'view' THEN 'youtube' WHEN 'error' THEN 'forum' ELSE 'facebook' END || '|' || CAST(event_id AS VARCHAR)), 1, 24) AS content_id,
       CASE event_type WHEN 'click' THEN 'news' WHEN 'view' THEN 'video' WHEN 'error' THEN 'forum' ELSE 'social_post' END AS source_type, sha256('a ' || event_type) AS content_hash, round(least(1.0, (greatest(0, value * 100) + event_id % 50) / 10000), 9) AS engagement_score FROM events
""")
def claim_content_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    posts = table(spark, sf_dir, "events").select(
        F.when(kind == "click", "news").when(kind == "view", "youtube").when(kind == "error", "forum").otherwise("facebook").alias("platform"), F.col("event_id").cast("string").alias("external_id"), F.concat(F.lit(" a  "), kind, F.lit("\n")).alias("text"), F.col("ts").alias("published"), (F.col("value") * 100).alias("likes"), (F.col("event_id") % 50).alias("comments"), F.lit(-5).alias("shares")
    )
    return claims.content_items(posts).select("content_id", "source_type", "content_hash", F.round("engagement_score", 9).alias("engagement_score"))


@found.add("""
WITH p AS (SELECT o_orderkey AS post_id, o_orderpriority AS topic, o_orderstatus = 'P' AS review FROM orders), c AS (SELECT l_orderkey AS post_id, CASE l_returnflag WHEN 'R' THEN 'mau_thuan' WHEN 'A' THEN 'khong_ro' ELSE 'khop' END AS label FROM lineitem),
v AS (SELECT topic, count(*) AS volume, count(*) FILTER (review) AS needs_review FROM p GROUP BY 1), k AS (SELECT topic, count(*) AS n, count(*) FILTER (label <> 'khop') AS u FROM c JOIN p USING (post_id) WHERE topic <> '5-LOW' GROUP BY 1)
SELECT v.topic, volume, needs_review, round(CASE WHEN n > 0 THEN u / CAST(n AS DOUBLE) ELSE needs_review / CAST(volume AS DOUBLE) END, 9) AS risk FROM v LEFT JOIN k USING (topic)
""")
def claim_topic_clarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as posts of a topic, items as their checks; one topic has none."""
    posts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("post_id"), F.col("o_orderpriority").alias("topic"), (F.col("o_orderstatus") == "P").alias("needs_review"))
    flag = F.col("l_returnflag")
    checks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("post_id"), F.when(flag == "R", "mau_thuan").when(flag == "A", "khong_ro").otherwise("khop").alias("label"))
    checks = checks.join(posts.where("topic <> '5-LOW'").select("post_id"), "post_id", "left_semi")
    return claims.topic_clarity(posts, checks).withColumn("risk", F.round("risk", 9))


@found.add(_LAW + f"""
, f AS (SELECT * FROM p WHERE effective_from <= DATE '{LATER}' AND (effective_to IS NULL OR DATE '{LATER}' < effective_to))
SELECT p.number AS answer_id, p.provision_id, CASE WHEN f.provision_id IS NULL THEN 'CITATION_NOT_EFFECTIVE' WHEN p.number % 5 = 0 THEN 'CHECKSUM_MISMATCH' WHEN p.number % 7 = 0 THEN 'QUOTE_NOT_FOUND' WHEN p.number % 3 = 0 THEN 'CLAIM_NOT_SUPPORTED' ELSE 'VALID' END AS verdict
FROM p LEFT JOIN f ON f.provision_id = p.provision_id
""")
def claim_citation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each version cited once, with its own text as the claim or another sum; some quotes and checksums are wrong."""
    rows = provisions(spark, sf_dir)
    n = F.col("number")
    cited = rows.select(n.alias("answer_id"), F.lit("c1").alias("claim_id"), F.when(n % 3 == 0, "Phạt 99.999 triệu đồng").otherwise(F.col("text")).alias("claim"), "provision_id", F.when(n % 5 == 0, "0").otherwise(F.col("text_checksum")).alias("text_checksum"), F.when(n % 7 == 0, "không có").otherwise(F.substring("text", 1, 12)).alias("quote"))
    return claims.citation_gate(cited, temporal.as_of(rows, LATER)).select("answer_id", "provision_id", "verdict")


@found.add(_LAW + """
SELECT number AS answer_id, CASE WHEN number % 4 = 0 THEN 2::BIGINT ELSE 1::BIGINT END AS n_risky, CASE WHEN number % 3 = 0 THEN 0::BIGINT ELSE 1::BIGINT END AS n_supported,
       (CASE WHEN number % 3 = 0 THEN 0 ELSE 1 END) / CAST(CASE WHEN number % 4 = 0 THEN 2 ELSE 1 END AS DOUBLE) AS score FROM p
""")
def claim_faithfulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that repeat a version's text or change its sum, and in one of four claim more."""
    n = F.col("number")
    rows = provisions(spark, sf_dir).select(n.alias("answer_id"), F.col("text").alias("premise"), F.when(n % 3 == 0, "Phạt 99.999 triệu đồng").otherwise(F.col("text")).alias("claim"))
    more = rows.where("answer_id % 4 = 0").select("answer_id", "premise", F.lit("phải nộp thêm 88.888 triệu đồng").alias("claim"))
    return claims.faithfulness(rows.unionByName(more))


# Contracts and writes --------------------------------------------------------------------------------------------------


@found.add(_LAW + """
, x AS (SELECT number AS answer_id, CASE WHEN number % 3 = 0 THEN 'citation_not_in_force,' ELSE '' END || CASE WHEN number % 5 = 0 THEN 'claim_not_entailed,' ELSE '' END || CASE WHEN number % 7 = 0 THEN 'not_reciprocal,' ELSE '' END || CASE WHEN number % 13 = 0 THEN 'unknown_citation,' ELSE '' END
                           || CASE WHEN number % 11 = 0 THEN 'unknown_claim,' ELSE '' END AS reasons FROM p)
SELECT answer_id, reasons FROM x WHERE reasons <> ''
""")
def contract_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One answer a version, with a claim and a citation of it; dates, support and the mapping between both are broken in some."""
    rows = provisions(spark, sf_dir).withColumn("answer_id", F.col("number"))
    n = F.col("number")
    answers = rows.select("answer_id", F.lit("answered").alias("status"), F.when(n % 3 == 0, F.date_sub("effective_from", 1)).otherwise(F.col("effective_from")).alias("as_of"), F.lit("text").alias("answer"), F.lit(None).cast("string").alias("reason_code"))
    mark = lambda k, name: F.when(n % k == 0, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    made = rows.select("answer_id", F.lit("c1").alias("claim_id"), F.when(n % 5 == 0, "unknown").otherwise("entailed").alias("support_status"), F.concat(F.when(n % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("q1"))), mark(13, "q9")).alias("citation_ids"))
    cited = rows.select(
        "answer_id", F.lit("q1").alias("citation_id"), F.col("provision_id").alias("node_id"), "lineage_id", "article", "clause", "point", "effective_from", "effective_to", "text_checksum", F.lit(None).cast("string").alias("source_checksum"), F.concat(F.array(F.lit("c1")), mark(11, "c9")).alias("supports_claim_ids")
    )
    return contracts.citation_violations(answers, made, cited).select("answer_id", F.concat(F.array_join("reasons", ","), F.lit(",")).alias("reasons"))


@found.add("""
WITH b AS (SELECT o_orderkey AS batch_id, CASE o_orderstatus WHEN 'O' THEN 'committed' WHEN 'F' THEN 'draft' ELSE 'approved' END AS status, o_orderkey AS n FROM orders),
c AS (SELECT l_orderkey AS batch_id, bool_or(l_partkey % 40 = 0) AS twin, bool_or(l_partkey % 25 = 0 AND l_partkey % 40 > 0) AS undecided, count(*) > count(DISTINCT l_linenumber) AS again FROM lineitem WHERE l_linenumber < 3 GROUP BY 1),
x AS (SELECT b.batch_id, list_filter([CASE WHEN twin THEN 'candidate_of_one_version' END, CASE WHEN again THEN 'candidate_repeated' END, CASE WHEN status <> 'committed' AND n % 6 = 0 THEN 'commit_before_its_time' END, CASE WHEN status = 'committed' AND n % 6 > 0 THEN 'commit_missing' END,
             CASE WHEN undecided THEN 'decision_without_reviewer' END, CASE WHEN status = 'draft' AND n % 5 > 0 THEN 'draft_with_submission' END, CASE WHEN twin IS NULL THEN 'no_candidate' END, CASE WHEN status <> 'draft' AND n % 4 = 0 THEN 'reviewer_missing' END,
             CASE WHEN status <> 'draft' AND n % 5 = 0 THEN 'submission_missing' END], lambda x: x IS NOT NULL) AS reasons FROM b LEFT JOIN c USING (batch_id))
SELECT batch_id, array_to_string(reasons, ',') || ',' AS reasons FROM x WHERE len(reasons) > 0
""")
def contract_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as batches, their first two items as candidates; who acted and when is missing or too early in some."""
    n = F.col("o_orderkey")
    when = lambda k, v: F.when(n % k > 0, v)
    day = F.col("o_orderdate").cast("string")
    batches = table(spark, sf_dir, "orders").select(
        n.alias("batch_id"), F.when(F.col("o_orderstatus") == "O", "committed").when(F.col("o_orderstatus") == "F", "draft").otherwise("approved").alias("status"), when(5, F.lit("s")).alias("submitted_by"), when(5, day).alias("submitted_at"), when(4, F.lit("r")).alias("reviewed_by"), when(4, day).alias("reviewed_at"),
        *[F.when(n % 6 == 0, F.lit("k")).alias(c) for c in ("commit_key", "committed_by", "committed_at", "commit_result")],
    )
    p = F.col("l_partkey")
    candidates = table(spark, sf_dir, "lineitem").where("l_linenumber < 3").select(
        F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("candidate_id"), p.alias("old_provision_id"), F.when(p % 40 == 0, p).otherwise(p + 1).alias("new_provision_id"), F.lit("MODIFIED").alias("change_type"), F.when((p % 25 == 0) & (p % 40 > 0), "accepted").otherwise("pending").alias("decision"),
        F.lit(None).cast("string").alias("reviewed_by"), F.lit(None).cast("string").alias("reviewed_at"),
    )
    return contracts.review_violations(batches, candidates).select("batch_id", F.concat(F.array_join("reasons", ","), F.lit(",")).alias("reasons"))


@found.add("""
SELECT page_id, CASE page_id % 10 WHEN 1 THEN FALSE WHEN 2 THEN FALSE WHEN 3 THEN FALSE WHEN 4 THEN FALSE WHEN 5 THEN FALSE WHEN 6 THEN FALSE WHEN 7 THEN TRUE ELSE regexp_matches(url, '^https?://[^/?#]+') END AS ok FROM pages
""")
def contract_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' own addresses, and local, private and odd ones."""
    odd = {1: "http://localhost/x", 2: "ftp://a.org/", 3: "https://user:pw@a.org/", 4: "http://192.168.1.4/", 5: "http://a.org:8080/", 6: "http://db.internal/", 7: "HTTPS://8.8.8.8:443/x"}
    url = F.col("url")
    for k, v in odd.items():
        url = F.when(F.col("page_id") % 10 == k, v).otherwise(url)
    return table(spark, sf_dir, "pages").select("page_id", contracts.public_url(url).alias("ok"))


@found.add("""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 2 THEN 'string' WHEN 3 THEN 'number' WHEN 4 THEN 'null' END AS kind, event_id % 6 = 1 AND event_id % 4 = 1 AS cited, event_id % 3 <> 1 AS visible FROM events
""")
def contract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    url = F.concat(F.lit("u"), (e % 4).cast("string"))
    value = F.when(e % 6 == 0, F.lit('{"a": 1}')).when(e % 6 == 1, F.concat(F.lit('[{"source_url": "'), url, F.lit('", "x": 2}]'))).when(e % 6 == 2, F.lit('"s"')).when(e % 6 == 3, F.lit("1.5")).when(e % 6 == 4, F.lit("null")).otherwise(F.lit("{broken"))
    seen = F.when(e % 3 == 1, "internal").when(e % 3 == 2, "public")
    return table(spark, sf_dir, "events").select("event_id", contracts.json_kind(value).alias("kind"), contracts.cites_url(value, F.lit("u1")).alias("cited"), contracts.publicly_visible(seen).alias("visible"))


@found.add("""SELECT event_id, sha256('{"a":' || CAST(event_id % 5 AS VARCHAR) || ',"b":"đ","c":[1,2]}') AS hash FROM events""")
def contract_json_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same request with its keys in another order and other blanks."""
    a = (F.col("event_id") % 5).cast("string")
    text = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"c": [1, 2], "b": "\\u0111",  "a": '), a, F.lit("}"))).otherwise(F.concat(F.lit('{"b":"đ","a":'), a, F.lit(',"c":[1,2]}')))
    return table(spark, sf_dir, "events").select("event_id", contracts.canonical_json_hash(text).alias("hash"))


@found.add(r"""
SELECT conv_id AS id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS n, 'T' || CAST(turn AS VARCHAR) AS key, trim(regexp_replace(translate(text, '[]', '()'), '\s+', ' ', 'g')) AS passage FROM conversations
""")
def contract_context_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as '[key] passage' lines, and read again."""
    line = F.concat(F.lit("[T"), F.col("turn").cast("string"), F.lit("] "), F.translate("text", "[]", "()"))
    texts = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return contracts.context_rows(texts)


@found.add("""
WITH p AS (SELECT doc_id, lower(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' || upper(source) || ' ' WHEN doc_id % 3 = 1 THEN source END)) AS slug FROM documents), e AS (SELECT doc_id, slug FROM p WHERE slug <> '')
SELECT doc_id AS post_id, slug, CASE WHEN doc_id % 7 = 0 THEN 'model' ELSE 'backfill_source_topic' END AS model FROM e
""")
def write_topic_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as posts whose source is a topic, written one way or another; one in seven is linked already."""
    d = F.col("doc_id")
    posts = table(spark, sf_dir, "documents").select(d.alias("post_id"), F.when(d % 3 == 0, F.concat(F.lit(" "), F.upper("source"), F.lit(" "))).alias("topic"), F.when(d % 3 == 1, F.col("source")).alias("source_topic"))
    known = posts.where("post_id % 7 = 0").select("post_id", F.lower(F.trim(F.coalesce("topic", "source_topic"))).alias("slug"), F.lit(0.5).alias("score"), F.lit("model").alias("model"), F.lit("classified").alias("status")).where("slug <> ''")
    return writes.linked_topics(posts, known).select("post_id", "slug", "model")


@found.add("""
SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN TIMESTAMP '2020-01-01' ELSE TIMESTAMP '2026-01-01' END AS created_at, TIMESTAMP '2026-01-01' AS updated_at,
       CASE WHEN n_nationkey % 2 = 0 THEN CASE WHEN n_nationkey % 3 = 0 AND n_nationkey % 4 = 0 THEN TIMESTAMP '2021-01-01' ELSE TIMESTAMP '2026-01-01' END END AS archived_at FROM nation
""")
def write_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    at = lambda t: F.lit(t).cast("timestamp")
    new = table(spark, sf_dir, "nation").select(n.alias("id"), F.when(n % 2 == 0, "archived").otherwise("open").alias("status"))
    old = new.where("id % 3 = 0").select("id", at("2020-01-01").alias("created_at"), F.when(F.col("id") % 4 == 0, at("2021-01-01")).alias("archived_at"))
    return writes.stamped(old, new, "id", "2026-01-01").drop("status")


@found.add("""
SELECT 'audit-' || substr(sha256('u' || CAST(o_custkey % 9 AS VARCHAR) || '|publish_brief|' || CAST(o_orderkey AS VARCHAR) || '|2026-01-01'), 1, 24) AS audit_id, CASE WHEN o_custkey % 9 < 7 THEN 'u' || CAST(o_custkey % 9 AS VARCHAR) || '@x' END AS email, CAST(o_orderkey AS VARCHAR) AS resource_id FROM orders WHERE o_orderstatus = 'P'
""")
def write_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publications, written twice, once each in the log; two of the nine users are gone."""
    user = F.concat(F.lit("u"), (F.col("o_custkey") % 9).cast("string"))
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(user.alias("actor"), F.lit("publish_brief").alias("action"), F.col("o_orderkey").cast("string").alias("resource_id"), F.lit("{}").alias("detail"))
    users = spark.range(7).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("user_id"), F.lit("r").alias("role")).withColumn("email", F.concat("user_id", F.lit("@x")))
    return writes.audit_view(writes.audit_entries(done.union(done), "2026-01-01"), users).select("audit_id", "email", "resource_id")


@found.add("""
WITH w AS (SELECT p_partkey AS khoan_id, p_partkey % 3 AS k, unnest(list_distinct(string_split(p_name, ' '))) AS mo_ta FROM part)
SELECT khoan_id, CASE k WHEN 0 THEN 'nghia_vu' ELSE 'che_tai' END AS category, mo_ta, CASE k WHEN 0 THEN 'CO_NGHIA_VU' ELSE 'CO_CHE_TAI' END AS edge FROM w WHERE k < 2 AND trim(mo_ta) <> ''
""")
def write_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of names as what a clause is about; a third are of an unknown category."""
    k = F.col("p_partkey") % 3
    category = F.when(k == 0, "nghia_vu").when(k == 1, "che_tai").otherwise("khac")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("khoan_id"), F.create_map(category, F.concat(F.split("p_name", " "), F.array(F.lit(" ")))).alias("entities"))
    return writes.entity_rows(rows)[0]


@found.add("SELECT DISTINCT o_custkey AS src, o_orderkey % 2000 AS dst FROM orders WHERE o_orderkey % 2000 IN (SELECT c_custkey FROM customer)")
def write_known_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 2000).alias("to"))
    return writes.edges_to_known(rows, "o_custkey", "to", table(spark, sf_dir, "customer"), "c_custkey")


@found.add("SELECT p_partkey, CASE WHEN p_size <= 20 THEN 'inserted' WHEN p_partkey % 4 = 0 THEN 'conflict' ELSE 'replayed' END AS outcome FROM part")
def write_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return writes.replayed(part.where("p_size > 20").withColumn("p_name", F.when(F.col("p_partkey") % 4 == 0, "other").otherwise(F.col("p_name"))), part, "p_partkey", ["p_name", "p_size"])


@found.add("""
WITH a AS (SELECT c_nationkey AS id, count(*) AS n FROM customer WHERE c_nationkey % 3 = 0 GROUP BY 1), b AS (SELECT s_nationkey AS id, count(*) AS n FROM supplier GROUP BY 1)
SELECT n_nationkey AS id, CASE WHEN coalesce(a.n, 0) > 0 THEN a.n ELSE coalesce(b.n, 0) END AS n FROM nation LEFT JOIN a ON a.id = n_nationkey LEFT JOIN b ON b.id = n_nationkey
""")
def write_fallback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = table(spark, sf_dir, "customer").where("c_nationkey % 3 = 0").select(F.col("c_nationkey").alias("id"))
    named = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id"))
    return writes.count_or_named(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")), linked, named, "id")


@found.add(_LAW + """
, q AS (SELECT DISTINCT logical_vb_id AS asked FROM p UNION SELECT provision_id FROM p WHERE number % 10 = 0 UNION SELECT DISTINCT lineage_id FROM p WHERE number % 15 = 0)
SELECT q.asked, p.provision_id AS node FROM q JOIN p ON q.asked = p.provision_id OR q.asked = p.lineage_id OR q.asked = p.logical_vb_id
""")
def write_identity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions by their id, their lineage, or the number of the document above them."""
    rows = provisions(spark, sf_dir)
    ten, fifteen = rows.where("number % 10 = 0"), rows.where("number % 15 = 0")
    asked = rows.select(F.col("logical_vb_id").alias("asked")).union(ten.select("provision_id")).union(fifteen.select("lineage_id")).distinct()
    return writes.by_alias(rows.withColumn("node", F.col("provision_id")), ["provision_id", "lineage_id"], asked)


@found.add("""
SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 1 DAY END) AS shown, strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' AS indexed, strftime(o_orderdate, '%Y-%m-%d') AS day
FROM orders ORDER BY shown DESC NULLS LAST, o_orderkey LIMIT 500
""")
def write_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five hundred newest by the first date they have: a page."""
    n = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(n, F.when(n % 2 == 0, F.col("o_orderdate")).alias("a"), F.when(n % 3 == 0, F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("b"), writes.index_time(F.col("o_orderdate")).alias("indexed"), writes.iso_day(F.col("o_orderdate")).alias("day"))
    return writes.newest_first(rows, ["a", "b"], "o_orderkey").limit(500).select("o_orderkey", F.coalesce("a", "b").alias("shown"), "indexed", "day")


@found.add(r"""
SELECT event_id, array_to_string(list_filter(regexp_extract_all(lower('Không phạt 1.000,5 đồng ' || event_type || ' chưa 7'), '\d+(?:[.,]\d+)*|[\p{L}\p{N}]+'), lambda x: TRUE), ' ') AS normalized, '1.000,5 7' AS numbers, 'chưa không' AS negations FROM events
""")
def claim_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims as they are compared, with their numbers and denials."""
    text = F.concat(F.lit("Không phạt 1.000,5 đồng "), F.col("event_type"), F.lit(" chưa 7"))
    plain = arrow.normalized_claim_nfkc(text)
    rows = table(spark, sf_dir, "events").select("event_id", plain.alias("normalized"))
    marks = T.claim_signatures(F.col("normalized"))
    return rows.select("event_id", "normalized", F.array_join(marks["numbers"], " ").alias("numbers"), F.array_join(marks["negations"], " ").alias("negations"))


@found.add("SELECT k, n FROM (SELECT CASE WHEN o_orderkey % 4 > 0 THEN o_custkey END AS k, count(*) AS n FROM orders GROUP BY 1) WHERE k IS NOT NULL AND n > 1")
def write_repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a unique index on what is not null would refuse."""
    rows = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 4 > 0, F.col("o_custkey")).alias("k"))
    return snapshots.repeated_keys(rows, ["k"])


@found.add("SELECT page_id, CASE page_id % 5 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN FALSE WHEN 3 THEN TRUE ELSE FALSE END AS article FROM pages")
def contract_article_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of a host's articles, of its lists, of other hosts, of a host below it, and of another section."""
    shapes = ("https://news.vn/tin-tuc/a/b-{}", "https://news.vn/tin-tuc/", "https://othernews.vn/tin-tuc/a/b", "http://m.news.vn/tin-tuc/x/y?p=1", "https://news.vn/van-ban/a/b")
    url = F.element_at(F.array(*map(F.lit, shapes)), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", files.article_url(url, "news.vn", "/tin-tuc/").alias("article"))


@found.add("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS batch FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 2 = 0")
def write_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection of even points, written over by those divisible by three."""
    e = table(spark, sf_dir, "embeddings")
    old = e.where("vec_id % 2 = 0").select("vec_id", "embedding", F.lit("old").alias("batch"))
    return retrieval.upsert_vectors(old, e.where("vec_id % 3 = 0").select("vec_id", "embedding", F.lit("new").alias("batch")), "vec_id", "embedding", 64).select("vec_id", "batch")
