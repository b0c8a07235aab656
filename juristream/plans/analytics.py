"""Claims, alerts, evaluation and event-time queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from juristream.functions import text as T
from juristream.operators import amendment, claims, evaluation
from juristream.plans.common import Collected, table
from juristream.streaming import events as stream

found = Collected()
QUERIES, ORACLES = found.queries, found.oracles


@found.add("""
WITH g AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type IN ('error', 'signup')) AS n_unclear FROM events GROUP BY 1 HAVING count(*) >= 3)
SELECT user_id, n, n_unclear, n_unclear / n AS risk, round((n_unclear / n) * ln(n + 1), 9) AS rank_value FROM g
""")
def clarity_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.clarity(table(spark, sf_dir, "events"), "user_id", "event_type", least=3, unclear=("error", "signup"))


@found.add("""
SELECT user_id, json_extract_string(props, '$.k') AS k, count(*) AS n, count(DISTINCT event_type) AS kinds
FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 72 HOUR GROUP BY 1, 2
""")
def alert_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("last")).first()["last"]
    recent = events.where(F.col("ts") >= F.lit(last) - F.expr("INTERVAL 72 HOURS"))
    return recent.groupBy("user_id", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"), F.countDistinct("event_type").alias("kinds"))


@found.add("""
WITH d AS (SELECT event_type, json_extract_string(props, '$.k') AS k, user_id, min(event_id) AS first_id, max(value) AS value FROM events GROUP BY 1, 2, 3)
SELECT event_type, k, count(*) AS volume, max(value) AS value, CASE WHEN count(*) >= 15 THEN 'high' WHEN count(*) >= 10 THEN 'medium' ELSE 'low' END AS severity
FROM d GROUP BY 1, 2 HAVING count(*) >= 5
""")
def alert_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    once = events.groupBy("event_type", "k", "user_id").agg(F.min("event_id").alias("first_id"), F.max("value").alias("value"))
    groups = once.groupBy("event_type", "k").agg(F.count("*").alias("volume"), F.max("value").alias("value")).where("volume >= 5")
    return groups.withColumn("severity", claims.volume_severity(F.col("volume"), 5))


@found.add("""
WITH RECURSIVE e AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
r AS (
  SELECT user_id, event_type, event_id, ts, n, ts AS fired, true AS fires FROM e WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.event_type, e.event_id, e.ts, e.n, CASE WHEN e.ts >= r.fired + INTERVAL 12 HOUR THEN e.ts ELSE r.fired END, e.ts >= r.fired + INTERVAL 12 HOUR
  FROM r JOIN e ON e.user_id = r.user_id AND e.event_type = r.event_type AND e.n = r.n + 1
)
SELECT user_id, event_type, event_id FROM r WHERE fires
""")
def alert_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.cooldown(table(spark, sf_dir, "events"), ["user_id", "event_type"], hours=12).select("user_id", "event_type", "event_id")


@found.add("""
WITH m AS (SELECT *, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM m)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, session
""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.sessions(table(spark, sf_dir, "events"), "user_id", hours=6)


@found.add("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def event_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.tumbling(table(spark, sf_dir, "events"), "1 hour").withColumn("total", F.round("total", 2))


@found.add("""
WITH w AS (SELECT unnest(generate_series(time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts), INTERVAL 15 MINUTE)) AS started, event_type FROM events)
SELECT started, event_type, count(*) AS n FROM w GROUP BY 1, 2
""")
def event_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.sliding(table(spark, sf_dir, "events"), "1 hour", "15 minutes")


@found.add("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


_LABELS = """
WITH r AS (SELECT l.doc_id, CAST(l.quality AS VARCHAR) AS expected, CASE WHEN length(d.text) >= 200 AND NOT regexp_matches(d.text, '[#$%*]{2,}') THEN '1' ELSE '0' END AS predicted FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = (F.length("text") >= 200) & ~F.regexp_like("text", F.lit("[#$%*]{2,}"))
    documents = table(spark, sf_dir, "documents").select("doc_id", F.when(good, "1").otherwise("0").alias("predicted"))
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("expected")).join(documents, "doc_id")


@found.add(_LABELS + """
, s AS (
  SELECT expected AS label, CAST(expected = predicted AS INTEGER) AS tp, 0 AS fp, CAST(expected <> predicted AS INTEGER) AS fn FROM r
  UNION ALL SELECT predicted, 0, CAST(expected <> predicted AS INTEGER), 0 FROM r
), g AS (SELECT label, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM s GROUP BY label)
SELECT label, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall,
       CASE WHEN 2 * tp + fp + fn > 0 THEN (2 * tp) / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM g
""")
def gold_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.per_label(judged(spark, sf_dir), "expected", "predicted")


@found.add("""
WITH d AS (SELECT doc_id, lang, source, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INTEGER) AS position FROM documents),
rel AS (SELECT d.lang AS case_id, l.doc_id AS id FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.quality = 1 AND l.toxic = 0),
h AS (SELECT rel.case_id, d.position FROM d JOIN rel ON d.lang = rel.case_id AND d.doc_id = rel.id WHERE d.position <= 10),
g AS (SELECT case_id, count(*) AS hits, min(position) AS first, sum(1 / log2(position + 1)) AS gain FROM h GROUP BY 1),
w AS (SELECT case_id, count(DISTINCT id) AS n FROM rel GROUP BY 1)
SELECT w.case_id, coalesce(hits / n, 0) AS recall, coalesce(1 / first, 0) AS rr, round(coalesce(gain / list_sum(list_transform(generate_series(1, least(n, 10)), lambda i: 1 / log2(i + 1))), 0), 9) AS ndcg
FROM w LEFT JOIN g ON w.case_id = g.case_id
""")
def ir_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    ranked = documents.select(F.col("lang").alias("case_id"), F.col("doc_id").alias("id"), F.row_number().over(w).alias("position")).where("position <= 10")
    good = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")
    relevant = documents.join(good, "doc_id").select(F.col("lang").alias("case_id"), F.col("doc_id").alias("id"))
    return evaluation.ranking(relevant, ranked, 10)


@found.add("""
WITH r AS (SELECT d.lang AS e, d.source AS p FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
b AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT count(*) AS n FROM r GROUP BY e, p)),
x AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT count(*) AS n FROM r GROUP BY e)),
y AS (SELECT sum(n * (n - 1) / 2) AS v FROM (SELECT count(*) AS n FROM r GROUP BY p))
SELECT CAST(b.v AS BIGINT) AS both, CAST(x.v AS BIGINT) AS expected_pairs, CAST(y.v AS BIGINT) AS predicted_pairs, b.v / y.v AS precision, b.v / x.v AS recall, 2 * b.v / (x.v + y.v) AS f1 FROM b, x, y
""")
def cluster_pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return evaluation.pairwise_clusters(table(spark, sf_dir, "labels").select("doc_id").join(documents, "doc_id"), "lang", "source")


@found.add("""
WITH n AS (SELECT p_type, p_name, min(p_partkey) AS id FROM part GROUP BY 1, 2),
t AS (SELECT *, string_split(p_name, ' ') AS w FROM n),
s AS (
  SELECT a.p_type AS document, a.id AS old_id, b.id AS new_id, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS score
  FROM t a JOIN t b ON a.p_type = b.p_type AND a.id < b.id AND a.id % 2 = 0 AND b.id % 2 = 1
), k AS (SELECT * FROM s WHERE score >= 0.3)
SELECT document, old_id, new_id, score FROM k
WHERE NOT EXISTS (SELECT 1 FROM k x WHERE x.document = k.document AND x.old_id = k.old_id AND (x.score > k.score OR (x.score = k.score AND x.new_id < k.new_id)))
  AND NOT EXISTS (SELECT 1 FROM k x WHERE x.document = k.document AND x.new_id = k.new_id AND (x.score > k.score OR (x.score = k.score AND x.old_id < k.old_id)))
""")
def join_theta_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first round of the greedy pairing: pairs that are each other's best. Pairs meet at a shared word, never at the group alone."""
    names = table(spark, sf_dir, "part").groupBy("p_type", "p_name").agg(F.min("p_partkey").alias("id"))
    words = names.withColumn("w", F.split("p_name", " ")).withColumn("term", F.explode(F.array_distinct("w")))
    a = words.where("id % 2 = 0").select("p_type", "term", F.col("id").alias("old_id"), F.col("w").alias("old_w"))
    b = words.where("id % 2 = 1").select("p_type", "term", F.col("id").alias("new_id"), F.col("w").alias("new_w"))
    met = a.join(b, ["p_type", "term"]).where("old_id < new_id").groupBy("p_type", "old_id", "new_id").agg(F.any_value("old_w").alias("old_w"), F.any_value("new_w").alias("new_w"))
    scored = met.select(F.col("p_type").alias("document"), "old_id", "new_id", T.jaccard(F.col("old_w"), F.col("new_w")).alias("score")).where("score >= 0.3")
    order = [F.desc("score"), F.col("old_id"), F.col("new_id")]
    w = lambda side: Window.partitionBy("document", side).orderBy(*order)
    return scored.withColumn("l", F.row_number().over(w("old_id"))).withColumn("r", F.row_number().over(w("new_id"))).where("l = 1 AND r = 1").drop("l", "r")


@found.add("""
WITH RECURSIVE n AS (SELECT p_type, p_name, min(p_partkey) AS id FROM part GROUP BY 1, 2), t AS (SELECT *, string_split(p_name, ' ') AS w FROM n),
s AS (SELECT a.p_type AS document, a.id AS l, b.id AS r, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS score FROM t a JOIN t b ON a.p_type = b.p_type AND a.id % 2 = 0 AND b.id % 2 = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY score DESC, l, r) AS n FROM s WHERE score >= 0.3),
walk AS (
  SELECT document, 0::BIGINT AS n, CAST([] AS BIGINT[]) AS ls, CAST([] AS BIGINT[]) AS rs, FALSE AS taken, 0::BIGINT AS l, 0::BIGINT AS r, 0.0::DOUBLE AS score FROM (SELECT DISTINCT document FROM k)
  UNION ALL
  SELECT w.document, k.n, CASE WHEN free THEN list_append(ls, k.l) ELSE ls END, CASE WHEN free THEN list_append(rs, k.r) ELSE rs END, free, k.l, k.r, k.score
  FROM (SELECT w.*, k.n AS next, NOT list_contains(w.ls, k.l) AND NOT list_contains(w.rs, k.r) AS free FROM walk w JOIN k ON k.document = w.document AND k.n = w.n + 1) w JOIN k ON k.document = w.document AND k.n = w.next
)
SELECT document, l AS old_provision_id, r AS new_provision_id, score FROM walk WHERE taken
""")
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole greedy pairing over the same pairs: in SQL, as the walk over them that it stands for."""
    names = table(spark, sf_dir, "part").groupBy("p_type", "p_name").agg(F.min("p_partkey").alias("id"))
    words = names.withColumn("w", F.split("p_name", " ")).withColumn("term", F.explode(F.array_distinct("w")))
    a = words.where("id % 2 = 0").select("p_type", "term", F.col("id").alias("old_provision_id"), F.col("w").alias("old_w"))
    b = words.where("id % 2 = 1").select("p_type", "term", F.col("id").alias("new_provision_id"), F.col("w").alias("new_w"))
    met = a.join(b, ["p_type", "term"]).groupBy("p_type", "old_provision_id", "new_provision_id").agg(F.any_value("old_w").alias("old_w"), F.any_value("new_w").alias("new_w"))
    scored = met.select(F.col("p_type").alias("document"), "old_provision_id", "new_provision_id", T.jaccard(F.col("old_w"), F.col("new_w")).alias("score")).where("score >= 0.3")
    return amendment.greedy_pairs(scored)
