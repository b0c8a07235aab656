"""Queries that keep tables in order: parity, steps, timelines, cascades, compare-and-set, inventories, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from juristream.functions import dialogue
from juristream.functions import text as T
from juristream.operators import claims, evaluation, graph, reports, snapshots
from juristream.operators.temporal import transitions
from juristream.plans.common import Collected, table
from juristream.plans.temporal import _V, NAMES, versions

found = Collected()
QUERIES, ORACLES = found.queries, found.oracles


@found.add("""
WITH a AS (SELECT p_partkey AS id, md5(p_name) AS c FROM part WHERE p_size <= 40),
b AS (SELECT p_partkey AS id, md5(CASE WHEN p_partkey % 10 = 0 THEN upper(p_name) ELSE p_name END) AS c FROM part WHERE p_size > 5 UNION ALL SELECT p_partkey, md5(p_name) FROM part WHERE p_partkey % 50 = 7 AND p_size > 5),
l AS (SELECT id, count(*) AS n, min(c) AS c FROM a GROUP BY 1), r AS (SELECT id, count(*) AS n, min(c) AS c FROM b GROUP BY 1)
SELECT coalesce(l.id, r.id) AS id, CASE WHEN l.n > 1 OR r.n > 1 THEN 'repeated' WHEN r.id IS NULL THEN 'left_only' WHEN l.id IS NULL THEN 'right_only' WHEN l.c = r.c THEN 'same' ELSE 'differs' END AS state
FROM l FULL JOIN r ON l.id = r.id
""")
def store_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    a = part.where("p_size <= 40").select(F.col("p_partkey").alias("id"), F.md5("p_name").alias("checksum"))
    name = F.when(F.col("p_partkey") % 10 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    b = part.where("p_size > 5").select(F.col("p_partkey").alias("id"), F.md5(name).alias("checksum"))
    again = part.where("p_partkey % 50 = 7 AND p_size > 5").select(F.col("p_partkey").alias("id"), F.md5("p_name").alias("checksum"))
    return evaluation.parity(a, b.unionByName(again))


@found.add("""
WITH m AS (SELECT user_id AS id, event_id AS position, event_type AS status, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT id, position, before, status FROM m WHERE (before IS NULL AND status <> 'draft') OR (before IS NOT NULL AND before || '>' || status NOT IN ('signup>view', 'view>click', 'click>purchase', 'view>error', 'error>view'))
""")
def illegal_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("position"), F.col("event_type").alias("status"))
    return snapshots.illegal_steps(steps, (("signup", "view"), ("view", "click"), ("click", "purchase"), ("view", "error"), ("error", "view")))


@found.add("""
WITH o AS (SELECT user_id AS job_id, ts, event_type FROM events),
g AS (SELECT job_id, string_agg(event_type, '>' ORDER BY ts, event_type) AS timeline, min(ts) AS a, max(ts) AS b FROM o GROUP BY 1)
SELECT job_id, timeline, CAST(floor(epoch(b)) - floor(epoch(a)) AS BIGINT) AS seconds FROM g
""")
def job_timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("status"))
    lines = reports.job_timelines(jobs)
    return lines.select("job_id", F.array_join(F.col("timeline.status"), ">").alias("timeline"), "seconds")


@found.add("SELECT 'N' || c_nationkey || '::C' || c_custkey AS node FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.lit("::C"), F.col("c_custkey").cast("string")).alias("node"))
    roots = table(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("root"))
    return snapshots.delete_cascade(rows, roots, "node")


@found.add("""
SELECT p.p_partkey, CAST(p.p_size + CASE WHEN u.k IS NOT NULL AND u.seen = p.p_size THEN 1 ELSE 0 END AS INTEGER) AS revision, CASE WHEN u.k IS NOT NULL AND u.seen = p.p_size THEN upper(p.p_name) ELSE p.p_name END AS p_name
FROM part p LEFT JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN p_size - 1 ELSE p_size END AS seen FROM part WHERE p_partkey % 2 = 0) u ON u.k = p.p_partkey
""")
def compare_and_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rows = part.select("p_partkey", F.col("p_size").alias("revision"), "p_name")
    seen = F.when(F.col("p_partkey") % 4 == 0, F.col("p_size") - 1).otherwise(F.col("p_size"))
    updates = part.where("p_partkey % 2 = 0").select("p_partkey", seen.alias("revision"), F.upper("p_name").alias("p_name"))
    return snapshots.compare_and_set(rows, updates, "p_partkey")[0]


@found.add("""
WITH s AS (SELECT user_id, count(*) AS n, max(value) AS value FROM events WHERE event_type <> 'error' GROUP BY 1)
SELECT c.c_custkey, greatest(c.c_acctbal, s.value) AS best FROM customer c LEFT JOIN s ON s.user_id = c.c_custkey
""")
def keep_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("best"))
    new = table(spark, sf_dir, "events").where("event_type <> 'error'").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max("value").alias("best"))
    return snapshots.upsert(old, new.join(old.select("c_custkey"), "c_custkey", "left_semi"), ["c_custkey"], largest=("best",))


@found.add("""
WITH e AS (SELECT event_type <> 'error' AS ok, value, value * 1.1::DOUBLE AS base FROM events)
SELECT count(*) AS n, 1 - avg(CAST(ok AS INTEGER)) AS failure_rate, quantile_disc(base, 0.95) AS baseline_p95, quantile_disc(value, 0.5) FILTER (ok) AS p50, quantile_disc(value, 0.95) FILTER (ok) AS p95,
       quantile_disc(value, 0.95) FILTER (ok) / quantile_disc(base, 0.95) AS p95_regression_ratio FROM e
""")
def latency_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((F.col("event_type") != "error").alias("success"), F.col("value").alias("latency_ms"), (F.col("value") * 1.1).alias("baseline_latency_ms"))
    return evaluation.latency(rows)


@found.add("""
WITH m AS (SELECT event_type AS metric, avg(value) AS v FROM events GROUP BY 1),
r AS (SELECT * FROM (VALUES ('click', 'min', 40.0::DOUBLE, 'blocking'), ('error', 'max', 90.0::DOUBLE, 'advisory'), ('absent', 'eq', 1.0::DOUBLE, 'blocking')) t(metric, operator, target, severity))
SELECT r.metric, r.operator, r.target, r.severity, round(m.v, 6) AS value, coalesce(CASE r.operator WHEN 'min' THEN m.v >= r.target WHEN 'max' THEN m.v <= r.target ELSE abs(m.v - r.target) < 1e-12 END, false) AS passed
FROM r LEFT JOIN m ON m.metric = r.metric
""")
def release_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    rules = spark.createDataFrame([("click", "min", 40.0, "blocking"), ("error", "max", 90.0, "advisory"), ("absent", "eq", 1.0, "blocking")], "metric string, operator string, value double, severity string")
    return evaluation.gates(metrics, rules).withColumn("value", F.round("value", 6))


@found.add("""
WITH a AS (SELECT c_mktsegment AS topic, count(DISTINCT o_custkey) AS linked FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment <> 'BUILDING' GROUP BY 1),
b AS (SELECT c_mktsegment AS topic, count(DISTINCT c_custkey) AS named FROM customer GROUP BY 1),
t AS (SELECT DISTINCT c_mktsegment AS topic FROM customer UNION SELECT 'none')
SELECT t.topic, CASE WHEN coalesce(linked, 0) > 0 THEN linked ELSE coalesce(named, 0) END AS n_posts FROM t LEFT JOIN a ON a.topic = t.topic LEFT JOIN b ON b.topic = t.topic
""")
def topic_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("post_id"), F.col("c_mktsegment").alias("topic"))
    links = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("post_id")).join(customers.where("topic <> 'BUILDING'"), "post_id")
    topics = customers.select("topic").distinct().union(spark.createDataFrame([("none",)], "topic string"))
    return claims.topic_popularity(topics, links, customers)


@found.add("""
WITH d AS (SELECT DISTINCT source AS document FROM documents UNION SELECT 'empty-one'),
p AS (SELECT source AS document, CASE lang WHEN 'en' THEN 'dieu' WHEN 'fr' THEN 'khoan' ELSE 'diem' END AS level, trim(text) = '' AS no_text, n_chars < 50 AS no_checksum FROM documents),
g AS (SELECT document, count(*) FILTER (level = 'dieu') AS dieu, count(*) FILTER (level = 'khoan') AS khoan, count(*) FILTER (level = 'diem') AS diem, count(*) FILTER (no_text) AS no_text, count(*) FILTER (no_checksum) AS no_checksum FROM p GROUP BY 1),
r AS (SELECT d.document, coalesce(dieu, 0) AS dieu, coalesce(khoan, 0) AS khoan, coalesce(diem, 0) AS diem, coalesce(no_text, 0) AS no_text, coalesce(no_checksum, 0) AS no_checksum FROM d LEFT JOIN g ON g.document = d.document),
s AS (SELECT document, CAST(sum(dieu) AS BIGINT) AS dieu, CAST(sum(khoan) AS BIGINT) AS khoan, CAST(sum(diem) AS BIGINT) AS diem, CAST(sum(no_text) AS BIGINT) AS no_text, CAST(sum(no_checksum) AS BIGINT) AS no_checksum FROM r GROUP BY ROLLUP (document))
SELECT *, CASE WHEN dieu + khoan + diem = 0 THEN 'empty' WHEN no_text > 0 THEN 'blocked' WHEN no_checksum > 0 THEN 'partial' ELSE 'ready' END AS status FROM s
""")
def migration_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    level = F.when(F.col("lang") == "en", "dieu").when(F.col("lang") == "fr", "khoan").otherwise("diem")
    rows = docs.select(F.col("source").alias("logical_vb_id"), level.alias("level"), "text", F.when(F.col("n_chars") >= 50, "x").alias("text_checksum"), F.lit("2020-01-01").cast("date").alias("effective_from"), F.lit("public").alias("visibility"))
    known = docs.select(F.col("source").alias("document")).distinct().union(spark.createDataFrame([("empty-one",)], "document string"))
    return reports.migration_inventory(known, rows).drop("no_start", "no_visibility")


@found.add("""
SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_type = 'error' THEN 'legal_job' ELSE 'social_job' END AS type, CAST(ts AS DATE) AS created_at FROM events WHERE event_type IN ('error', 'signup')
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 3 = 0 THEN 'post' WHEN o_orderkey % 3 = 1 THEN 'provision' ELSE 'document' END, CAST(o_orderdate AS DATE) FROM orders WHERE o_orderstatus = 'P'
""")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as jobs, orders as nodes."""
    kind = F.col("event_type")
    jobs = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("job_id"), F.when(kind == "error", "legal_ingest").otherwise("social_poll").alias("job_type"), F.to_date("ts").alias("created_at"), kind.isin("error", "signup").alias("needs_review"))
    third = F.col("o_orderkey") % 3
    labels = F.when(third == 0, F.array(F.lit("Item"), F.lit("BaiDang"))).when(third == 1, F.array(F.lit("Khoan"))).otherwise(F.array(F.lit("VanBan")))
    nodes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), labels.alias("labels"), F.to_date("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "P").alias("needs_review"))
    return reports.review_queue(jobs, nodes)


@found.add("""
SELECT user_id, list_aggregate(list_slice(list(event_id ORDER BY ts, event_id), 1, 3), 'string_agg', ',') AS first_three, min(ts) AS first_at, count(DISTINCT json_extract_string(props, '$.k')) AS sources FROM events GROUP BY 1
""")
def ordered_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first three events: the three smallest of each partition go on, not a whole list."""
    events = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    first = events.select("user_id", "event_id", F.row_number().over(w).alias("n")).where("n <= 3").groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "event_id"))), lambda x: x["event_id"].cast("string")), ",").alias("first_three"))
    rest = events.groupBy("user_id").agg(F.min("ts").alias("first_at"), F.countDistinct(F.get_json_object("props", "$.k")).alias("sources"))
    return first.join(rest, "user_id")


@found.add("""
WITH k AS (SELECT upper(replace(c_name, '#', '/')) AS k, max(c_custkey) AS id FROM customer GROUP BY 1),
s AS (SELECT o_orderkey, upper('customer/' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')) AS k FROM orders)
SELECT s.o_orderkey, k.id AS c_custkey FROM s JOIN k ON s.k = k.k
""")
def normalized_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "customer").select(T.document_number(F.replace("c_name", F.lit("#"), F.lit(" / "))).alias("k"), "c_custkey").groupBy("k").agg(F.max("c_custkey").alias("c_custkey"))
    asked = table(spark, sf_dir, "orders").select("o_orderkey", T.document_number(F.concat(F.lit("customer /"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).alias("k"))
    return asked.join(names, "k").select("o_orderkey", "c_custkey")


@found.add(_V + """
, n AS (SELECT o_custkey, count(*) AS n FROM v GROUP BY 1)
SELECT o_orderkey AS node FROM v JOIN n USING (o_custkey) WHERE o_custkey % 5 = 0 AND n >= 3 AND version_no >= 1 AND version_no <= n
""")
def version_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions on a cycle, after every fifth customer's last version (of three or more) was linked back to the first."""
    v = versions(spark, sf_dir)
    edges = transitions(v, NAMES).select(F.col("old_id").alias("src"), F.col("new_id").alias("dst"))
    ends = v.where("o_custkey % 5 = 0").groupBy("o_custkey").agg(F.max_by("o_orderkey", "version_no").alias("src"), F.min_by("o_orderkey", "version_no").alias("dst"), F.count("*").alias("n")).where("n >= 3")
    return graph.on_cycles(edges.union(ends.select("src", "dst")))


@found.add(r"""
SELECT conv_id, turn, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n_chars, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 60) AS quote, 0 AS at FROM conversations WHERE length(trim(regexp_replace(text, '\s+', ' ', 'g'))) > 0
""")
def quotes_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first sixty characters of a turn lie in it."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.canonical(F.col("text")).alias("t")).where("t <> ''")
    found_at = dialogue.locate_quote(F.substring("t", 1, 60), F.col("t"))
    return rows.select("conv_id", "turn", F.length("t").cast("long").alias("n_chars"), F.substring("t", 1, 60).alias("quote"), found_at["start"].alias("at"))
