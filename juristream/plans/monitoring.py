"""Queries over what reports and monitoring do with rows: each of them reads the driver's tables whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juristream.operators import cycles, monitor, reports
from juristream.plans.common import Collected, table
from juristream.streaming import events as stream

found = Collected()
QUERIES, ORACLES = found.queries, found.oracles


@found.add("""
SELECT 'documents' AS metric, count(*) AS value FROM documents UNION ALL SELECT 'documents_in_review', count(*) FILTER (WHERE n_chars < 100) FROM documents
UNION ALL SELECT 'posts', count(*) FROM pages UNION ALL SELECT 'posts_in_review', count(*) FILTER (WHERE length(html) < 500) FROM pages
UNION ALL SELECT 'alerts_open', count(*) FILTER (WHERE o_orderstatus = 'O') FROM orders UNION ALL SELECT 'alerts_high', count(*) FILTER (WHERE o_orderstatus = 'O' AND o_totalprice >= 150000) FROM orders
UNION ALL SELECT 'jobs_queued', count(*) FILTER (WHERE event_type = 'view') FROM events UNION ALL SELECT 'jobs_running', count(*) FILTER (WHERE event_type = 'click') FROM events UNION ALL SELECT 'jobs_failed', count(*) FILTER (WHERE event_type NOT IN ('view', 'click')) FROM events
UNION ALL SELECT 'briefs_draft', count(*) FILTER (WHERE role = 'user') FROM conversations UNION ALL SELECT 'briefs_published', count(*) FILTER (WHERE role <> 'user') FROM conversations
""")
def report_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of five tables by state; critical alerts are high ones too."""
    documents = table(spark, sf_dir, "documents").select(F.when(F.col("n_chars") < 100, "needs_review").otherwise("ready").alias("review_status"))
    posts = table(spark, sf_dir, "pages").select((F.length("html") < 500).alias("needs_review"))
    severity = F.when(F.col("o_totalprice") >= 300_000, "critical").when(F.col("o_totalprice") >= 150_000, "high").otherwise("low")
    alerts = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "O", "open").otherwise("closed").alias("status"), severity.alias("severity"))
    jobs = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "running").otherwise("failed").alias("status"))
    briefs = table(spark, sf_dir, "conversations").select(F.when(F.col("role") == "user", "draft").otherwise("published").alias("status"))
    return reports.dashboard(documents, posts, alerts, jobs, briefs)


@found.add("SELECT CAST(l_orderkey AS VARCHAR) AS document FROM lineitem GROUP BY 1 HAVING count(*) = 1 AND min(l_returnflag) = 'R'")
def report_fallback_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, their lines as articles: those with a single one that bears a given title."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("logical_vb_id"), F.lit("dieu").alias("level"), F.col("l_returnflag").alias("text"))
    return reports.fallback_documents(rows, "R")


@found.add("SELECT o_orderkey, o_orderdate FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '1998-01-01' - INTERVAL 365 DAY")
def report_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders past a retention of a year."""
    return reports.expired(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", 365, "1998-01-01")


@found.add(r"""
WITH s AS (SELECT *, substring(text, 3, 9) AS span FROM documents),
m AS (
  SELECT CAST(doc_id AS VARCHAR) AS ykien_id, concat_ws(' ', CASE WHEN trim(coalesce(lang, '')) = '' THEN 'bai_dang_id' END, CASE WHEN trim(coalesce(text, '')) = '' THEN 'claim_text' END, CASE WHEN trim(coalesce(span, '')) = '' THEN 'evidence_span' END,
    CASE WHEN trim(coalesce(source, '')) = '' THEN 'post_url' END, CASE WHEN doc_id % 3 = 0 THEN 'content_hash' END, CASE WHEN NOT coalesce(contains(text, span), false) THEN 'evidence_not_in_post' END) AS missing
  FROM s
)
SELECT * FROM m WHERE missing <> ''
""")
def monitor_provenance_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What documents lack to be signals; every third one's hash is cut short."""
    digest = F.when(F.col("doc_id") % 3 == 0, F.lit("abc")).otherwise(F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("bai_dang_id"), F.col("doc_id").cast("string").alias("ykien_id"), F.col("text").alias("claim_text"), F.substring("text", 3, 9).alias("evidence_span"), F.col("source").alias("post_url"), F.lit("k").alias("khoan_id"), digest.alias("content_hash"), F.col("text").alias("post_content"))
    return monitor.provenance_gaps(rows).select("ykien_id", F.array_join("missing", " ").alias("missing"))


@found.add("SELECT event_id, value >= 70 OR (event_type = 'view' AND value >= 0.1) AS counts FROM events")
def monitor_score_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events' values would count as signals' scores, if views wait for review."""
    return table(spark, sf_dir, "events").select("event_id", monitor.score_counts(F.col("value"), F.col("event_type") == "view", 70.0).alias("counts"))


@found.add("SELECT doc_id, lower(trim(regexp_replace(coalesce(source, ''), '\\s+', ' ', 'g'))) AS slug FROM documents")
def monitor_topic_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", monitor.topic_slug(F.col("source")).alias("slug"))


@found.add("SELECT user_id, min_by(event_type, (ts, event_id)) AS event_type, min(event_id) FILTER (WHERE n = 1) AS event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) GROUP BY user_id")
def event_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first event."""
    return stream.first_seen(table(spark, sf_dir, "events"), ["user_id"]).select("user_id", "event_type", "event_id")


@found.add("""
WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_suppkey < l_partkey), seeds AS (SELECT DISTINCT src AS origin FROM e WHERE src <= 3),
r AS (SELECT origin, dst AS node FROM seeds JOIN e ON e.src = origin UNION SELECT r.origin, e.dst FROM r JOIN e ON e.src = r.node)
SELECT origin, node FROM r
""")
def graph_reach_of_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three nodes lead to."""
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).where("src < dst")
    return cycles.reachable_from(edges, edges.where("src <= 3").select(F.col("src").alias("node")))
