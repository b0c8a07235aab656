"""Relational queries over the driver's tables: joins, aggregates, sets, paging, writes as snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from juristream.functions import text as T
from juristream.operators import amendment, evaluation, reports, snapshots
from juristream.plans.common import Collected, table

found = Collected()
QUERIES, ORACLES = found.queries, found.oracles


@found.add("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left_semi")


@found.add("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(urgent, "c_custkey", "left_anti")


@found.add("""
SELECT c_custkey, count(o_orderkey) AS n_orders, count(o_orderkey) FILTER (o_orderstatus = 'O') AS n_open
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey
""")
def join_left_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Counted before the join: it then carries one row per customer.
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(n, "c_custkey", "left").na.fill(0)


@found.add("""
WITH e AS (SELECT l_suppkey AS batch_id, count(*) AS n_edges, 'k' || CAST(l_suppkey % 7 AS VARCHAR) AS key FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
b AS (SELECT s_suppkey + 2 AS batch_id, CASE WHEN s_suppkey % 3 = 0 THEN 'draft' ELSE 'committed' END AS status, 'k' || CAST((s_suppkey + 2) % 7 + CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS commit_key, coalesce(n, 0) AS expected
      FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 4 > 0 GROUP BY 1) c ON c.l_suppkey = s_suppkey + 2)
SELECT coalesce(e.batch_id, b.batch_id) AS batch_id,
       CASE WHEN status IS NULL THEN 'graph_without_batch' WHEN status = 'committed' AND n_edges IS NULL THEN 'committed_without_graph' WHEN status <> 'committed' AND n_edges IS NOT NULL THEN 'graph_before_commit'
            WHEN n_edges IS NULL THEN 'nothing_to_do' WHEN key IS DISTINCT FROM commit_key THEN 'key_mismatch' WHEN n_edges <> expected THEN 'count_mismatch' ELSE 'consistent' END AS code
FROM e FULL JOIN b ON e.batch_id = b.batch_id
""")
def join_full_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' returned items as evidence of commits, against batches that are shifted, mislabelled and miscounted here and there."""
    items = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_suppkey").agg(F.count("*").alias("n_edges"))
    key = lambda c: F.concat(F.lit("k"), c.cast("string"))
    evidence = items.select(F.col("l_suppkey").alias("batch_id"), "n_edges", key(F.col("l_suppkey") % 7).alias("key"))
    s = F.col("s_suppkey")
    known = items.where("l_suppkey % 4 > 0").select(F.col("l_suppkey").alias("batch_id"), F.col("n_edges").alias("n"))
    batches = table(spark, sf_dir, "supplier").select((s + 2).alias("batch_id"), F.when(s % 3 == 0, "draft").otherwise("committed").alias("status"), key((s + 2) % 7 + F.when(s % 5 == 0, 1).otherwise(0)).alias("commit_key"))
    return amendment.reconcile(evidence, batches.join(known, "batch_id", "left").withColumn("expected", F.coalesce("n", F.lit(0))).drop("n"))


@found.add("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2")
def agg_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@found.add("""
SELECT count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 100) AS large, count(*) FILTER (event_type = 'purchase' AND value > 100) AS large_purchases FROM events
""")
def agg_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    return reports.counters(table(spark, sf_dir, "events"), {"events": F.lit(True), "errors": kind == "error", "large": value > 100, "large_purchases": (kind == "purchase") & (value > 100)})


@found.add("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1")
def agg_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct(F.to_date("ts")).alias("days"))


@found.add("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def agg_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@found.add("""
WITH g AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first_at FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first_at) AS r FROM g)
SELECT user_id, event_type, n FROM r WHERE r = 1
""")
def agg_modal_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.first_seen_mode(table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@found.add("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY 1")
def agg_pctl_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(evaluation.nearest_rank("value", 0.5).alias("p50"), evaluation.nearest_rank("value", 0.95).alias("p95"), F.max("value").alias("most"))


@found.add("SELECT DISTINCT n_nationkey AS id FROM (SELECT c_nationkey AS n_nationkey FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)")
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("id"))
    return a.union(table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("id"))).distinct()


@found.add("SELECT c_nationkey AS id FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("id"))
    return a.intersect(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id")))


@found.add("SELECT p_size AS id FROM part EXCEPT SELECT s_nationkey FROM supplier")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_size").alias("id")).subtract(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("id")))


@found.add("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return reports.page(rows, [F.desc("o_totalprice"), F.col("o_orderkey")], offset=100, limit=50)


@found.add("SELECT o_orderkey, o_orderstatus FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100) WHERE o_orderstatus = 'F'")
def limit_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return reports.latest_then_filter(rows, [F.desc("o_orderdate"), F.col("o_orderkey")], F.col("o_orderstatus") == "F").drop("o_orderdate")


@found.add("SELECT * FROM (SELECT p_type, p_partkey, p_retailprice, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS n FROM part) WHERE n <= 3")
def topn_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf_dir, "part").select("p_type", "p_partkey", "p_retailprice", F.row_number().over(w).alias("n")).where("n <= 3")


@found.add("""
WITH b AS (SELECT DISTINCT p_brand FROM part)
SELECT p_brand, CAST(row_number() OVER (ORDER BY CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER)) AS INTEGER) AS position FROM b
""")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = table(spark, sf_dir, "part").select("p_brand").distinct()
    return brands.withColumn("position", F.row_number().over(Window.orderBy(T.natural_key(F.col("p_brand")))))


@found.add("""
WITH n AS (SELECT p_partkey + CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1000000 END AS p_partkey, p_name || '!' AS p_name, p_retailprice + 1 AS p_retailprice FROM part WHERE p_size > 25)
SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, coalesce(o.p_name, n.p_name) AS p_name, coalesce(n.p_retailprice, o.p_retailprice) AS p_retailprice
FROM part o FULL JOIN n ON o.p_partkey = n.p_partkey
""")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    key = F.col("p_partkey") + F.when(F.col("p_partkey") % 2 == 0, 0).otherwise(1000000)
    new = table(spark, sf_dir, "part").where("p_size > 25").select(key.alias("p_partkey"), F.concat("p_name", F.lit("!")).alias("p_name"), (F.col("p_retailprice") + 1).alias("p_retailprice"))
    return snapshots.upsert(old, new, ["p_partkey"], first_wins=("p_name",))


@found.add("""
SELECT p_partkey, p_name FROM part WHERE p_size <= 25
UNION ALL SELECT p_partkey, p_name || '!' FROM part p WHERE p_size > 20 AND NOT EXISTS (SELECT 1 FROM part o WHERE o.p_size <= 25 AND o.p_partkey = p.p_partkey)
""")
def insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    old = part.where("p_size <= 25").select("p_partkey", "p_name")
    return snapshots.insert_new(old, part.where("p_size > 20").select("p_partkey", F.concat("p_name", F.lit("!")).alias("p_name")), ["p_partkey"])


_PREFLIGHT = """
WITH s AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, min(o_orderkey) AS k FROM orders GROUP BY 1, 2),
v AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY d) AS n FROM s),
stored AS (SELECT k AS id, o_custkey AS lineage, n, d, CAST(k AS VARCHAR) AS text FROM v WHERE n <= 5),
batch AS (SELECT CASE WHEN n > 6 THEN k + 100000000 ELSE k END AS id, o_custkey AS lineage, CASE WHEN n = 7 THEN 2 ELSE n END AS n, d, CASE WHEN n = 3 AND o_custkey % 3 = 0 THEN 'other' ELSE CAST(k AS VARCHAR) END AS text FROM v WHERE n >= 3),
r AS (
  SELECT b.*, s.id IS NOT NULL AS known,
         CASE WHEN s.id IS NOT NULL AND s.text <> b.text THEN 'text_changed'
              WHEN s.id IS NULL AND EXISTS (SELECT 1 FROM stored x WHERE x.lineage = b.lineage AND x.n = b.n) THEN 'version_no_taken' END AS reason
  FROM batch b LEFT JOIN stored s ON s.id = b.id
), o AS (SELECT *, max(CASE WHEN reason IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY lineage) AS bad FROM r)
SELECT id AS provision_id, lineage AS logical_vb_id, CASE WHEN reason IS NOT NULL THEN 'conflict' WHEN bad = 1 THEN 'blocked' WHEN known THEN 'idempotent' ELSE 'created' END AS outcome, reason FROM o
"""


@found.add(_PREFLIGHT)
def immutable_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    from juristream.plans.temporal import versions

    v = versions(spark, sf_dir)
    n, k = F.col("version_no"), F.col("o_orderkey")
    columns = lambda id_, no, text: [id_.alias("provision_id"), F.col("o_custkey").alias("lineage_id"), F.col("o_custkey").alias("logical_vb_id"), no.alias("version_no"), "effective_from", text.alias("text_checksum"), F.lit("s").alias("source_checksum")]
    stored = v.where(n <= 5).select(*columns(k, n, k.cast("string")))
    batch = v.where(n >= 3).select(*columns(F.when(n > 6, k + 100000000).otherwise(k), F.when(n == 7, 2).otherwise(n), F.when((n == 3) & (F.col("o_custkey") % 3 == 0), "other").otherwise(k.cast("string"))))
    return snapshots.preflight(batch, stored)
