"""Temporal queries over the driver's tables: a customer's orders are the versions of one lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juristream.operators import temporal
from juristream.plans.common import Collected, table

found = Collected()
QUERIES, ORACLES = found.queries, found.oracles
NAMES = temporal.Versions(lineage="o_custkey", id="o_orderkey", parent="parent")
AS_OF = "1997-06-30"


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version per customer and order day: the day's first order, valid until the next one's day."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("effective_from"))
    days = orders.groupBy("o_custkey", "effective_from").agg(F.min("o_orderkey").alias("o_orderkey"))
    return temporal.build_versions(days, "o_custkey", "effective_from")


_V = """
WITH d AS (
  SELECT o_custkey, CAST(o_orderdate AS DATE) AS effective_from, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2
), v AS (
  SELECT *, lead(effective_from) OVER w AS effective_to, CAST(row_number() OVER w AS INTEGER) AS version_no
  FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY effective_from)
)
"""


@found.add(_V + "SELECT o_custkey, o_orderkey, version_no, effective_from, effective_to FROM v")
def temporal_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions(spark, sf_dir).select("o_custkey", "o_orderkey", "version_no", "effective_from", "effective_to")


@found.add(_V + f"""
SELECT v.o_custkey, c.c_name, v.o_orderkey, v.version_no, v.effective_from
FROM v JOIN customer c ON v.o_custkey = c.c_custkey
WHERE v.effective_from <= DATE '{AS_OF}' AND (v.effective_to IS NULL OR DATE '{AS_OF}' < v.effective_to)
""")
def temporal_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = temporal.as_of(versions(spark, sf_dir), AS_OF)
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return active.join(customers, "o_custkey").select("o_custkey", "c_name", "o_orderkey", "version_no", "effective_from")


@found.add(_V + """
SELECT e.event_id, h.o_orderkey AS hist_id, c.o_orderkey AS curr_id,
       CASE WHEN h.o_orderkey IS NULL AND c.o_orderkey IS NULL THEN 'none' WHEN h.o_orderkey IS NULL THEN 'begun'
            WHEN c.o_orderkey IS NULL THEN 'ended' WHEN h.o_orderkey = c.o_orderkey THEN 'same' ELSE 'changed' END AS change
FROM events e
LEFT JOIN v h ON e.user_id = h.o_custkey AND h.effective_from <= CAST(e.ts AS DATE) - INTERVAL 2400 DAY AND (h.effective_to IS NULL OR CAST(e.ts AS DATE) - INTERVAL 2400 DAY < h.effective_to)
LEFT JOIN v c ON e.user_id = c.o_custkey AND c.effective_from <= CAST(e.ts AS DATE) - INTERVAL 2000 DAY AND (c.effective_to IS NULL OR CAST(e.ts AS DATE) - INTERVAL 2000 DAY < c.effective_to)
""")
def temporal_dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.to_date("ts").alias("day"))
    both = temporal.dual_time(events, versions(spark, sf_dir), "user_id", F.date_sub("day", 2400), F.date_sub("day", 2000), NAMES)
    return both.select("event_id", "hist_id", "curr_id", "change")


@found.add(_V + """
, m AS (
  SELECT o_custkey, lag(effective_to) OVER w AS before_to, lag(effective_from) OVER w AS before_from, lag(version_no) OVER w AS before_no, effective_from, effective_to, version_no
  FROM v WINDOW w AS (PARTITION BY o_custkey ORDER BY effective_from, version_no)
)
SELECT o_custkey AS lineage, count(*) AS n_versions, count(*) FILTER (before_from IS NOT NULL AND (before_to IS NULL OR before_to > effective_from)) AS n_overlaps,
       count(*) FILTER (before_to < effective_from) AS n_gaps, count(*) FILTER (before_no >= version_no) AS n_not_rising, count(*) FILTER (effective_to <= effective_from) AS n_empty
FROM m GROUP BY o_custkey
""")
def temporal_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.integrity(versions(spark, sf_dir), NAMES)


@found.add(_V + """
, p AS (
  SELECT o_custkey AS lineage, o_orderkey AS old_id, lead(o_orderkey) OVER w AS new_id, effective_from, effective_to, lead(effective_from) OVER w AS new_from
  FROM v WINDOW w AS (PARTITION BY o_custkey ORDER BY effective_from, version_no)
)
SELECT lineage, old_id, new_id, CAST(new_from - effective_from AS INTEGER) AS days, coalesce(effective_to = new_from, false) AS contiguous FROM p WHERE new_id IS NOT NULL
""")
def temporal_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.transitions(versions(spark, sf_dir), NAMES).select("lineage", "old_id", "new_id", "days", "contiguous")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers and their orders as one tree; an order is in force for 90 days, the rest always."""
    level = lambda df, kind, key, parent: df.select(F.concat(F.lit(kind), F.col(key).cast("string")).alias("o_custkey"), F.col(parent).alias("parent") if parent is not None else F.lit(None).cast("string").alias("parent"), F.lit("1900-01-01").cast("date").alias("effective_from"), F.lit(None).cast("date").alias("effective_to"))
    up = lambda df, kind, key: df.withColumn("_up", F.concat(F.lit(kind), F.col(key).cast("string")))
    region = level(table(spark, sf_dir, "region"), "R", "r_regionkey", None)
    nation = level(up(table(spark, sf_dir, "nation"), "R", "n_regionkey"), "N", "n_nationkey", "_up")
    customer = level(up(table(spark, sf_dir, "customer"), "N", "c_nationkey"), "C", "c_custkey", "_up")
    day = F.to_date("o_orderdate")
    order = table(spark, sf_dir, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("o_custkey"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("parent"), day.alias("effective_from"), F.date_add(day, 90).alias("effective_to"))
    return region.unionByName(nation).unionByName(customer).unionByName(order)


@found.add(f"""
WITH t AS (
  SELECT 'R' || r_regionkey AS node, NULL AS parent, DATE '1900-01-01' AS a, CAST(NULL AS DATE) AS b FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, DATE '1900-01-01', NULL FROM nation
  UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey, DATE '1900-01-01', NULL FROM customer
  UNION ALL SELECT 'O' || o_orderkey, 'C' || o_custkey, CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + 90 FROM orders
), f AS (
  SELECT * FROM t WHERE a <= DATE '{AS_OF}' AND (b IS NULL OR DATE '{AS_OF}' < b)
)
SELECT node, parent FROM f WHERE NOT EXISTS (SELECT 1 FROM f AS child WHERE child.parent = f.node)
""")
def tree_deepest_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = temporal.as_of(tree(spark, sf_dir), AS_OF, NAMES)
    return temporal.deepest(active, NAMES).select(F.col("o_custkey").alias("node"), "parent")
