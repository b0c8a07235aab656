"""Graph queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juristream.operators import graph
from juristream.operators.temporal import transitions
from juristream.plans.common import Collected, table
from juristream.plans.temporal import _V, NAMES, versions

found = Collected()
QUERIES, ORACLES = found.queries, found.oracles


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges nation - customer and nation - supplier - part."""
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    a = table(spark, sf_dir, "customer").select(name("N", "c_nationkey").alias("src"), name("C", "c_custkey").alias("dst"))
    b = table(spark, sf_dir, "supplier").select(name("N", "s_nationkey").alias("src"), name("S", "s_suppkey").alias("dst"))
    c = table(spark, sf_dir, "lineitem").select(name("S", "l_suppkey").alias("src"), name("P", "l_partkey").alias("dst")).distinct()
    return a.union(b).union(c)


@found.add("""
WITH e AS (
  SELECT 'N' || c_nationkey AS src, 'C' || c_custkey AS dst FROM customer
  UNION SELECT 'N' || s_nationkey, 'S' || s_suppkey FROM supplier
  UNION SELECT 'S' || l_suppkey, 'P' || l_partkey FROM lineitem
), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
seeds AS (SELECT 'N' || n_nationkey AS node FROM nation WHERE n_regionkey = 1),
h AS (
  SELECT node, 0 AS distance FROM seeds
  UNION ALL SELECT u.dst, 1 FROM seeds s JOIN u ON s.node = u.src
  UNION ALL SELECT b.dst, 2 FROM seeds s JOIN u a ON s.node = a.src JOIN u b ON a.dst = b.src
), m AS (SELECT node, min(distance) AS distance FROM h GROUP BY node)
SELECT node, CAST(distance AS INTEGER) AS distance, 1.0::DOUBLE / (distance + 1) AS score FROM m WHERE distance > 0
""")
def graph_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node"))
    return graph.proximity(trade(spark, sf_dir), seeds, 2)


@found.add("""
WITH e AS (SELECT DISTINCT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst FROM lineitem),
n AS (SELECT src AS node FROM e UNION ALL SELECT dst FROM e)
SELECT node, count(*) AS degree FROM n GROUP BY node ORDER BY degree DESC, node LIMIT 50
""")
def graph_degree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = trade(spark, sf_dir).where(F.startswith("dst", F.lit("P")))
    return graph.degrees(edges).orderBy(F.desc("degree"), "node").limit(50)


def supersedes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each version and the next."""
    return transitions(versions(spark, sf_dir), NAMES).select(F.col("old_id").alias("src"), F.col("new_id").alias("dst"))


@found.add(_V + """
, g AS (SELECT o_custkey, count(*) - 1 AS hops, list(o_orderkey ORDER BY version_no) AS p FROM v GROUP BY 1)
SELECT p[1] AS root, p[CAST(least(hops, 10) + 1 AS INTEGER)] AS terminal, array_to_string(list_transform(p[1:CAST(least(hops, 10) + 1 AS INTEGER)], lambda x: CAST(x AS VARCHAR)), '>') AS path,
       CAST(least(hops, 10) AS INTEGER) AS hops, hops <= 10 AS ended
FROM g WHERE hops > 0
""")
def graph_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version chains, all of them; those of more than ten hops are returned as far as that, marked."""
    paths = graph.chains(supersedes(spark, sf_dir), 10)
    return paths.select("root", "terminal", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), "hops", "ended")


@found.add(_V + "SELECT a.o_orderkey AS src, b.o_orderkey AS dst FROM v a JOIN v b ON a.o_custkey = b.o_custkey AND a.version_no < b.version_no")
def graph_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(supersedes(spark, sf_dir))


@found.add(_V + """
, c AS (SELECT o_custkey, min_by(o_orderkey, version_no) AS first, max_by(o_orderkey, version_no) AS last, count(*) AS n FROM v GROUP BY 1)
SELECT last AS src, first AS dst FROM c WHERE o_custkey % 3 = 0 UNION SELECT last, last FROM c WHERE o_custkey % 3 = 1 OR n = 1
""")
def graph_cycle_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of new edges last -> first, first -> last (one customer in three each) and loops those that would close a cycle."""
    v = versions(spark, sf_dir)
    c = v.groupBy("o_custkey").agg(F.min_by("o_orderkey", "version_no").alias("first"), F.max_by("o_orderkey", "version_no").alias("last"))
    third = F.col("o_custkey") % 3
    new = c.select(F.when(third == 2, F.col("first")).otherwise(F.col("last")).alias("src"), F.when(third == 0, F.col("first")).otherwise(F.col("last")).alias("dst"))
    return graph.would_close_cycle(supersedes(spark, sf_dir), new)


@found.add("""
WITH e AS (SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem GROUP BY 1, 2),
o AS (SELECT src AS node, count(*) AS n_out FROM e GROUP BY 1), i AS (SELECT dst AS node, count(*) AS n_in FROM e GROUP BY 1)
SELECT coalesce(o.node, i.node) AS node, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM o FULL JOIN i ON o.node = i.node WHERE coalesce(n_out, 0) > 1 OR coalesce(n_in, 0) > 1
""")
def graph_branching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.branching(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))


@found.add("""
WITH r AS (SELECT 'N' || n_nationkey AS node, CASE WHEN n_regionkey = 1 THEN ['Law', 'Article'] ELSE ['Law'] END AS labels, CASE WHEN n_nationkey % 2 = 0 THEN 'ready' ELSE 'draft' END AS status FROM nation)
SELECT node, status FROM r WHERE list_contains(labels, 'Law') AND list_contains(labels, 'Article') AND status = 'ready'
""")
def graph_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.when(F.col("n_regionkey") == 1, F.array(F.lit("Law"), F.lit("Article"))).otherwise(F.array(F.lit("Law")))
    nodes = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("node"), labels.alias("labels"), F.when(F.col("n_nationkey") % 2 == 0, "ready").otherwise("draft").alias("status"))
    return graph.with_labels(nodes, ["Law", "Article"], "ready").select("node", "status")


@found.add("""
WITH p AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS doc, CAST(year(o_orderdate) AS VARCHAR) AS article, CAST(month(o_orderdate) AS VARCHAR) AS clause FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY CAST(article AS INTEGER), CAST(clause AS INTEGER)) AS n FROM p),
k AS (SELECT * FROM r WHERE n <= 12),
g AS (SELECT doc, count(DISTINCT article) AS a, count(*) AS c, min(article) AS first FROM k GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) AS doc, CAST(1 + coalesce(a, 0) + coalesce(c, 0) AS INTEGER) AS n_nodes, CAST(coalesce(a, 0) + coalesce(c, 0) AS INTEGER) AS n_edges, c_name AS title,
       CASE WHEN first IS NOT NULL THEN CAST(c_custkey AS VARCHAR) || '::D' || first END AS first_article
FROM customer LEFT JOIN g ON g.doc = CAST(c_custkey AS VARCHAR)
""")
def graph_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, years as articles, months as clauses: twelve clauses at most."""
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc"), F.col("c_name").alias("title"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("doc"), F.year("o_orderdate").cast("string").alias("article"), F.month("o_orderdate").cast("string").alias("clause"))
    tree = graph.containment(docs, rows, 12)
    first = F.get(F.filter("nodes", lambda n: n["kind"] == "dieu"), F.lit(0))["id"]
    return tree.select("doc", F.size("nodes").alias("n_nodes"), F.size("edges").alias("n_edges"), F.get("nodes", F.lit(0))["label"].alias("title"), first.alias("first_article"))


@found.add("""
WITH e AS (SELECT DISTINCT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst FROM lineitem),
u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
h AS (SELECT 'S1' AS node, 0 AS distance UNION ALL SELECT dst, 1 FROM u WHERE src = 'S1' UNION ALL SELECT b.dst, 2 FROM u a JOIN u b ON a.dst = b.src WHERE a.src = 'S1'),
m AS (SELECT node, min(distance) AS distance FROM h GROUP BY 1),
x AS (SELECT e.* FROM e JOIN m a ON a.node = e.src JOIN m b ON b.node = e.dst),
d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM x UNION ALL SELECT dst FROM x) GROUP BY 1),
r AS (SELECT m.node, distance, coalesce(degree, 0) AS degree FROM m LEFT JOIN d ON d.node = m.node ORDER BY distance, coalesce(degree, 0) DESC, m.node LIMIT 40)
SELECT node, CAST(distance AS INTEGER) AS distance, degree, degree / CAST(greatest(1, (SELECT count(*) FROM r) - 1) AS DOUBLE) AS centrality FROM r
""")
def graph_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forty nodes nearest to one supplier: a report."""
    edges = trade(spark, sf_dir).where(F.startswith("dst", F.lit("P")))
    return graph.neighbourhood(edges, spark.createDataFrame([("S1",)], "node string"), hops=2, limit=40)[0]
