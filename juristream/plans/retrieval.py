"""Retrieval queries over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from juristream.functions import text as T
from juristream.operators import retrieval, textindex
from juristream.operators.lineage import cut, shared_dir
from juristream.plans.common import Collected, table

found = Collected()
QUERIES, ORACLES = found.queries, found.oracles
W = r"[\p{L}\p{N}_]+"
_indexes: dict[tuple[str, str], str] = {}


def documents_index(spark: SparkSession, sf_dir: str) -> str:
    """The path of an index over the documents of sf_dir, made once a session."""
    made = (spark.sparkContext.applicationId, sf_dir)
    if made not in _indexes or not textindex.segments(spark, _indexes[made]).take(1):
        path = f"{shared_dir(spark)}/documents-index-{uuid.uuid4().hex}"
        textindex.add(table(spark, sf_dir, "documents").select("doc_id", "text"), path, key="doc_id", text="text")
        _indexes[made] = path
    return _indexes[made]


@found.add(rf"""
WITH q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '{W}'))) AS term FROM benchmark),
d AS (SELECT doc_id AS key, regexp_extract_all(lower(text), '{W}') AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
p AS (SELECT key, len(w) AS length, unnest(w) AS term FROM d),
tf AS (SELECT key, length, term, count(*) AS tf FROM p GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
x AS (SELECT q.query_id, tf.key, round(sum(ln(1 + (s.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) * tf.tf * (1.2::DOUBLE + 1) / (tf.tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * tf.length / s.mean))), 9) AS score
      FROM q JOIN tf ON q.term = tf.term JOIN df ON df.term = tf.term CROSS JOIN s GROUP BY 1, 2)
SELECT query_id, key, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS r FROM x) WHERE r <= 5
""")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries, documents as the collection."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = textindex.search(spark, documents_index(spark, sf_dir), queries, limit=5)
    return hits.select("query_id", "key", F.round("score", 6).alias("score"))


@found.add("""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS key, list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0)
SELECT query_id, key, round(score, 6) AS score, CAST(r AS INTEGER) AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS r FROM s) WHERE r <= 5
""")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 as the stated query set, against all."""
    points = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    queries = points.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.vector_top_k(points, queries, key="vec_id", vector="embedding", limit=5).withColumn("score", F.round("score", 6))


@found.add("""
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
u AS (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v),
m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2),
c AS (SELECT label, list(x ORDER BY i) AS e FROM m GROUP BY 1),
s AS (SELECT v.vec_id, c.label AS topic, list_dot_product(v.e, c.e) / (sqrt(list_dot_product(v.e, v.e)) * sqrt(list_dot_product(c.e, c.e))) AS score FROM v, c),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, topic) AS r FROM s)
SELECT vec_id, topic, round(score, 6) AS score, CASE WHEN score >= 0.55 THEN 'classified' ELSE 'needs_review' END AS status FROM r WHERE r = 1
""")
def centroid_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against the labels' centroids: the labels are the broadcast side, as they are few."""
    points = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    topics = retrieval.centroids(points, "label", "embedding")
    return retrieval.nearest_topic(points, topics, key="vec_id", vector="embedding").withColumn("score", F.round("score", 6))


_FUSE = r"""
WITH h AS (SELECT doc_id, lang, CAST(contains(lower(text), 'the') AS INTEGER) + CAST(contains(lower(text), 'tion') AS INTEGER) + CAST(contains(lower(text), 'und') AS INTEGER) AS hits, n_chars FROM documents),
a AS (SELECT lang AS query_id, doc_id, row_number() OVER (PARTITION BY lang ORDER BY hits DESC, doc_id) AS r FROM h),
b AS (SELECT lang AS query_id, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM h),
u AS (SELECT query_id, doc_id, 1.0::DOUBLE / (60 + r) AS part FROM a WHERE r <= 50 UNION ALL SELECT query_id, doc_id, 0.5::DOUBLE / (60 + r) FROM b WHERE r <= 50),
f AS (SELECT query_id, doc_id AS provision_id, round(sum(part), 12) AS raw FROM u GROUP BY 1, 2)
SELECT query_id, provision_id, round(least(1.0, raw / (1.5::DOUBLE / 61)), 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, CAST(provision_id AS VARCHAR)) AS INTEGER) AS position FROM f
"""


@found.add(_FUSE)
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a language ranked by keyword hits and by length, fused."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("query_id"), retrieval.keyword_hits(F.col("text"), ("the", "tion", "und")).alias("hits"), "n_chars")
    named = rows.select("query_id", F.col("doc_id").alias("provision_id"), F.col("doc_id").cast("string").alias("lineage_id"), "hits", "n_chars")
    one = retrieval.ranked(named, ["query_id"], [F.desc("hits"), F.col("provision_id")], 50)
    two = retrieval.ranked(named, ["query_id"], [F.desc("n_chars"), F.col("provision_id")], 50)
    fused = retrieval.fuse({"lexical": one, "vector": two}, weights={"lexical": 1.0, "vector": 0.5})
    return fused.select("query_id", "provision_id", F.round("score", 6).alias("score"), "position")


@found.add("SELECT doc_id, CAST(contains(lower(text), 'the') AS INTEGER) + CAST(contains(lower(text), 'tion') AS INTEGER) + CAST(contains(lower(text), 'und') AS INTEGER) + 2 * CAST(contains(lower(text), 'der') AS INTEGER) AS hits FROM documents")
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", retrieval.keyword_hits(F.col("text"), ("the", "tion", "und"), ("der",)).alias("hits"))


_BM25 = rf"""
WITH q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '{W}'))) AS term FROM benchmark),
d AS (SELECT doc_id AS key, regexp_extract_all(lower(text), '{W}') AS w FROM documents),
s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
p AS (SELECT key, len(w) AS length, unnest(w) AS term FROM d),
tf AS (SELECT key, length, term, count(*) AS tf FROM p GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
x AS (SELECT q.query_id, tf.key, round(sum(ln(1 + (s.n - df.df + 0.5::DOUBLE) / (df.df + 0.5::DOUBLE)) * tf.tf * (1.2::DOUBLE + 1) / (tf.tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * tf.length / s.mean))), 9) AS score
      FROM q JOIN tf ON q.term = tf.term JOIN df ON df.term = tf.term CROSS JOIN s GROUP BY 1, 2)
"""


@found.add(_BM25 + rf"""
, r AS (SELECT query_id, key FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS r FROM x) WHERE r <= 10),
a AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_extract_all(lower(text), '{W}'), lambda x: length(x) >= 2)) AS q FROM benchmark),
b AS (SELECT doc_id AS key, list_distinct(list_filter(regexp_extract_all(lower(text), '{W}'), lambda x: length(x) >= 2)) AS w FROM documents)
SELECT query_id, key, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, w)) / CAST(len(q) AS DOUBLE) END, 9) AS overlap FROM r JOIN a USING (query_id) JOIN b USING (key)
""")
def token_overlap_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item as a query over the ten documents that lexical search ranks first for it."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = textindex.search(spark, documents_index(spark, sf_dir), queries, limit=10).select("query_id", "key")
    asked = cut(hits.join(queries, "query_id"))
    # Ten hits an item go to the texts where they are few enough; the texts stay where they are.
    asked = F.broadcast(asked) if retrieval.bounded(asked, 100_000) else asked
    both = docs.select(F.col("doc_id").alias("key"), F.col("text").alias("passage")).join(asked, "key")
    return both.select("query_id", "key", F.round(retrieval.overlap(F.col("text"), F.col("passage")), 9).alias("overlap"))


@found.add(rf"""
WITH a AS (SELECT conv_id * 100 + turn AS left_id, list_distinct(regexp_extract_all(lower(text), '{W}')) AS w FROM conversations),
b AS (SELECT item_id AS right_id, list_distinct(regexp_extract_all(lower(text), '{W}')) AS w FROM benchmark),
s AS (SELECT left_id, right_id, len(list_intersect(a.w, b.w)) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE) AS score FROM a, b),
r AS (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) AS r FROM s WHERE score > 0)
SELECT left_id, right_id, round(score, 9) AS score, CAST(r AS INTEGER) AS position FROM r WHERE r <= 3
""")
def jaccard_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of a conversation with the benchmark items nearest to it."""
    left = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    right = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), "text")
    return retrieval.jaccard_link(left, right, limit=3).withColumn("score", F.round("score", 9))


@found.add(rf"""
WITH t AS (SELECT doc_id, text, regexp_extract_all(lower(text), '{W}') AS w FROM documents)
SELECT doc_id, array_to_string(list_slice(list_filter(w, lambda x: length(x) >= 2), 1, 5), ' ') AS head, len(w) AS n_words FROM t
""")
def search_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = T.tokens(F.col("text"))
    head = F.array_join(F.slice(F.filter(w, lambda x: F.length(x) >= 2), 1, 5), " ")
    return table(spark, sf_dir, "documents").select("doc_id", head.alias("head"), F.size(w).cast("long").alias("n_words"))


@found.add("""
WITH o AS (SELECT o_custkey, o_orderstatus, o_totalprice, o_orderkey FROM orders),
g AS (SELECT o_custkey, o_orderstatus, count(*) AS n, max_by(o_orderkey, o_totalprice) AS best FROM o GROUP BY 1, 2)
SELECT o_custkey, o_orderstatus, n, best FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderstatus) AS r FROM g) WHERE r = 1
""")
def keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer the most frequent status, and the dearest order of it."""
    g = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"), F.max_by("o_orderkey", "o_totalprice").alias("best"))
    w = Window.partitionBy("o_custkey").orderBy(F.desc("n"), "o_orderstatus")
    return g.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
