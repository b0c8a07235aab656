"""Queries on amendments, clusters of claims and retrieval in steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from juristream.functions import arrow
from juristream.operators import amendment, claims, retrieval
from juristream.plans.common import Collected, table

found = Collected()
QUERIES, ORACLES = found.queries, found.oracles

_SIDES = """
WITH c AS (
  SELECT c_custkey AS k, CAST(c_nationkey AS VARCHAR) AS doc, CAST(c_custkey // 2 % 4 AS VARCHAR) AS article, CAST(c_custkey % 3 AS VARCHAR) AS clause, CASE WHEN c_custkey % 5 > 2 THEN CAST(c_custkey % 5 AS VARCHAR) END AS point,
         'a' || substr('xyz', CAST(c_custkey % 3 AS INTEGER) + 1, 1) || ' b' || substr('xyz', CAST(c_custkey // 3 % 2 AS INTEGER) + 1, 1) || ' c' || substr('xyzuv', CAST(c_custkey // 7 % 5 AS INTEGER) + 1, 1) || ' d' || substr('xy', CAST(c_custkey // 11 % 2 AS INTEGER) + 1, 1) AS text FROM customer
), s AS (SELECT *, doc || '::D' || article || '.K' || clause || coalesce('.P' || point, '') AS lineage, CASE WHEN point IS NULL THEN 'khoan' ELSE 'diem' END AS level, string_split(text, ' ') AS w FROM c),
x AS (
  SELECT o.doc, o.k AS old_id, n.k AS new_id, CASE WHEN o.lineage = n.lineage THEN 1.0::DOUBLE WHEN o.clause = n.clause AND o.point IS NOT DISTINCT FROM n.point THEN 0.9::DOUBLE WHEN o.clause = n.clause THEN 0.65::DOUBLE ELSE 0.35::DOUBLE END AS coordinate,
         CASE WHEN o.level = n.level THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS level, len(list_filter(list_zip(o.w, n.w), lambda p: p[1] = p[2])) / 4.0::DOUBLE AS lexical
  FROM s o JOIN s n ON o.k % 2 = 0 AND n.k % 2 = 1 AND o.doc = n.doc AND o.article = n.article
), y AS (SELECT doc AS document, old_id, new_id, round(least(1.0, 0.35::DOUBLE * 0 + 0.25::DOUBLE * coordinate + 0.1::DOUBLE * level + 0.2::DOUBLE * lexical + 0.05::DOUBLE + 0.05::DOUBLE), 6) AS score FROM x)
"""


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as provisions of a nation's document: even ones the old version, odd ones the new. A word's first letter is its place."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("k"), F.col("c_nationkey").cast("string").alias("logical_vb_id"), (F.floor(k / 2) % 4).cast("string").alias("article"), (k % 3).cast("string").alias("clause"), F.when(k % 5 > 2, (k % 5).cast("string")).alias("point"))
    letter = lambda name, of, letters: F.concat(F.lit(name), F.substring(F.lit(letters), (of + 1).cast("int"), F.lit(1)))
    text = F.concat_ws(" ", letter("a", F.col("k") % 3, "xyz"), letter("b", F.floor(F.col("k") / 3) % 2, "xyz"), letter("c", F.floor(F.col("k") / 7) % 5, "xyzuv"), letter("d", F.floor(F.col("k") / 11) % 2, "xy"))
    lineage = F.concat("logical_vb_id", F.lit("::D"), "article", F.lit(".K"), "clause", F.coalesce(F.concat(F.lit(".P"), "point"), F.lit("")))
    rows = rows.select("*", lineage.alias("lineage_id"), F.when(F.col("point").isNull(), "khoan").otherwise("diem").alias("level"), text.alias("text"), F.col("k").alias("provision_id"), F.lit("2020-01-01").cast("date").alias("effective_from"))
    return rows.where("k % 2 = 0"), rows.where("k % 2 = 1")


@found.add(_SIDES + "SELECT document, old_id, new_id, score FROM y WHERE score >= 0.45")
def amend_score_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of old and new versions that meet in a document and article."""
    old, new = sides(spark, sf_dir)
    return amendment.score_pairs(old, new).select("document", F.col("old_provision_id").alias("old_id"), F.col("new_provision_id").alias("new_id"), "score")


@found.add(_SIDES.split(", x AS (")[0].rstrip().rstrip(",") + """
, q AS (SELECT a.k, a.w AS v, b.w FROM s a JOIN s b ON b.k = a.k + 1), z AS (SELECT k, list_filter(list_zip(v, w), lambda p: p[1] = p[2]) AS same, list_filter(list_zip(v, w), lambda p: p[1] <> p[2]) AS other FROM q)
SELECT k, round(len(same) / 4.0::DOUBLE, 9) AS ratio, array_to_string(list_transform(same, lambda p: p[1]), ' ') AS kept, CAST(len(other) AS INTEGER) AS n_changed FROM z
""")
def seq_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's words against the next one's: how alike they are in order, what stays and how many words change."""
    old, new = sides(spark, sf_dir)
    rows = old.unionByName(new).select("k", "text")
    both = rows.join(rows.select((F.col("k") - 1).alias("k"), F.col("text").alias("next")), "k")
    hunks = both.select("k", arrow.token_ratio("text", "next").alias("ratio"), arrow.token_diff("text", "next").alias("h"))
    of = lambda kind: F.filter("h", lambda x: x["type"] == kind)
    changed = F.aggregate(of("replace"), F.lit(0), lambda n, x: n + F.size(F.split(x["old"], " ")))
    return hunks.select("k", F.round("ratio", 9).alias("ratio"), F.array_join(F.transform(of("equal"), lambda x: x["old"]), " ").alias("kept"), changed.alias("n_changed"))


_COMMIT = """
WITH v AS (
  SELECT 'o' || CAST(c_custkey AS VARCHAR) AS provision_id, 'so' || CAST(c_custkey AS VARCHAR) AS text_checksum, DATE '2020-01-01' AS effective_from, CASE WHEN c_custkey % 17 = 0 THEN DATE '2020-06-01' END AS effective_to FROM customer
  UNION ALL SELECT 'n' || CAST(c_custkey AS VARCHAR), 'sn' || CAST(c_custkey AS VARCHAR), CASE WHEN c_custkey % 19 = 0 THEN DATE '2019-01-01' ELSE DATE '2021-01-01' END, NULL FROM customer
), p AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 3 = 0)
"""


def commits(spark: SparkSession, sf_dir: str, sound: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Operations, versions and edges: each customer has an old and a new version, one in three is amended; if not sound, some wrongly."""
    k = F.col("c_custkey")
    name = lambda c, prefix: F.concat(F.lit(prefix), c.cast("string"))
    day = lambda d: F.lit(d).cast("date")
    rows = table(spark, sf_dir, "customer").select(k)
    old = rows.select(name(k, "o").alias("provision_id"), name(k, "so").alias("text_checksum"), day("2020-01-01").alias("effective_from"), (F.when(k % 17 == 0, day("2020-06-01")) if not sound else F.lit(None).cast("date")).alias("effective_to"))
    new = rows.select(name(k, "n").alias("provision_id"), name(k, "sn").alias("text_checksum"), (F.when(k % 19 == 0, day("2019-01-01")).otherwise(day("2021-01-01")) if not sound else day("2021-01-01")).alias("effective_from"), F.lit(None).cast("date").alias("effective_to"))
    amended = rows.where("c_custkey % 3 = 0")
    operations = amended.select(
        k.alias("operation_id"), F.lit("PAIRED").alias("kind"), name(k, "o").alias("old_id"), (F.when(k % 5 == 0, "wrong").otherwise(name(k, "so")) if not sound else name(k, "so")).alias("old_checksum"), name(k, "n").alias("new_id"), name(k, "sn").alias("new_checksum"),
        (F.when(k % 7 == 0, "pending").otherwise("accepted") if not sound else F.lit("accepted")).alias("review_status"),
    )
    edges = rows.where("c_custkey % 13 = 0") if not sound else rows.where("c_custkey % 3 = 1")
    edges = edges.select(name(k, "o").alias("src"), name(k, "x" if not sound else "n").alias("dst"))
    back = rows.where("c_custkey % 33 = 0").select(name(k, "n").alias("src"), name(k, "o").alias("dst"))
    return operations, old.unionByName(new), edges if sound else edges.union(back)


@found.add(_COMMIT + """
, r AS (SELECT k, list_filter([CASE WHEN k % 7 = 0 THEN 'not_accepted' END, CASE WHEN k % 5 = 0 THEN 'old_not_exactly_one' END, CASE WHEN k % 13 = 0 THEN 'old_has_other_successor' END, CASE WHEN k % 19 = 0 AND k % 5 > 0 THEN 'new_not_later' END,
                               CASE WHEN k % 17 = 0 AND k % 5 > 0 THEN 'old_closed_otherwise' END, CASE WHEN k % 33 = 0 THEN 'cycle' END], lambda x: x IS NOT NULL) AS reasons FROM p)
SELECT k AS operation_id, array_to_string(reasons, ',') AS reasons FROM r WHERE len(reasons) > 0
""")
def amend_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return amendment.commit_conflicts(*commits(spark, sf_dir, False)).select("operation_id", F.array_join("reasons", ",").alias("reasons"))


@found.add("""
SELECT 'o' || CAST(c_custkey AS VARCHAR) AS provision_id, CASE WHEN c_custkey % 3 = 0 THEN DATE '2021-01-01' END AS effective_to FROM customer UNION ALL SELECT 'n' || CAST(c_custkey AS VARCHAR), NULL FROM customer
""")
def amend_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions after a sound batch: the old ones end where the new ones begin."""
    return amendment.commit(*commits(spark, sf_dir, True))[0].select("provision_id", "effective_to")


@found.add("""
SELECT DISTINCT 'o' || CAST(c_custkey AS VARCHAR) AS src, 'n' || CAST(c_custkey AS VARCHAR) AS dst FROM customer WHERE c_custkey % 3 < 2
""")
def amend_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges after a sound batch, with those that were there."""
    return amendment.commit(*commits(spark, sf_dir, True))[1]


@found.add("""
WITH k AS (SELECT event_id, event_id % 30 AS g, event_id % 3 AS t, ts FROM events WHERE event_id % 4 > 0),
f AS (SELECT *, first_value(event_id) OVER (PARTITION BY t, g ORDER BY ts, CAST(event_id AS VARCHAR)) AS leader FROM k)
SELECT event_id, leader, event_id = leader AS created FROM f
""")
def claim_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of thirty kinds on three topics, as written in capitals or with marks; a cluster is named after its first."""
    e = F.col("event_id")
    word = lambda i: F.concat(F.lit(f"w{i}"), F.translate((e % 30).cast("string"), "0123456789", "abcdefghij"))
    text = F.concat_ws(" ", *[word(i) for i in "rstuv"])
    text = F.when(e % 2 == 0, F.upper(text)).otherwise(F.concat(text, F.lit("!")))
    rows = table(spark, sf_dir, "events").select(
        e.cast("string").alias("ykien_id"), F.concat(F.lit("t"), (e % 3).cast("string")).alias("topic"), F.lit("k").alias("legal_anchor_id"), text.alias("claim_text"), F.col("ts").alias("created_at"), F.when(e % 4 == 0, "khop").otherwise("mau_thuan").alias("nli_label"), F.lit(0.9).alias("nli_score")
    )
    out = claims.cluster_claims(rows).join(rows.select("ykien_id", "created_at"), "ykien_id")
    first = F.first("ykien_id").over(Window.partitionBy("misconception_id").orderBy("created_at", "ykien_id"))
    return out.select(F.col("ykien_id").cast("long").alias("event_id"), first.cast("long").alias("leader"), "created")


def _library(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Parts as clauses of five documents, and questions: by number, by id, by topic, and small talk."""
    k = F.col("p_partkey")
    doc = F.concat((k % 5 + 10).cast("string"), F.lit("/2020/NĐ-CP"))
    topics = ("vi phạm nồng độ cồn bị phạt tiền theo quy định", "hóa đơn điện tử được lập theo quy định", "hoàn thuế giá trị gia tăng theo quy định")
    text = F.when(k % 4 == 3, "........................").otherwise(F.concat(F.element_at(F.array(*map(F.lit, topics)), (k % 3 + 1).cast("int")), F.lit(" của điều "), F.translate(k.cast("string"), "0123456789", "abcdefghij")))
    lineage = F.concat(F.regexp_replace(doc, "Đ", "D"), F.lit("::D"), k.cast("string"))
    rows = table(spark, sf_dir, "part").select(F.concat(lineage, F.lit("@2020-01-01#"), F.lpad(k.cast("string"), 12, "0")).alias("provision_id"), lineage.alias("lineage_id"), F.regexp_replace(doc, "Đ", "D").alias("logical_vb_id"), text.alias("text"), k.alias("k"))
    questions = [(1, "Nghị định 11/2020/NĐ-CP quy định gì?"), (2, "xem 12/2020/ND-CP::D7"), (3, "mức phạt nồng độ cồn"), (4, "hoàn thuế thế nào"), (5, "xem 99/X::D1"), (6, "Nghị định 77/2020/NĐ-CP về hóa đơn điện tử")]
    return rows, spark.createDataFrame(questions, "query_id long, text string")


_PARTS = """
WITH p AS (SELECT p_partkey AS k, CAST(p_partkey % 5 + 10 AS VARCHAR) || '/2020/ND-CP' AS doc, p_partkey % 3 AS topic, p_partkey % 4 < 3 AS ok FROM part),
d AS (SELECT *, doc || '::D' || CAST(k AS VARCHAR) || '@2020-01-01#' || lpad(CAST(k AS VARCHAR), 12, '0') AS id FROM p)
"""


@found.add(_PARTS + """
, h AS (SELECT 1 AS query_id, id, doc FROM d WHERE doc = '11/2020/ND-CP' UNION ALL SELECT 2, id, doc FROM d WHERE doc || '::D' || CAST(k AS VARCHAR) = '12/2020/ND-CP::D7'
        UNION ALL SELECT 3, id, doc FROM d WHERE topic = 0 AND ok UNION ALL SELECT 4, id, doc FROM d WHERE topic = 2 AND ok UNION ALL SELECT 6, id, doc FROM d WHERE topic = 1 AND ok),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS n FROM h)
SELECT CAST(query_id AS BIGINT) AS query_id, id AS key, doc AS document, CAST(n AS INTEGER) AS position FROM r WHERE n <= 8
""")
def retrieve_stepwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a question names by number or id; else keywords, on its topic and readable."""
    rows, questions = _library(spark, sf_dir)
    return retrieval.stepwise(questions, rows).select("query_id", "key", "document", "position")


@found.add(_PARTS + """
, h AS (SELECT 3 AS query_id, id, doc, k FROM d WHERE topic = 0 AND ok UNION ALL SELECT 4, id, doc, k FROM d WHERE topic = 2 AND ok),
g AS (SELECT query_id, doc, count(*) AS items, min(k) AS first FROM h GROUP BY 1, 2), b AS (SELECT query_id, doc FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY items DESC, first) AS n FROM g) WHERE n = 1),
r AS (SELECT h.*, row_number() OVER (PARTITION BY query_id ORDER BY k) AS n FROM h JOIN b USING (query_id, doc)),
x AS (SELECT 1 AS query_id, id, doc, row_number() OVER (ORDER BY k) AS n FROM d WHERE ok AND doc = '11/2020/ND-CP')
SELECT CAST(query_id AS BIGINT) AS query_id, doc AS document, id AS key, CAST(n AS INTEGER) AS position FROM r WHERE n <= 3 UNION ALL SELECT query_id, doc, id, CAST(n AS INTEGER) FROM x WHERE n <= 6
""")
def retrieve_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three passages of the best document for two questions on a topic, six of a document that is named; small talk gets none."""
    rows, questions = _library(spark, sf_dir)
    asked = questions.where("query_id IN (1, 3, 4)").unionByName(spark.createDataFrame([(7, "xin chào")], "query_id long, text string"))
    every = rows.where("k % 4 < 3").select(F.col("logical_vb_id").alias("document"), F.col("provision_id").alias("key"), "text", F.col("k").alias("position"))
    hits = every.join(F.broadcast(asked.select("query_id")))  # four questions
    return retrieval.select_context(hits, asked).select("query_id", "document", "key", "position")


@found.add("""
SELECT vec_id FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 11 = 0 OR len(embedding) <> 64
""")
def vector_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors cut short or spoilt, as a check before they are indexed finds them."""
    v = F.col("vec_id")
    spoilt = F.when(v % 7 == 0, F.slice("embedding", 1, 10)).when(v % 11 == 0, F.transform("embedding", lambda x, i: F.when(i == 3, F.lit(float("nan"))).otherwise(x))).otherwise(F.col("embedding"))
    return retrieval.bad_vectors(table(spark, sf_dir, "embeddings").select(v, spoilt.alias("embedding")), "embedding", 64).select("vec_id")


@found.add("""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
q AS (SELECT vec_id AS query_id, CASE WHEN vec_id % 40 = 0 THEN -1 ELSE label END AS topic, x FROM e WHERE vec_id % 20 = 0), t AS (SELECT vec_id AS key, label AS topic, x FROM e WHERE vec_id % 3 = 1),
s AS (SELECT query_id, key, list_dot_product(q.x, t.x) / (sqrt(list_dot_product(q.x, q.x)) * sqrt(list_dot_product(t.x, t.x))) AS score FROM q JOIN t ON q.topic = t.topic OR q.topic NOT IN (SELECT topic FROM t)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS n FROM s)
SELECT query_id, key, round(score, 6) AS score, CAST(n AS INTEGER) AS position FROM r WHERE n <= 5 AND score >= 0.2
""")
def vector_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest targets of a point's topic, or of all where the topic has none."""
    e = table(spark, sf_dir, "embeddings")
    points = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") % 40 == 0, -1).otherwise(F.col("label")).alias("topic"), F.col("embedding").alias("vector"))
    targets = e.where("vec_id % 3 = 1").select(F.col("vec_id").alias("key"), F.col("label").alias("topic"), F.col("embedding").alias("vector"))
    return retrieval.link_entities(points, targets, threshold=0.2, limit=5).withColumn("score", F.round("score", 6))
