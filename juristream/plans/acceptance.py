"""The acceptance queries over the driver's tables, by their ids: provisions of plans.law, edges between their versions, events as claims, orders as reviews.

Some rows are made faulty on purpose, so that queries whose result must be empty on sound data have something to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from juristream.operators import acceptance, temporal
from juristream.plans.common import Collected, table
from juristream.plans.law import _LAW, DAY, LATER, provisions

found = Collected()
QUERIES, ORACLES = found.queries, found.oracles

ARTICLE, CLAUSE, OTHER = "1/2020/ND-CP::D0", "1/2020/ND-CP::D0.K1", "2/2020/ND-CP::D0.K1"
#: An article in force on a day on which none of its clauses is.
BARE, EARLY = "2/2020/ND-CP::D7", "1995-03-01"


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = provisions(spark, sf_dir, "o_custkey")
    n = F.col("number")
    edges = temporal.transitions(rows).join(rows.select(F.col("provision_id").alias("old_id"), n), "old_id")
    events = table(spark, sf_dir, "events")
    e, kind = F.col("event_id"), F.col("event_type")
    # Both versions of a base come out of the window that numbers them: no rows are exchanged for them again.
    then, of_customer = rows.where("version_no <= 2"), Window.partitionBy("o_custkey").orderBy("effective_from")
    then = then.select("version_no", F.pmod("number", F.lit(1000)).alias("user_id"), F.col("provision_id").alias("hist_id"), F.col("text_checksum").alias("hist_checksum"), F.col("lineage_id").alias("legal_anchor_id"), F.lead("provision_id").over(of_customer).alias("curr_id"), F.lead("text_checksum").over(of_customer).alias("curr_checksum"))
    # A user's events rest on every base of the user: on two versions of it, or (one event in four) on the first alone.
    of = lambda user, same: user * 2 + same.cast("int")
    claims = events.select(
        e.cast("string").alias("ykien_id"), F.concat(F.lit("m"), (e % 40).cast("string")).alias("misconception_id"), of(F.pmod("user_id", F.lit(1000)), e % 4 == 0).alias("base"), F.when(kind == "click", "OUTDATED_BUT_PREVIOUSLY_TRUE").otherwise("SUPPORTED").alias("verdict"), F.when(e % 3 > 0, "mau_thuan").otherwise("khop").alias("nli_label"),
        F.lit(3).alias("evidence_start"), F.when(e % 10 > 0, 9).otherwise(3).alias("evidence_end"), F.when(e % 13 > 0, "h").alias("content_hash"), F.lit("u").alias("canonical_url"),
    )
    pairs = then.where("version_no = 1").withColumn("same", F.explode(F.array(F.lit(False), F.lit(True))))
    now = lambda c: F.when(F.col("same"), F.col(f"hist_{c}")).otherwise(F.col(f"curr_{c}")).alias(f"curr_{c}")
    bases = pairs.select(of(F.col("user_id"), F.col("same")).alias("base"), "hist_id", "hist_checksum", now("id"), now("checksum"), "legal_anchor_id")
    orders, o = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    items = orders.select(o.cast("string").alias("id"), F.when(o % 6 == 0, F.array(F.lit("Brief"), F.lit("Draft"))).when(o % 6 == 1, F.array(F.lit("Brief"))).otherwise(F.array(F.lit("Alert"))).alias("labels"), F.when(o % 4 < 2, "published").otherwise("draft").alias("status"))
    status = F.when(F.col("o_orderstatus") == "O", "committed").when(F.col("o_orderstatus") == "F", "draft").otherwise("approved")
    batches = orders.select(o.alias("batch_id"), status.alias("status"), F.lit(1).alias("revision"), F.when(o % 9 > 0, "r").alias("reviewer_id"), F.when(o % 10 > 0, F.col("o_orderdate")).alias("reviewed_at"), F.when(o % 14 > 0, "k").alias("commit_key"), F.col("o_orderdate").alias("committed_at"), (o % 25 == 0).alias("auto_approved"))
    items_of = table(spark, sf_dir, "lineitem")
    candidates = items_of.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("candidate_id"), (F.col("l_orderkey") + F.when(F.col("l_partkey") % 50 == 0, 10_000_000).otherwise(0)).alias("batch_id"), F.lit("pending").alias("status"), (F.col("l_suppkey") == 7).alias("auto_approved"))
    log = orders.where("o_orderkey % 5 > 0").select((o * 2).alias("event_id"), (o + F.when(o % 77 == 0, 20_000_000).otherwise(0)).alias("batch_id"), F.when(F.col("o_orderstatus") == "O", "committed").otherwise("submitted").alias("event_type"), F.col("o_orderdate").alias("created_at"))
    return {
        "provisions": rows,
        "faulty": rows.unionByName(rows.where(n % 31 == 0)).withColumn("visibility", F.when(n % 37 > 0, F.col("visibility"))),
        "contains": rows.where("parent_lineage_id IS NOT NULL").select(F.col("parent_lineage_id").alias("parent_lineage"), F.col("lineage_id").alias("child_lineage")).distinct(),
        "supersedes": edges.select(F.col("old_id").alias("src"), F.col("new_id").alias("dst"), F.concat(F.lit("r"), n.cast("string")).alias("review_key"), F.when(n % 8 > 0, F.concat(F.lit("c"), n.cast("string"))).alias("commit_key")),
        "reviews": rows.select(F.concat(F.lit("r"), n.cast("string")).alias("review_key"), F.concat(F.lit("c"), n.cast("string")).alias("commit_key"), F.when(n % 9 == 0, "SPLIT").otherwise("MODIFIED").alias("change_type")),
        "claims": claims,
        "bases": bases,
        "doubled": claims.unionByName(claims.where(F.col("ykien_id").cast("long") % 11 == 0).withColumn("misconception_id", F.lit("other"))),
        "items": items,
        "batches": batches,
        "candidates": candidates,
        "events": log,
    }


_TABLES = _LAW + """
, t AS (SELECT provision_id AS src, number, effective_to AS closed, lineage_id, lead(provision_id) OVER w AS dst, lead(effective_from) OVER w AS begun FROM p WINDOW w AS (PARTITION BY lineage_id ORDER BY effective_from, version_no)),
s AS (SELECT src, dst, closed, begun, number, 'r' || CAST(number AS VARCHAR) AS review_key, CASE WHEN number % 8 > 0 THEN 'c' || CAST(number AS VARCHAR) END AS commit_key FROM t WHERE dst IS NOT NULL),
h AS (SELECT number % 1000 AS user_id, provision_id AS hist_id, text_checksum AS hist_checksum, lineage_id AS legal_anchor_id FROM p WHERE version_no = 1),
w AS (SELECT provision_id AS curr_id, text_checksum AS curr_checksum, lineage_id AS legal_anchor_id FROM p WHERE version_no = 2),
o AS (
  SELECT event_id, CAST(event_id AS VARCHAR) AS ykien_id, 'm' || CAST(event_id % 40 AS VARCHAR) AS misconception_id, CASE WHEN event_type = 'click' THEN 'OUTDATED_BUT_PREVIOUSLY_TRUE' ELSE 'SUPPORTED' END AS verdict, CASE WHEN event_id % 3 > 0 THEN 'mau_thuan' ELSE 'khop' END AS nli_label,
         3 AS evidence_start, CASE WHEN event_id % 10 > 0 THEN 9 ELSE 3 END AS evidence_end, CASE WHEN event_id % 13 > 0 THEN 'h' END AS content_hash, hist_id, h.legal_anchor_id, CASE WHEN event_id % 4 = 0 THEN hist_id ELSE curr_id END AS curr_id
  FROM events JOIN h ON h.user_id = events.user_id % 1000 LEFT JOIN w ON w.legal_anchor_id = h.legal_anchor_id
)
"""
_PARAMETERS = {
    "as_of": LATER, "clause": ARTICLE, "lineage": OTHER, "point_a": CLAUSE, "point_b": OTHER, "fabricated": "9/2020/ND-CP::D1@2020-01-01#0", "quote": "triệu đồng", "claim": "phạt 5 triệu đồng",
}
_SQL = {
    "T01": f"SELECT array_to_string(list(DISTINCT lineage_id ORDER BY lineage_id), ', ') AS children, count(DISTINCT lineage_id) AS n FROM p WHERE parent_lineage_id = '{ARTICLE}'",
    "T02": f"""SELECT c.provision_id, coalesce(array_to_string(list(x.provision_id ORDER BY x.provision_id) FILTER (x.provision_id IS NOT NULL), ', '), '') AS points
               FROM (SELECT * FROM p WHERE effective_from <= DATE '{LATER}' AND (effective_to IS NULL OR DATE '{LATER}' < effective_to)) c
               LEFT JOIN (SELECT * FROM p WHERE effective_from <= DATE '{LATER}' AND (effective_to IS NULL OR DATE '{LATER}' < effective_to)) x ON x.parent_lineage_id = c.lineage_id WHERE c.lineage_id = '{ARTICLE}' GROUP BY 1""",
    "T03": f"SELECT provision_id FROM p WHERE lineage_id = '{OTHER}' AND effective_from <= DATE '{LATER}' AND (effective_to IS NULL OR DATE '{LATER}' < effective_to)",
    "T04": f"""SELECT provision_id FROM p WHERE level = 'dieu' AND lineage_id = '{BARE}' AND effective_from <= DATE '{EARLY}' AND (effective_to IS NULL OR DATE '{EARLY}' < effective_to)
               AND NOT EXISTS (SELECT 1 FROM p c WHERE c.parent_lineage_id = p.lineage_id AND c.effective_from <= DATE '{EARLY}' AND (c.effective_to IS NULL OR DATE '{EARLY}' < c.effective_to))""",
    "T05": f"""SELECT (SELECT array_to_string(list(version_no ORDER BY version_no), ', ') FROM p WHERE lineage_id = '{CLAUSE}') AS a_versions, (SELECT array_to_string(list(version_no ORDER BY version_no), ', ') FROM p WHERE lineage_id = '{OTHER}') AS b_versions""",
    "T06": "SELECT lineage_id FROM p WHERE lineage_id = '{lineage}'",
    "T07": f"SELECT coalesce(array_to_string(list(provision_id ORDER BY provision_id), ', '), '') AS active FROM p WHERE lineage_id = '{OTHER}' AND effective_from <= DATE '{LATER}' AND (effective_to IS NULL OR DATE '{LATER}' < effective_to)",
    "T09": "SELECT provision_id, 2::BIGINT AS n FROM p WHERE number % 31 = 0",
    "T10": "SELECT provision_id FROM p WHERE number % 37 = 0 UNION ALL SELECT provision_id FROM p WHERE number % 37 = 0 AND number % 31 = 0",
    "T16": "SELECT src, dst, closed FROM s WHERE closed = begun AND number % 8 > 0",
    "T17": "SELECT src, dst FROM s WHERE number % 9 = 0",
    "T18": "SELECT ykien_id, hist_id, curr_id FROM o WHERE verdict = 'OUTDATED_BUT_PREVIOUSLY_TRUE' AND curr_id <> hist_id",
    "T19": "SELECT ykien_id FROM o WHERE verdict = 'OUTDATED_BUT_PREVIOUSLY_TRUE' AND (curr_id IS NULL OR curr_id = hist_id)",
    "T20": "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey % 6 = 0 AND o_orderkey % 4 < 2",
    "N01": "SELECT ykien_id FROM o WHERE content_hash IS NOT NULL AND evidence_end > evidence_start AND nli_label = 'mau_thuan'",
    "N02": "SELECT ykien_id, 2::BIGINT AS n FROM o WHERE event_id % 11 = 0 GROUP BY 1",
    "PG01": "SELECT 'events' AS table_name, 'created_at' AS column_name UNION ALL SELECT 'batches', 'commit_key'",
    "PG02": "SELECT 'batch' AS kind, o_orderkey AS id FROM orders WHERE o_orderkey % 25 = 0 UNION ALL SELECT 'candidate', l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_suppkey = 7",
    "PG03": "SELECT o_orderkey AS batch_id FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 14 = 0",
    "PG04": "SELECT o_orderkey AS batch_id FROM orders WHERE o_orderstatus <> 'F' AND (o_orderkey % 9 = 0 OR o_orderkey % 10 = 0)",
    "PG05": """SELECT 'candidates' AS kind, l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_partkey % 50 = 0 OR l_orderkey NOT IN (SELECT o_orderkey FROM orders)
               UNION ALL SELECT 'events', o_orderkey * 2 FROM orders WHERE o_orderkey % 5 > 0 AND o_orderkey % 77 = 0""",
    "PG06": "SELECT o_orderkey AS batch_id FROM orders WHERE o_orderstatus <> 'F' AND (o_orderkey % 5 = 0 OR o_orderkey % 77 = 0)",
    "PG07": "SELECT o_orderkey AS batch_id FROM orders WHERE o_orderkey = 32 AND o_orderstatus = 'O'",
}


def _register(name: str, sql: str, shape=lambda df: df, parameters: dict | None = None, **renamed: str) -> None:
    """acc_<id>: the query of that id. renamed: which of the tables stand in for others."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = tables(spark, sf_dir)
        t |= {to: t[of] for to, of in renamed.items()}
        return shape(acceptance.QUERIES[name](t, _PARAMETERS | (parameters or {})))

    query.__name__ = f"acc_{name.lower()}"
    query.__doc__ = f"Acceptance query {name}."
    found.add(sql)(query)


def _listed(*columns: str):
    """Arrays as text, in order."""
    return lambda df: df.select(*[F.array_join(F.transform(F.array_sort(c), lambda x: x.cast("string")), ", ").alias(c) if c in columns else F.col(c) for c in df.columns if c != "b_ends"])


_register("T01", _TABLES + _SQL["T01"], _listed("children"))
_register("T02", _TABLES + _SQL["T02"], _listed("points"))
_register("T03", _TABLES + _SQL["T03"])
_register("T04", _TABLES + _SQL["T04"], parameters={"as_of": EARLY, "lineage": BARE})
_register("T05", _TABLES + _SQL["T05"], _listed("a_versions", "b_versions"))
for _id in ("T07", "T08"):
    _register(_id, _TABLES + _SQL["T07"], _listed("active"), parameters={"as_of": LATER})
_register("T09", _TABLES + _SQL["T09"], provisions="faulty")
_register("T10", _TABLES + _SQL["T10"], provisions="faulty")
for _id in ("T16", "T17", "T18", "T19", "T20", "N01"):
    _register(_id, _TABLES + _SQL[_id])
_register("N02", _TABLES + _SQL["N02"], claims="doubled")
for _id in ("PG02", "PG03", "PG04", "PG05", "PG06"):
    _register(_id, _SQL[_id])
_register("PG07", _SQL["PG07"], parameters={"batch_id": 32})


def _of_first(name: str, shape, sql: str, **parameters: object) -> None:
    """Queries on one version: the first one of CLAUSE."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = tables(spark, sf_dir)
        one = t["provisions"].where((F.col("lineage_id") == CLAUSE) & (F.col("version_no") == 1)).select("provision_id").first()
        return shape(acceptance.QUERIES[name](t, _PARAMETERS | {"provision_id": one["provision_id"] if one else ""} | parameters))

    query.__name__ = f"acc_{name.lower()}"
    query.__doc__ = f"Acceptance query {name}, of one version."
    found.add(_TABLES + f", one AS (SELECT * FROM p WHERE lineage_id = '{CLAUSE}' AND version_no = 1)" + sql)(query)


_of_first("T06", lambda df: df.select(F.array_join("path", ">").alias("path"), "hops"), f"""
, c AS (SELECT list(provision_id ORDER BY version_no) AS ids FROM p WHERE lineage_id = '{CLAUSE}')
SELECT array_to_string(ids[1:least(len(ids), 11)], '>') AS path, CAST(least(len(ids) - 1, 10) AS INTEGER) AS hops FROM c WHERE len(ids) > 1
""")  # fmt: skip
_of_first("T11", lambda df: df, "SELECT provision_id, text, text_checksum, effective_from, effective_to FROM one")
_of_first("T12", lambda df: df, "SELECT 0::BIGINT AS n FROM (SELECT 1) x")
_of_first("T13", lambda df: df, f"SELECT provision_id FROM one WHERE visibility = 'public' AND review_status = 'approved' AND effective_from <= DATE '{DAY}' AND (effective_to IS NULL OR DATE '{DAY}' < effective_to)", as_of=DAY)
_of_first("T14", lambda df: df, "SELECT contains(text, 'triệu đồng') AS quote_exact FROM one")
_of_first("T15", lambda df: df, "SELECT text AS premise, 'phạt 5 triệu đồng' AS hypothesis FROM one")


@found.add(_SQL["PG01"])
def acc_pg01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acceptance query PG01, of tables that lack a column each."""
    t = tables(spark, sf_dir)
    t |= {"events": t["events"].drop("created_at"), "batches": t["batches"].drop("commit_key")}
    return acceptance.QUERIES["PG01"](t, {})
