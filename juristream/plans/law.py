"""Queries on provisions: orders as the versions of articles and clauses of five documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juristream.functions import text as T
from juristream.operators import reports, temporal
from juristream.plans.common import Collected, table
from juristream.plans.temporal import _V, versions

found = Collected()
QUERIES, ORACLES = found.queries, found.oracles
DAY, LATER = "1996-03-01", "1997-06-30"


def provisions(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """A customer's versions as those of a clause, or (one customer in four) of the article that the next three customers' clauses belong to. keep: columns of versions() besides."""
    v = versions(spark, sf_dir)
    k, n = F.col("o_custkey"), F.col("o_orderkey")
    place = F.floor(k / 5)
    rows = v.select(
        F.concat((k % 5).cast("string"), F.lit("/2020/ND-CP")).alias("logical_vb_id"), F.floor(place / 4).cast("string").alias("article"), F.when(place % 4 > 0, (place % 4).cast("string")).alias("clause"), F.lit(None).cast("string").alias("point"), "version_no", "effective_from", "effective_to",
        F.concat(F.lit("Phạt "), (n % 50 + 1).cast("string"), F.lit(" triệu đồng trong "), (n % 30 + 1).cast("string"), F.lit(" ngày")).alias("text"), F.when(n % 7 == 0, "internal").otherwise("public").alias("visibility"), F.when(n % 11 == 0, "needs_review").otherwise("approved").alias("review_status"), n.alias("number"), *keep,
    )
    rows = rows.withColumn("lineage_id", T.lineage_id(F.col("logical_vb_id"), F.col("article"), F.col("clause"), F.col("point"))).withColumn("text_checksum", T.checksum(F.col("text")))
    return rows.select(
        "*", T.parent_lineage(F.col("lineage_id")).alias("parent_lineage_id"), F.when(F.col("clause").isNull(), "dieu").otherwise("khoan").alias("level"), T.version_id(F.col("lineage_id"), F.col("effective_from"), F.col("text_checksum")).alias("provision_id")
    )


_LAW = _V + """
, a AS (
  SELECT CAST(o_custkey % 5 AS VARCHAR) || '/2020/ND-CP' AS logical_vb_id, CAST((o_custkey // 5) // 4 AS VARCHAR) AS article, CASE WHEN (o_custkey // 5) % 4 > 0 THEN CAST((o_custkey // 5) % 4 AS VARCHAR) END AS clause,
         version_no, effective_from, effective_to, 'Phạt ' || CAST(o_orderkey % 50 + 1 AS VARCHAR) || ' triệu đồng trong ' || CAST(o_orderkey % 30 + 1 AS VARCHAR) || ' ngày' AS text,
         CASE WHEN o_orderkey % 7 = 0 THEN 'internal' ELSE 'public' END AS visibility, CASE WHEN o_orderkey % 11 = 0 THEN 'needs_review' ELSE 'approved' END AS review_status, o_orderkey AS number
  FROM v
), b AS (
  SELECT *, logical_vb_id || '::D' || article || coalesce('.K' || clause, '') AS lineage_id, sha256(text) AS text_checksum, CASE WHEN clause IS NOT NULL THEN logical_vb_id || '::D' || article END AS parent_lineage_id,
         CASE WHEN clause IS NULL THEN 'dieu' ELSE 'khoan' END AS level FROM a
), p AS (SELECT *, lineage_id || '@' || CAST(effective_from AS VARCHAR) || '#' || substr(text_checksum, 1, 12) AS provision_id FROM b)
"""


def _active(day: str, seen: str = "TRUE") -> str:
    return f"SELECT * FROM p WHERE effective_from <= DATE '{day}' AND (effective_to IS NULL OR DATE '{day}' < effective_to) AND {seen}"


_CITIZEN = "visibility = 'public' AND review_status = 'approved'"


@found.add(_LAW + f", f AS ({_active(DAY, _CITIZEN)}) SELECT provision_id, logical_vb_id, article, clause, version_no FROM f WHERE NOT EXISTS (SELECT 1 FROM f c WHERE c.parent_lineage_id = f.lineage_id)")
def law_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a citizen may read on a day: the deepest provisions in force."""
    return temporal.law_as_of(provisions(spark, sf_dir), DAY).select("provision_id", "logical_vb_id", "article", "clause", "version_no")


@found.add(_LAW + f", f AS ({_active(DAY)}) SELECT provision_id, level FROM f WHERE logical_vb_id = '3/2020/ND-CP'")
def law_of_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All levels of one document, as admins see them: both optional conditions used."""
    return temporal.law_as_of(provisions(spark, sf_dir), DAY, audience="admin", document="3/2020/ND-CP", leaves_only=False).select("provision_id", "level")


@found.add(_LAW + "SELECT provision_id FROM p WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.parent_lineage_id = p.lineage_id)")
def law_structural_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.structural_leaves(provisions(spark, sf_dir)).select("provision_id")


@found.add(_LAW + f", f AS ({_active(DAY)}) SELECT provision_id FROM f WHERE NOT EXISTS (SELECT 1 FROM ({_active(DAY, _CITIZEN)}) c WHERE c.parent_lineage_id = f.lineage_id)")
def law_dated_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions in force without a public child in force: what the leaf rule is held against."""
    rows = provisions(spark, sf_dir)
    public = temporal.as_of(temporal.visible_to(rows, "citizen"), DAY).where("parent_lineage_id IS NOT NULL").select(F.col("parent_lineage_id").alias("lineage_id")).distinct()
    return temporal.as_of(rows, DAY).join(public, "lineage_id", "left_anti").select("provision_id")


@found.add(_LAW + f"""
, f AS ({_active(LATER)}), c AS (SELECT lineage_id, min(number) AS position FROM p WHERE version_no <= 2 AND number % 3 = 0 GROUP BY 1)
SELECT f.provision_id, position FROM f JOIN c ON c.lineage_id = f.lineage_id
""")
def law_hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stale candidates led to what is in force now."""
    rows = provisions(spark, sf_dir)
    candidates = rows.where("version_no <= 2 AND number % 3 = 0").select("provision_id", F.col("number").alias("position"))
    return temporal.hydrate(candidates, rows, LATER).select("provision_id", "position")


@found.add(_LAW + f", f AS ({_active(LATER)}) SELECT provision_id, number AS position FROM f WHERE number % 3 = 0")
def law_hydrate_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that are in force themselves; no other is led anywhere."""
    rows = provisions(spark, sf_dir)
    return temporal.hydrate(rows.where("number % 3 = 0").select("provision_id", F.col("number").alias("position")), rows, LATER, redirect=False).select("provision_id", "position")


@found.add(_LAW + f"""
, x AS ({_active(DAY)}), y AS ({_active(LATER)})
SELECT coalesce(x.lineage_id, y.lineage_id) AS lineage, x.provision_id AS old_id, y.provision_id AS new_id,
       CASE WHEN x.provision_id IS NULL THEN 'added' WHEN y.provision_id IS NULL THEN 'deleted' WHEN x.text = y.text THEN 'unchanged' ELSE 'modified' END AS status
FROM x FULL JOIN y ON x.lineage_id = y.lineage_id
""")
def law_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = provisions(spark, sf_dir)
    return temporal.compare(temporal.as_of(rows, DAY), temporal.as_of(rows, LATER)).select("lineage", "old_id", "new_id", "status")


@found.add(_LAW + """
SELECT provision_id, CASE WHEN number % 13 = 0 THEN 'checksum,' ELSE '' END || CASE WHEN number % 17 = 0 THEN 'lineage,' ELSE '' END || CASE WHEN number % 19 = 0 AND parent_lineage_id IS NOT NULL THEN 'parent,' ELSE '' END
       || CASE WHEN number % 23 = 0 THEN 'interval,' ELSE '' END || CASE WHEN number % 29 = 0 THEN 'version_no,' ELSE '' END AS reasons
FROM p WHERE number % 13 = 0 OR number % 17 = 0 OR (number % 19 = 0 AND parent_lineage_id IS NOT NULL) OR number % 23 = 0 OR number % 29 = 0
""")
def law_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions some of whose fields were changed, with the reasons that this gives."""
    n = F.col("number")
    rows = provisions(spark, sf_dir).withColumns({
        "text": F.when(n % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "article": F.when(n % 17 == 0, F.concat("article", F.lit("x"))).otherwise(F.col("article")), "parent_lineage_id": F.when(n % 19 != 0, F.col("parent_lineage_id")),
        "effective_to": F.when(n % 23 == 0, F.col("effective_from")).otherwise(F.col("effective_to")), "version_no": F.when(n % 29 == 0, 0).otherwise(F.col("version_no")),
    })
    bad = temporal.contract_violations(rows)
    return bad.select("provision_id", F.concat(F.array_join("reasons", ","), F.lit(",")).alias("reasons"))


@found.add(_LAW + """
, t AS (SELECT lineage_id, provision_id, number, lead(provision_id) OVER (PARTITION BY lineage_id ORDER BY effective_from, version_no) AS next FROM p)
SELECT lineage_id AS lineage, count(*) AS n_transitions, bool_and(number % 5 > 0) AS complete FROM t WHERE next IS NOT NULL GROUP BY 1
""")
def law_complete_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineages whose every transition is linked; edges from one version in five are missing."""
    rows = provisions(spark, sf_dir)
    edges = temporal.transitions(rows).join(rows.select(F.col("provision_id").alias("old_id"), "number"), "old_id").where("number % 5 > 0").select("old_id", "new_id")
    return temporal.complete_chains(rows, edges)


@found.add(_LAW + f"SELECT lineage_id, count(*) AS n FROM ({_active(DAY)} UNION ALL SELECT * FROM p WHERE number % 10 = 0) GROUP BY 1 HAVING count(*) > 1")
def law_ambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineages with several versions in force, after some that aren't were added."""
    rows = provisions(spark, sf_dir)
    return temporal.ambiguous(temporal.as_of(rows, DAY).unionByName(rows.where("number % 10 = 0")))


@found.add(f"""
WITH k AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderdate AS DATE) END AS starts FROM orders),
r AS (SELECT o_orderkey - 1 AS old_id, o_orderkey AS new_id, CAST(o_orderdate AS DATE) AS starts FROM orders WHERE o_orderkey % 3 = 0)
SELECT id, starts FROM k WHERE (starts IS NULL OR starts <= DATE '{DAY}') AND NOT EXISTS (SELECT 1 FROM r WHERE r.old_id = k.id AND r.starts <= DATE '{DAY}')
""")
def law_not_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    clauses, replaced = _replacements(spark, sf_dir)
    return temporal.not_replaced(clauses, replaced, DAY)


@found.add(f"""
WITH k AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderdate AS DATE) END AS starts FROM orders),
r AS (SELECT o_orderkey - 1 AS old_id, o_orderkey AS new_id, CAST(o_orderdate AS DATE) AS starts FROM orders WHERE o_orderkey % 3 = 0)
SELECT DISTINCT k.id, k.starts, r.new_id, r.starts AS replaced_from FROM k JOIN r ON r.old_id = k.id WHERE r.starts > DATE '{DAY}'
""")
def law_coming_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    clauses, replaced = _replacements(spark, sf_dir)
    return temporal.coming_replacements(clauses, replaced, DAY)


def _replacements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    clauses = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 > 0, F.col("day")).alias("starts"))
    return clauses, orders.where("o_orderkey % 3 = 0").select((F.col("o_orderkey") - 1).alias("old_id"), F.col("o_orderkey").alias("new_id"), F.col("day").alias("starts"))


@found.add(_LAW + "SELECT provision_id, text_checksum FROM p WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.parent_lineage_id = p.lineage_id) AND provision_id > '3/2020/ND-CP' ORDER BY provision_id LIMIT 200")
def law_keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two hundred leaves after the last one indexed: a page."""
    leaves = temporal.structural_leaves(provisions(spark, sf_dir)).select("provision_id", "text_checksum")
    return reports.page_after(leaves, "provision_id", "3/2020/ND-CP", 200)


@found.add(_LAW + """
, q AS (SELECT provision_id, lineage_id, article, clause FROM p)
SELECT provision_id, split_part(lineage_id, '::', 1) AS document, article, clause, CASE WHEN clause IS NULL THEN 'dieu' ELSE 'khoan' END AS level,
       split_part(lineage_id, '::', 1) || ' · Điều ' || article || coalesce(' · Khoản ' || clause, '') AS reference FROM q
""")
def law_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a version's id says of itself: document, article, clause, level, and how a list cites it."""
    from juristream.functions import dialogue

    parts = T.lineage_parts(F.col("lineage_id"))
    return provisions(spark, sf_dir).select("provision_id", parts["document"].alias("document"), parts["article"].alias("article"), parts["clause"].alias("clause"), T.level_of(F.col("lineage_id")).alias("level"), dialogue.compact_reference(F.col("lineage_id")).alias("reference"))


@found.add(_LAW + f"""
, f AS ({_active(LATER)})
SELECT p.provision_id, CASE WHEN p.text_checksum = x.sum THEN 'keep' ELSE 'reindex' END AS action FROM p JOIN (SELECT provision_id, CASE WHEN number % 4 = 0 THEN 'old' ELSE text_checksum END AS sum FROM p WHERE number % 3 > 0) x USING (provision_id)
WHERE p.provision_id IN (SELECT provision_id FROM f)
UNION ALL SELECT provision_id, 'index' FROM f WHERE number % 3 = 0
UNION ALL SELECT provision_id, 'delete' FROM p WHERE number % 3 > 0 AND provision_id NOT IN (SELECT provision_id FROM f)
""")
def law_index_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index that lacks a third of the versions and has some old ones must do to hold what is in force."""
    from juristream.operators import retrieval

    rows = provisions(spark, sf_dir)
    points = rows.where("number % 3 > 0").select("provision_id", F.when(F.col("number") % 4 == 0, "old").otherwise(F.col("text_checksum")).alias("text_checksum"))
    return retrieval.reconcile_index(temporal.as_of(rows, LATER), points)


@found.add(_LAW + f"""
, f AS ({_active(LATER)}), q AS (SELECT c_custkey AS query_id, CASE c_custkey % 3 WHEN 0 THEN CAST(c_custkey % 5 AS VARCHAR) || '/2020/nd-cp' ELSE CAST(c_custkey % 5 AS VARCHAR) || '/2020/ND-CP::D' || CAST((c_custkey // 5) // 4 AS VARCHAR) END AS identifier FROM customer)
SELECT q.query_id, f.provision_id, f.lineage_id, CASE WHEN q.identifier = f.lineage_id THEN 0.99::DOUBLE ELSE 0.95::DOUBLE END AS score FROM q JOIN f ON q.identifier = f.lineage_id OR upper(q.identifier) = upper(f.logical_vb_id)
WHERE q.query_id % 3 > 0 OR q.query_id <= 30
""")
def law_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of lineages, and of whole documents in small letters for the first thirty customers."""
    from juristream.operators import retrieval

    k = F.col("c_custkey")
    document = F.concat((k % 5).cast("string"), F.lit("/2020/"))
    lineage = F.concat(document, F.lit("ND-CP::D"), F.floor(F.floor(k / 5) / 4).cast("string"))
    asked = table(spark, sf_dir, "customer").where("c_custkey % 3 > 0 OR c_custkey <= 30").select(k.alias("query_id"), F.when(k % 3 == 0, F.concat(document, F.lit("nd-cp"))).otherwise(lineage).alias("identifier"))
    return retrieval.exact(temporal.as_of(provisions(spark, sf_dir), LATER), asked)


@found.add(_LAW + f"""
, f AS ({_active(LATER)}), c AS (SELECT f.* FROM f WHERE EXISTS (SELECT 1 FROM p WHERE p.lineage_id = f.lineage_id AND p.number % 3 = 0))
SELECT provision_id FROM c WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.parent_lineage_id = c.lineage_id)
""")
def law_candidate_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaf rule among hydrated candidates alone: an article stays if none of its clauses is one of them."""
    rows = provisions(spark, sf_dir)
    candidates = rows.where("number % 3 = 0").select("provision_id", F.col("number").alias("position"))
    return temporal.deepest(temporal.hydrate(candidates, rows, LATER)).select("provision_id")


@found.add(_LAW + """
, l AS (SELECT DISTINCT logical_vb_id, article, clause, lineage_id, parent_lineage_id FROM p WHERE logical_vb_id <> '4/2020/ND-CP')
SELECT logical_vb_id, article, clause FROM l WHERE NOT EXISTS (SELECT 1 FROM l c WHERE c.parent_lineage_id = l.lineage_id)
""")
def law_document_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaf rule inside documents as parsed, without dates."""
    rows = provisions(spark, sf_dir).where("logical_vb_id <> '4/2020/ND-CP'").select("logical_vb_id", "article", "clause", "lineage_id", "parent_lineage_id").distinct()
    return temporal.structural_leaves(rows).select("logical_vb_id", "article", "clause")
