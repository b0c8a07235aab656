"""The write side as tables: what a write adds, derived from what there is, so that doing it again changes nothing.

Operators return the rows to be there afterwards, or the rows to append; snapshots.upsert and insert_new bring them in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juristream.functions import text as T

# Categories of what a clause is about, and the edge from the clause to it.
ENTITIES = {
    "chu_the": "AP_DUNG_CHO",
    "nghia_vu": "CO_NGHIA_VU",
    "quyen_loi": "CO_QUYEN_LOI",
    "hanh_vi_cam": "CAM",
    "thoi_han": "CO_THOI_HAN",
    "che_tai": "CO_CHE_TAI",
}


def counters(occurrences: DataFrame, key: str = "misconception_id") -> DataFrame:
    """key, volume, source_count, provider_count of occurrences (content_hash, content_id, provider): sources are different hashes, or ids without one.

    Counted anew rather than added to, so a write that is repeated leaves them as they are.
    """
    source = F.coalesce("content_hash", "content_id")
    return occurrences.groupBy(key).agg(F.count("*").alias("volume"), F.countDistinct(source).alias("source_count"), F.countDistinct("provider").alias("provider_count"))


def topics_of_posts(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics (slug, name) and edges (post_id, slug, score, model, status) that posts (post_id, topic, source_topic) imply; a topic's name is its first spelling."""
    name = F.trim(F.coalesce("topic", "source_topic"))
    named = posts.select("post_id", name.alias("name")).where("name <> ''").withColumn("slug", F.lower("name"))
    topics = named.groupBy("slug").agg(F.min(F.struct("post_id", "name"))["name"].alias("name"))
    edges = named.select("post_id", "slug", F.lit(1.0).alias("score"), F.lit("backfill_source_topic").alias("model"), F.lit("classified").alias("status")).distinct()
    return topics, edges


def linked_topics(posts: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with those added that topics_of_posts() implies and that aren't there; what is there keeps its score, model and status."""
    implied = topics_of_posts(posts)[1].join(edges.select("post_id", "slug"), ["post_id", "slug"], "left_anti")
    return edges.unionByName(implied)


def alert_edges(alerts: DataFrame, claims: DataFrame, misconceptions: DataFrame) -> DataFrame:
    """alert_id, kind, target of alerts (alert_id, signals: array of struct(ykien_id, misconception_id)): edges to the signals and misconceptions that exist, once each."""
    signals = alerts.select("alert_id", F.explode("signals").alias("s"))
    to = lambda kind, c, known, key: signals.select("alert_id", F.lit(kind).alias("kind"), F.col(f"s.{c}").alias("target")).where("target IS NOT NULL").distinct().join(known.select(F.col(key).alias("target")).distinct(), "target", "left_semi").select("alert_id", "kind", "target")
    return to("BAO_GOM_TIN_HIEU", "ykien_id", claims, "ykien_id").unionByName(to("CANH_BAO_VE", "misconception_id", misconceptions, "misconception_id"))


def stamped(old: DataFrame, new: DataFrame, key: str, now: str, *, status: str = "status", archived: str = "archived") -> DataFrame:
    """New rows (key, status, ...) with created_at kept from the old ones, updated_at now, and archived_at from when the status first was `archived`."""
    before = old.select(key, F.col("created_at").alias("_created"), F.col("archived_at").alias("_archived"))
    at = F.lit(now).cast("timestamp")
    both = new.join(before, key, "left")
    gone = F.when(F.col(status) == archived, F.coalesce("_archived", at))
    return both.select(*new.columns, F.coalesce("_created", at).alias("created_at"), at.alias("updated_at"), gone.alias("archived_at"))


def audit_entries(transitions: DataFrame, now: str) -> DataFrame:
    """audit_id, actor, action, resource_id, detail, at for transitions (actor, action, resource_id, detail: JSON): the id follows from what was done, so an entry that is
    written twice is one to insert_new()."""
    ident = T.stable_id("audit", F.col("actor"), F.col("action"), F.col("resource_id"), F.lit(now))
    return transitions.select(ident.alias("audit_id"), "actor", "action", "resource_id", "detail", F.lit(now).cast("timestamp").alias("at")).distinct()


def audit_view(entries: DataFrame, users: DataFrame) -> DataFrame:
    """Audit entries with the actor's email and role; entries of users that are gone stay."""
    return entries.join(users.select(F.col("user_id").alias("actor"), "email", "role"), "actor", "left")


def entity_rows(clauses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What clauses (khoan_id, entities: map category -> array of strings) are about: nodes (khoan_id, category, mo_ta) with their edge, once each, and the
    clauses (khoan_id, ner_done) that were looked at. Unknown categories and blank descriptions are left out."""
    kinds = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    found = clauses.select("khoan_id", F.explode("entities").alias("category", "items")).select("khoan_id", "category", F.explode("items").alias("mo_ta"))
    nodes = found.where(F.col("category").isin(*ENTITIES) & (F.trim("mo_ta") != "")).select("khoan_id", "category", "mo_ta", kinds[F.col("category")].alias("edge")).distinct()
    return nodes, clauses.select("khoan_id", F.lit(True).alias("ner_done")).distinct()


def edges_to_known(rows: DataFrame, source: str, target: str, known: DataFrame, key: str) -> DataFrame:
    """src, dst of rows whose target exists: an optional match that isn't there adds no edge and loses no row elsewhere."""
    pairs = rows.where(F.col(target).isNotNull()).select(F.col(source).alias("src"), F.col(target).alias("dst")).distinct()
    return pairs.join(known.select(F.col(key).alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def replayed(stored: DataFrame, batch: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, outcome of writing immutable rows: inserted, replayed (the same again) or conflict (another under a stored key)."""
    mine = F.struct(*columns)
    known = stored.select(key, mine.alias("_stored"))
    outcome = F.when(F.col("_stored").isNull(), "inserted").when(F.col("_stored") == mine, "replayed").otherwise("conflict")
    return batch.join(known, key, "left").select(key, outcome.alias("outcome"))


def count_or_named(keys: DataFrame, links: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """key, n: rows linked to a key, or that name it where none is linked."""
    a = links.groupBy(key).agg(F.count("*").alias("_linked"))
    b = named.groupBy(key).agg(F.count("*").alias("_named"))
    n = F.when(F.coalesce("_linked", F.lit(0)) > 0, F.col("_linked")).otherwise(F.coalesce("_named", F.lit(0)))
    return keys.select(key).distinct().join(a, key, "left").join(b, key, "left").select(key, n.alias("n"))


#: Roots that are sent to every task.
FEW_ROOTS = 200_000


def by_alias(nodes: DataFrame, aliases: list[str], asked: DataFrame, *, tree: bool = True) -> DataFrame:
    """asked, node: nodes one of whose alias columns is what is asked for (column asked), or, with tree, that lie below it ('asked::...').

    Every alias is a row of an index that is joined by equality; what lies below meets by the part before '::'. A root may have most of the nodes, so
    the roots that are asked for are sent to these if there are few.
    """
    index = nodes.select("node", F.explode(F.array_distinct(F.array_compact(F.array(*[F.col(a).cast("string") for a in aliases])))).alias("alias"))
    exact = index.join(asked, index["alias"] == asked["asked"]).select("asked", "node")
    if not tree:
        return exact.distinct()
    below = index.where(F.contains("alias", F.lit("::"))).select("node", F.substring_index("alias", "::", 1).alias("root")).distinct()
    roots = asked.where(~F.contains("asked", F.lit("::"))).distinct()  # a root has no '::'
    few = roots.limit(FEW_ROOTS + 1).count() <= FEW_ROOTS
    return exact.union(below.join(F.broadcast(roots) if few else roots, F.col("root") == F.col("asked")).select("asked", "node")).distinct()


def newest_first(rows: DataFrame, dates: list[str], key: str) -> DataFrame:
    """Rows by the first date that they have, latest first, undated ones last."""
    return rows.orderBy(F.coalesce(*dates).desc_nulls_last(), key)


def index_time(date: Column) -> Column:
    """A date as an index holds it: YYYY-MM-DDT00:00:00Z."""
    return F.date_format(date, "yyyy-MM-dd'T00:00:00Z'")


def iso_day(value: Column) -> Column:
    """The first ten characters of a date or time as text, null for blank ones."""
    return F.nullif(F.substring(F.trim(value.cast("string")), 1, 10), F.lit(""))
