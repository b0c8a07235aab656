"""Lists, counters and reviews for the people who run the service: dashboard, queues, inventories, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def page(rows: DataFrame, order: list[Column], *, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of an ordered list; limit is held between 1 and 100. The order must end in a unique key for pages to be whole."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(100, max(1, limit)))


def page_after(rows: DataFrame, key: str, after=None, limit: int = 500) -> DataFrame:
    """The next `limit` rows by a unique key: those above the last one read, so no page reads what pages before it had. The comparison reaches the scan."""
    left = rows if after is None else rows.where(F.col(key) > F.lit(after))
    return left.orderBy(key).limit(limit)


def latest_then_filter(rows: DataFrame, order: list[Column], condition: Column, window: int = 100) -> DataFrame:
    """What holds among the latest `window` rows, which is less than the latest rows for which it holds."""
    return rows.orderBy(*order).limit(window).where(condition)


def counters(rows: DataFrame, named: dict[str, Column]) -> DataFrame:
    """One row with how many rows each condition holds for, in one pass."""
    return rows.agg(*[F.count_if(c).alias(n) for n, c in named.items()])


def dashboard(documents: DataFrame, posts: DataFrame, alerts: DataFrame, jobs: DataFrame, briefs: DataFrame) -> DataFrame:
    """metric, value of the service's tables; 'high' alerts include critical ones. Each table is scanned once."""
    parts = [
        counters(documents, {"documents": F.lit(True), "documents_in_review": F.col("review_status") == "needs_review"}),
        counters(posts, {"posts": F.lit(True), "posts_in_review": F.col("needs_review")}),
        counters(alerts, {"alerts_open": F.col("status") == "open", "alerts_high": F.col("severity").isin("high", "critical") & (F.col("status") == "open")}),
        counters(jobs, {"jobs_queued": F.col("status") == "queued", "jobs_running": F.col("status") == "running", "jobs_failed": F.col("status") == "failed"}),
        counters(briefs, {"briefs_draft": F.col("status") == "draft", "briefs_published": F.col("status") == "published"}),
    ]
    out = None
    for p in parts:
        one = p.unpivot([], p.columns, "metric", "value")
        out = one if out is None else out.unionByName(one)
    return out


def review_queue(jobs: DataFrame, nodes: DataFrame, kind: str | None = None) -> DataFrame:
    """Jobs (job_id, job_type, created_at, needs_review) and nodes (id, labels, created_at, needs_review) that wait for review, as one list."""
    a = jobs.where("needs_review").select(F.col("job_id").alias("id"), F.when(F.col("job_type").ilike("legal%"), "legal_job").otherwise("social_job").alias("type"), "created_at")
    label = F.element_at("labels", 1)
    b = nodes.where("needs_review").select("id", F.when(F.array_contains("labels", "BaiDang"), "post").when(label.isin("Dieu", "Khoan", "Diem"), "provision").otherwise("document").alias("type"), "created_at")
    both = a.unionByName(b)
    return both if kind is None else both.where(F.col("type") == kind)


def migration_inventory(documents: DataFrame, provisions: DataFrame) -> DataFrame:
    """document, counts of provisions by level and what they lack, and status: empty, blocked, partial or ready; the null document is the total."""
    p = provisions.select(
        F.col("logical_vb_id").alias("document"), "level", F.coalesce(F.trim("text") == "", F.lit(True)).alias("no_text"), F.col("text_checksum").isNull().alias("no_checksum"), F.col("effective_from").isNull().alias("no_start"), F.col("visibility").isNull().alias("no_visibility")
    )
    g = p.groupBy("document").agg(*[F.count_if(F.col("level") == v).alias(v) for v in ("dieu", "khoan", "diem")], *[F.count_if(c).alias(c) for c in ("no_text", "no_checksum", "no_start", "no_visibility")])
    rows = documents.select("document").distinct().join(g, "document", "left").na.fill(0)
    rows = rows.rollup("document").agg(*[F.sum(c).alias(c) for c in rows.columns if c != "document"])
    n = F.col("dieu") + F.col("khoan") + F.col("diem")
    status = F.when(n == 0, "empty").when((F.col("no_text") > 0) | (F.col("no_start") > 0), "blocked").when((F.col("no_checksum") > 0) | (F.col("no_visibility") > 0), "partial").otherwise("ready")
    return rows.withColumn("status", status)


def fallback_documents(provisions: DataFrame, title: str) -> DataFrame:
    """Documents whose only article bears the title that a parser gives when it finds none."""
    a = provisions.where("level = 'dieu'").groupBy(F.col("logical_vb_id").alias("document")).agg(F.count("*").alias("n"), F.min("text").alias("text"))
    return a.where((F.col("n") == 1) & F.startswith("text", F.lit(title))).select("document")


def job_timelines(events: DataFrame) -> DataFrame:
    """job_id, timeline of events (job_id, at, status): (at, status) in order, with the seconds from first to last."""
    g = events.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("at", "status"))).alias("timeline"), F.min("at").alias("first"), F.max("at").alias("last"))
    return g.select("job_id", "timeline", (F.unix_timestamp("last") - F.unix_timestamp("first")).alias("seconds"))


def expired(rows: DataFrame, at: str, days: int, today: str) -> DataFrame:
    """Rows older than a retention of so many days."""
    return rows.where(F.col(at) < F.date_sub(F.to_date(F.lit(today)), days))
