"""From posts to alerts in one composition: topic, provision, inference, cluster, risk, alert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juristream.functions import dialogue
from juristream.functions import text as T
from juristream.functions.models import inference
from juristream.operators import claims, retrieval


def review_posts(
    posts: DataFrame, provisions: DataFrame, topics: dict[str, tuple[str, ...]], *, current_date: str, threshold: int = 3, recent: DataFrame | None = None, model: Callable | None = None, infer: Callable[[Column, Column], Column] | None = None
) -> dict[str, DataFrame]:
    """Tables by name: checked (a row per post with its topic, the provision nearest to it, label and score), clusters, risks and alerts.

    posts: platform, external_id, text, published, likes, comments, shares. provisions: provision_id, lineage_id, text, effective_from, in force. A post without a
    topic or a provision that shares a word is left out. Copies of one text under several ids are one source of risk, by their hash.
    """
    items = claims.content_items(posts).withColumn("topic", dialogue.first_topic(F.col("text"), topics)).where("topic IS NOT NULL AND text <> ''")
    near = retrieval.jaccard_link(items.select(F.col("content_id").alias("id"), "text"), provisions.select(F.col("provision_id").alias("id"), "text"), limit=1)
    p = provisions.select(F.col("provision_id").alias("right_id"), "lineage_id", F.col("text").alias("legal_text"), "effective_from")
    linked = items.join(near.select(F.col("left_id").alias("content_id"), "right_id"), "content_id").join(p, "right_id")
    r = infer(F.col("legal_text"), F.col("text")) if infer else inference(F.col("legal_text"), F.col("text"), model)
    checked = linked.withColumn("r", r).select(
        "content_id", F.concat(F.lit("y-"), "content_id").alias("ykien_id"), "platform", "source_type", "text", "content_hash", "published", "engagement_score", "topic", F.col("right_id").alias("provision_id"), "lineage_id", "legal_text", "effective_from", F.col("r.label").alias("label"), F.col("r.score").alias("score"), F.col("r.needs_review").alias("needs_review")
    )
    clusters = claims.cluster_claims(checked.select("ykien_id", "topic", F.col("lineage_id").alias("legal_anchor_id"), F.col("text").alias("claim_text"), F.col("published").alias("created_at"), F.col("label").alias("nli_label"), F.col("score").alias("nli_score")))
    joined = checked.join(clusters.select("ykien_id", "misconception_id"), "ykien_id")
    risks = claims.risk_scores(joined.select("misconception_id", "ykien_id", "content_id", "content_hash", "source_type", F.col("published").alias("published_at"), "engagement_score", F.lit(True).alias("provenance_complete"), "legal_text", "label", "score", "effective_from"), current_date)
    signals = joined.join(risks.select("misconception_id", "risk_score"), "misconception_id").select(
        "topic", F.col("lineage_id").alias("khoan_id"), "misconception_id", "ykien_id", F.col("content_id").alias("bai_dang_id"), F.col("text").alias("claim_text"), F.col("text").alias("evidence_span"), F.col("text").alias("post_content"), F.concat_ws(":", "platform", "content_id").alias("post_url"), "label", "score", "needs_review", "content_hash", "risk_score"
    )
    return {"checked": checked, "clusters": clusters, "risks": risks, "alerts": claims.alerts(signals, threshold=threshold, recent=recent)}


def provenance_gaps(signals: DataFrame) -> DataFrame:
    """ykien_id, missing: which of a signal's fields that alerts rely on are blank or malformed."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    fields = ("bai_dang_id", "ykien_id", "claim_text", "evidence_span", "post_url", "khoan_id")
    missing = F.array_compact(
        F.array(
            *[F.when(blank(c), F.lit(c)) for c in fields],
            F.when(~F.coalesce(F.regexp_like(F.trim("content_hash"), F.lit(r"(?i)^[0-9a-f]{64}$")), F.lit(False)), F.lit("content_hash")),
            F.when(~F.coalesce(F.contains("post_content", "evidence_span"), F.lit(False)), F.lit("evidence_not_in_post")),
        )
    )
    return signals.select("ykien_id", missing.alias("missing")).where(F.size("missing") > 0)


def score_counts(score: Column, needs_review: Column, confident: float = claims.CONFIDENT) -> Column:
    """Whether a signal's score counts: confident, or waiting for review with at least 0.1."""
    return (score >= confident) | (F.coalesce(needs_review, F.lit(False)) & (score >= 0.1))


def topic_slug(topic: Column) -> Column:
    return F.lower(T.canonical(F.coalesce(topic, F.lit(""))))


def candidate_checks(claims_of: DataFrame, candidates: DataFrame, provisions: DataFrame) -> DataFrame:
    """claim_id, provision_id, label, score, needs_review: each claim (claim_id, text) against its candidates (claim_id, provision_id) alone."""
    both = candidates.join(claims_of.select("claim_id", F.col("text").alias("_h")), "claim_id").join(provisions.select("provision_id", F.col("text").alias("_p")), "provision_id")
    return both.withColumn("r", claims.infer(F.col("_p"), F.col("_h"))).select("claim_id", "provision_id", "r.label", "r.score", "r.needs_review")


def first_factors(rows: DataFrame, key: str, position: str, factors: str) -> DataFrame:
    """key, the first factors (an array) by position that aren't empty; null where none are."""
    return rows.groupBy(key).agg(F.expr(f"min_by({factors}, {position}) FILTER (WHERE size({factors}) > 0)").alias(factors))
