"""Contracts between rows: citations of answers, reviews of amendments, and predicates on URLs, JSON and visibility.

Violations come back as rows with the ordered reasons; a table without any is empty.
"""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as D

from juristream.functions import text as T
from juristream.operators.lineage import dealt

# Hosts that are never public, and the states of a review that need whom and when.
LOCAL_HOSTS = ("localhost",)
LOCAL_SUFFIXES = (".localhost", ".local", ".internal")
SUBMITTED, DECIDED = ("in_review", "approved", "rejected", "committed"), ("approved", "rejected", "committed")
SHA256 = r"^[0-9a-fA-F]{64}$"


#: All reasons, in the order in which they are returned; a row's reasons are bits of one number until then.
REASONS = (
    "answer_with_reason", "answer_without_content", "candidate_of_nothing", "candidate_of_one_version", "candidate_repeated", "checksum_malformed", "citation_id_repeated", "citation_not_in_force",
    "citations_repeated", "claim_id_repeated", "claim_not_entailed", "claims_repeated", "commit_before_its_time", "commit_missing", "coordinates_differ", "decision_without_reviewer",
    "draft_with_submission", "interval", "new_only_not_added", "no_candidate", "node_id_differs", "not_reciprocal", "old_only_not_removed", "pair_added_or_removed",
    "pending_with_reviewer", "refusal_with_content", "reviewer_missing", "submission_missing", "unknown_citation", "unknown_claim",
)


def _reasons(*marked: tuple[Column, str]) -> Column:
    return sum((F.when(F.coalesce(c, F.lit(False)), F.lit(1 << REASONS.index(name))).otherwise(F.lit(0)).cast("long") for c, name in marked), F.lit(0).cast("long"))


def _any_of(rows: DataFrame, key: str, n: int) -> DataFrame:
    """key, reasons: the sorted distinct reasons of rows (key, reasons), of which there are some n."""
    every = dealt(rows.where("reasons > 0"), n, key).groupBy(key).agg(F.bit_or("reasons").alias("reasons"))
    return every.select(key, F.array_compact(F.array(*[F.when(F.col("reasons").bitwiseAND(F.lit(1 << i)) != 0, F.lit(name)) for i, name in enumerate(REASONS)])).alias("reasons"))


def citation_violations(answers: DataFrame, claims: DataFrame, citations: DataFrame) -> DataFrame:
    """answer_id, reasons of answers whose claims and citations don't hold together.

    answers: answer_id, status (answered or refused), as_of, answer, reason_code. claims: answer_id, claim_id, support_status, citation_ids.
    citations: answer_id, citation_id, node_id, lineage_id, article, clause, point, effective_from, effective_to, text_checksum, source_checksum,
    supports_claim_ids. A claim names the citations that support it and these name the claim; either side alone breaks the contract. A refusal has a
    reason and nothing else, an answer has claims that are all entailed, and citations in force whose ids follow from what they cite.
    """
    key = "answer_id"
    # One scan of keys tells into how many parts everything is dealt.
    n = answers.select(key).union(claims.select(key)).union(citations.select(key)).count()
    answers, claims, citations = (dealt(d, n, key) for d in (answers, claims, citations))
    n_claims = claims.groupBy(key).agg(F.count("*").alias("n_claims"), F.countDistinct("claim_id").alias("d_claims"), F.bool_or(~F.col("support_status").eqNullSafe("entailed")).alias("loose"))
    n_citations = citations.groupBy(key).agg(F.count("*").alias("n_citations"), F.countDistinct("citation_id").alias("d_citations"))
    a = answers.join(n_claims, key, "left").join(n_citations, key, "left").na.fill(0, ["n_claims", "d_claims", "n_citations", "d_citations"])
    refused, blank = F.col("status") == "refused", F.coalesce(F.trim("answer") == "", F.lit(True))
    some = (F.col("n_claims") > 0) | (F.col("n_citations") > 0)
    whole = a.select(key, _reasons(
        (F.col("n_claims") > F.col("d_claims"), "claim_id_repeated"),
        (F.col("n_citations") > F.col("d_citations"), "citation_id_repeated"),
        (refused & (~blank | some | F.col("reason_code").isNull()), "refusal_with_content"),
        (~refused & (blank | (F.col("n_claims") == 0) | (F.col("n_citations") == 0)), "answer_without_content"),
        (~refused & F.col("reason_code").isNotNull(), "answer_with_reason"),
        (~refused & F.col("loose"), "claim_not_entailed"),
    ).alias("reasons"))

    repeated = lambda c: F.size(c) > F.size(F.array_distinct(c))
    parts = T.lineage_parts(F.col("lineage_id"))
    dated = citations.join(answers.select(key, "as_of", "status"), key)
    in_force = (F.col("effective_from") <= F.col("as_of")) & (F.col("effective_to").isNull() | (F.col("as_of") < F.col("effective_to")))
    same = lambda c: F.col(c).eqNullSafe(parts[c])
    single = dated.select(key, _reasons(
        (F.col("effective_to") <= F.col("effective_from"), "interval"),
        (~F.col("text_checksum").rlike(SHA256) | ~F.coalesce(F.col("source_checksum"), F.lit("0" * 64)).rlike(SHA256), "checksum_malformed"),
        (~(same("article") & same("clause") & same("point")), "coordinates_differ"),
        (~F.col("node_id").eqNullSafe(T.version_id(F.col("lineage_id"), F.col("effective_from"), F.col("text_checksum"))), "node_id_differs"),
        (repeated(F.col("supports_claim_ids")), "claims_repeated"),
        ((F.col("status") != "refused") & ~in_force, "citation_not_in_force"),
    ).alias("reasons"))
    twice = claims.select(key, _reasons((repeated(F.col("citation_ids")), "citations_repeated")).alias("reasons"))

    named = claims.select(key, "claim_id", F.explode("citation_ids").alias("citation_id"), F.lit(1).alias("by"))
    backed = citations.select(key, F.explode("supports_claim_ids").alias("claim_id"), "citation_id", F.lit(2).alias("by"))
    known_claims = claims.select(key, "claim_id").distinct().withColumn("has_claim", F.lit(True))
    known_citations = citations.select(key, "citation_id").distinct().withColumn("has_citation", F.lit(True))
    at_claim, at_citation = [key, "claim_id"], [key, "citation_id"]
    # Sides of a link are joined by grouping: 3 is both. An id that is null is never known, whatever meets there.
    links = dealt(named.unionByName(backed), n, *at_claim).groupBy(key, "claim_id", "citation_id").agg(F.bit_or("by").alias("by"))
    links = links.join(dealt(known_claims, n, *at_claim), at_claim, "left")
    links = dealt(links, n, *at_citation).join(dealt(known_citations, n, *at_citation), at_citation, "left")
    linked = links.select(key, _reasons(
        (F.col("has_citation").isNull(), "unknown_citation"),
        (F.col("has_claim").isNull(), "unknown_claim"),
        (F.col("has_citation") & F.col("has_claim") & (F.col("by") < 3), "not_reciprocal"),
    ).alias("reasons"))
    return _any_of(whole.unionByName(single).unionByName(twice).unionByName(linked), key, n)


def review_violations(batches: DataFrame, candidates: DataFrame) -> DataFrame:
    """batch_id, reasons of review batches (batch_id, status, submitted_by, submitted_at, reviewed_by, reviewed_at, commit_key, committed_by, committed_at,
    commit_result) and their candidates (batch_id, candidate_id, old_provision_id, new_provision_id, change_type, decision, reviewed_by, reviewed_at) that contradict
    their own state: who acted and when is there from the step on that needs it, and not before."""
    key = "batch_id"
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    either = lambda *cs: F.coalesce(*[F.col(c).cast("string") for c in cs]).isNotNull()
    rows = batches.select(key).union(candidates.select(key)).count()
    batches, candidates = (dealt(d, rows, key) for d in (batches, candidates))
    n = candidates.groupBy(key).agg(F.count("*").alias("n"), F.countDistinct("candidate_id").alias("d"))
    status = F.col("status")
    committed = both("commit_key", "committed_by") & both("committed_at", "commit_result")
    whole = batches.join(n, key, "left").select(key, _reasons(
        (F.coalesce("n", F.lit(0)) == 0, "no_candidate"),
        (F.col("n") > F.col("d"), "candidate_repeated"),
        ((status == "draft") & either("submitted_by", "submitted_at"), "draft_with_submission"),
        (status.isin(*SUBMITTED) & ~both("submitted_by", "submitted_at"), "submission_missing"),
        (status.isin(*DECIDED) & ~both("reviewed_by", "reviewed_at"), "reviewer_missing"),
        ((status == "committed") & ~committed, "commit_missing"),
        ((status != "committed") & either("commit_key", "committed_by", "committed_at", "commit_result"), "commit_before_its_time"),
    ).alias("reasons"))
    old, new, kind = F.col("old_provision_id"), F.col("new_provision_id"), F.col("change_type")
    single = candidates.select(key, _reasons(
        (old.isNull() & new.isNull(), "candidate_of_nothing"),
        (old == new, "candidate_of_one_version"),
        (old.isNull() & new.isNotNull() & (kind != "ADDED"), "new_only_not_added"),
        (new.isNull() & old.isNotNull() & (kind != "REMOVED"), "old_only_not_removed"),
        (old.isNotNull() & new.isNotNull() & kind.isin("ADDED", "REMOVED"), "pair_added_or_removed"),
        ((F.col("decision") == "pending") & either("reviewed_by", "reviewed_at"), "pending_with_reviewer"),
        ((F.col("decision") != "pending") & ~both("reviewed_by", "reviewed_at"), "decision_without_reviewer"),
    ).alias("reasons"))
    return _any_of(whole.unionByName(single), key, rows)


def public_url(url: Column) -> Column:
    """Whether a URL may be fetched as far as its text says: http or https, no credentials, usual ports, a host that is neither local nor a private,
    reserved or loopback address. What a name resolves to is not looked up."""
    pattern = r"^(?i)(https?)://([^/?#]*)"
    value = F.trim(F.coalesce(url, F.lit("")))
    authority = F.lower(F.regexp_extract(value, pattern, 2))
    host = F.regexp_replace(F.regexp_replace(authority, r":\d*$", ""), r"\.$", "")
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    private = r"^(?:0|10|127|22[4-9]|23\d|24\d|25[0-5])\.|^169\.254\.|^192\.168\.|^172\.(?:1[6-9]|2\d|3[01])\.|^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^192\.0\.[02]\.|^198\.(?:1[89]|51)\.|^203\.0\.113\.|^\["
    local = host.isin(*LOCAL_HOSTS)
    for suffix in LOCAL_SUFFIXES:
        local = local | F.endswith(host, F.lit(suffix))
    numeric = F.regexp_like(host, F.lit(r"^\d{1,3}(?:\.\d{1,3}){3}$|^\["))
    return F.regexp_like(value, F.lit(pattern)) & (host != "") & ~F.contains(authority, F.lit("@")) & port.isin("", "80", "443") & ~local & ~(numeric & F.regexp_like(host, F.lit(private)))


def publicly_visible(visibility: Column) -> Column:
    """The older rule: a missing mark counts as public (visible_to() hides such rows)."""
    return F.coalesce(visibility, F.lit("public")) == "public"


def cites_url(citations: Column, url: Column) -> Column:
    """Whether a JSON array of citations has one with this source_url."""
    rows = F.from_json(citations, "array<struct<source_url:string>>")
    return F.coalesce(F.exists(rows, lambda c: c["source_url"] == url), F.lit(False))


def json_kind(value: Column) -> Column:
    """object, array, string, number, boolean or null; null for what is no JSON."""
    v = F.try_parse_json(value)
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit(None).cast("string"))
        .when(F.startswith(kind, F.lit("OBJECT")), "object")
        .when(F.startswith(kind, F.lit("ARRAY")), "array")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null")
        .otherwise("number")
    )


@F.pandas_udf(D.StringType())
def canonical_json_hash(value: pd.Series) -> pd.Series:
    """SHA-256 of JSON with sorted keys, no blanks and plain letters, so that equal requests have equal hashes; null for what is no JSON."""

    def one(text) -> str | None:
        try:
            return hashlib.sha256(json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest() if text is not None else None
        except ValueError:
            return None

    return value.map(one)


def context_rows(texts: DataFrame) -> DataFrame:
    """id, n (from 0), key, passage of the lines '[key] passage' in texts (id, text); lines of another form belong to the passage before."""
    parts = texts.select("id", F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"(?ms)^\[([^\]\n]+)\]\s*(.*?)(?=^\[[^\]\n]+\]|\z)"), 1)).alias("n", "key"), "text")
    body = F.element_at(F.regexp_extract_all("text", F.lit(r"(?ms)^\[([^\]\n]+)\]\s*(.*?)(?=^\[[^\]\n]+\]|\z)"), 2), F.col("n") + 1)
    return parts.select("id", "n", "key", T.canonical(body).alias("passage"))
