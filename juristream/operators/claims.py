"""Public claims about the law: evidence, heuristic inference, clusters, dual-time verdicts, risk, alerts and clarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juristream.functions import arrow
from juristream.functions import text as T
from juristream.operators.lineage import cut

# Markers of denial and of matters that the law leaves open, with and without accents.
DENIALS = ("khong dung", "không đúng", "khong phai", "không phải", "trai voi", "trái với", "mau thuan", "mâu thuẫn", "sai voi", "sai với")
OPEN_MATTERS = ("chua duoc quy dinh ro", "chưa được quy định rõ", "chua du can cu", "chưa đủ căn cứ")
CONFIDENT, CLUSTER = 0.70, 0.84
# Weights of risk factors, reach by kind of source, and severities.
RISK = {"legal_impact": 0.25, "source_reach": 0.20, "contradiction": 0.15, "velocity": 0.15, "diversity": 0.10, "recent_change": 0.10, "engagement": 0.05}
PROVENANCE = 0.30
REACH = {"news": 0.70, "social_post": 0.55, "video": 0.60, "forum": 0.45, "comment": 0.35}
CRITICAL = r"(?iU)\b(hình sự|phạt tù|đình chỉ|tước|cấm|truy cứu)\b"
MONEY_OR_TERM = r"(?iU)\b(phạt|cấm|xử phạt|truy thu|triệu|tỷ|đồng|%|thời hạn|ngày|tháng)\b"
SEVERITIES = ((0.85, "critical"), (0.70, "high"), (0.50, "medium"))


def infer(premise: Column, hypothesis: Column) -> Column:
    """struct(label, score, needs_review) by rules: invented figures contradict, then open matters, denials, word overlap."""
    long = lambda t: F.filter(T.tokens(t), lambda w: F.length(w) > 1)
    out = lambda label, score, review: F.struct(F.lit(label).alias("label"), score.cast("double").alias("score"), F.lit(review).alias("needs_review"))

    def judged(x: Column) -> Column:
        overlap, numbers = x["overlap"], x["numbers"]
        high = F.least(F.lit(0.95), overlap)
        return (
            F.when(numbers == "contradiction", out("mau_thuan", F.lit(0.92), False))
            .when(x["empty"], out("khong_ro", F.lit(0.0), True))
            .when(T.contains_any(hypothesis, OPEN_MATTERS), out("khong_ro", F.lit(0.85), False))
            .when(T.contains_any(hypothesis, DENIALS) & (overlap >= 0.45), F.struct(F.lit("mau_thuan").alias("label"), high.alias("score"), (high < CONFIDENT).alias("needs_review")))
            .when((overlap >= x["needed"]) & (numbers != "mismatch_soft"), out("khop", high, False))
            .when(numbers == "mismatch_soft", out("khong_ro", F.greatest(F.lit(0.2), overlap), True))
            .otherwise(out("khong_ro", F.greatest(F.lit(0.1), overlap), True))
        )

    def counted(x: Column) -> Column:
        overlap = F.size(F.filter(x["h"], lambda w: F.array_contains(x["p"], w))) / F.size(x["h"])
        needed = F.when(F.size(x["h_amounts"]) > 0, 0.72).otherwise(0.55)
        return F.struct(overlap.alias("overlap"), T.amounts_agree(x["p_amounts"], x["h_amounts"]).alias("numbers"), needed.alias("needed"), ((F.size(x["p"]) == 0) | (F.size(x["h"]) == 0)).alias("empty"))

    # Words, overlap and figures are used several times, the premise's words for every word: transform() over one row binds them to a variable.
    found = F.struct(F.array_distinct(long(premise)).alias("p"), long(hypothesis).alias("h"), T.claim_amounts(premise).alias("p_amounts"), T.claim_amounts(hypothesis).alias("h_amounts"))
    return F.transform(F.transform(F.array(found), counted), judged)[0]


def evidence_violations(claims: DataFrame) -> DataFrame:
    """ykien_id and reasons of claims whose span, offsets, hash or provenance don't hold against post_content."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    span = F.expr("substring(post_content, evidence_start + 1, evidence_end - evidence_start)")
    reasons = F.array_compact(
        F.array(
            *[F.when(blank(c), F.lit(f"{c}_missing")) for c in ("claim_text", "evidence_span", "canonical_url", "legal_anchor_id")],
            F.when(~F.coalesce(F.regexp_like("content_hash", F.lit(r"^[0-9a-f]{64}$")), F.lit(False)), F.lit("hash_malformed")),
            F.when(~F.col("content_hash").eqNullSafe(T.checksum(F.col("post_content"))), F.lit("hash_differs")),
            F.when(~span.eqNullSafe(F.col("evidence_span")), F.lit("offsets_differ")),
            F.when(~F.coalesce(F.contains("evidence_span", "claim_text"), F.lit(False)), F.lit("claim_not_in_span")),
        )
    )
    return claims.select("ykien_id", reasons.alias("reasons")).where(F.size("reasons") > 0)


def content_items(posts: DataFrame) -> DataFrame:
    """Posts (platform, external_id, text, published, likes, comments, shares) with source type, content hash, engagement and a stable id."""
    kind = F.when(F.col("platform").isin("news", "rss"), "news").when(F.col("platform") == "youtube", "video").when(F.col("platform").contains("comment"), "comment").when(F.col("platform") == "forum", "forum").otherwise("social_post")
    counts = sum((F.greatest(F.lit(0.0), F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in ("likes", "comments", "shares")), F.lit(0.0))
    return posts.select(
        T.stable_id("post", F.col("platform"), F.col("external_id")).alias("content_id"), "platform", "external_id", kind.alias("source_type"), T.canonical(F.col("text")).alias("text"), T.checksum(F.col("text")).alias("content_hash"), "published", F.least(F.lit(1.0), counts / 10_000).alias("engagement_score")
    )


def first_by_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key, by the order given."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


class Founders:
    """The first claims of clusters, by their words.

    A similarity of CLUSTER needs a word F1 of at least (CLUSTER - 0.3) / 0.7, so a claim of n words shares at least `need` of them
    with any founder it may join: one of its n - need + 1 rarest, under which alone founders are looked up. What the words and lengths
    of a pair rule out is not compared by character.
    """

    def __init__(self):
        self.texts: list[str] = []
        self.words: list[set[str]] = []
        self.by_word: dict[str, list[int]] = {}

    def place(self, text: str) -> tuple[str, float]:
        """The founder that a claim joins, and how similar it is; itself and 1 if it founds a cluster."""
        own = set(text.split())
        f1 = (CLUSTER - 0.3) / 0.7
        need = math.ceil(f1 * len(own) / (2 - f1) - 1e-9)
        rare = sorted(own, key=lambda w: (len(self.by_word.get(w, ())), w))[: len(own) - need + 1]
        best, value = None, 0.0
        for i in sorted({i for w in rare for i in self.by_word.get(w, ())}):
            other = self.words[i]
            most = 0.7 * 2 * len(own & other) / (len(own) + len(other)) + 0.3 * 2 * min(len(text), len(self.texts[i])) / (len(text) + len(self.texts[i]))
            if most < max(CLUSTER, value) - 1e-6:
                continue
            if (s := arrow.similarity(text, self.texts[i])) >= CLUSTER and s > value:
                best, value = i, s
        if best is not None:
            return self.texts[best], value
        self.add(text)
        return text, 1.0

    def add(self, text: str) -> None:
        own = set(text.split())
        for w in own:
            self.by_word.setdefault(w, []).append(len(self.texts))
        self.texts.append(text)
        self.words.append(own)


GROUP = ["topic", "legal_anchor_id", "signature"]


def cluster_claims(claims: DataFrame, *, prefix: str = "misconception", batch: int = 8192, most: int = 65_536) -> DataFrame:
    """Claims (ykien_id, topic, legal_anchor_id, claim_text, created_at, nli_label, nli_score) that contradict with confidence, in clusters.

    In order of (created_at, ykien_id) a claim joins the cluster of the same topic, anchor, numbers and negations whose first claim is most similar,
    from 0.84 on, the earlier one in a tie; else it founds one. Equal claims are decided once. Groups of these four with at most `batch` claims are walked in
    order; larger ones are decided in rounds (_in_rounds), which gives the same. Returns ykien_id, misconception_id (a UUID named
    prefix:topic:anchor:claim of the first claim), similarity, created.
    """
    kept = claims.where((F.col("nli_label") == "mau_thuan") & (F.col("nli_score") >= CONFIDENT))
    named = kept.withColumn("normalized", arrow.normalized_claim_nfkc(F.col("claim_text")))
    marks = T.claim_signatures(F.col("normalized"))
    named = named.withColumn("signature", F.concat_ws("|", F.array_join(marks["numbers"], " "), F.array_join(marks["negations"], " ")))
    # Null topics and anchors are groups too: they are named, so that joins find them.
    named = cut(named.select("ykien_id", "created_at", "normalized", F.coalesce("topic", F.lit("None")).alias("topic"), F.coalesce("legal_anchor_id", F.lit("None")).alias("legal_anchor_id"), "signature"))
    keys = [*GROUP, "normalized"]
    distinct = cut(named.groupBy(*keys).agg(F.min(F.struct("created_at", "ykien_id")).alias("first")))
    large = cut(distinct.groupBy(*GROUP).agg(F.count("*").alias("n")).where(F.col("n") > batch).select(*GROUP))
    n = large.count()
    if n:
        near = F.broadcast(large) if n <= 100_000 else large
        assigned = _walked(distinct.join(near, GROUP, "left_anti")).unionByName(_in_rounds(distinct.join(near, GROUP, "left_semi"), batch, most))
    else:
        assigned = _walked(distinct)
    rows = named.join(assigned, keys).join(distinct, keys)
    founder = (F.col("first.ykien_id") == F.col("ykien_id")) & (F.col("similarity") == 1.0)
    name = T.uuid5(F.concat(F.lit(prefix + ":"), "topic", F.lit(":"), "legal_anchor_id", F.lit(":"), "founder"))
    return rows.select("ykien_id", name.alias("misconception_id"), "similarity", founder.alias("created"))


def _walked(distinct: DataFrame) -> DataFrame:
    """GROUP, normalized, founder, similarity: each group's claims in order of `first`. Sorted partitions stream through: a task holds one group's founders."""

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, founders = None, Founders()
        for pdf in batches:
            found = []
            for *key, text in zip(pdf["topic"], pdf["legal_anchor_id"], pdf["signature"], pdf["normalized"], strict=True):
                if key != now:
                    now, founders = key, Founders()
                found.append(founders.place(text))
            yield pdf.assign(founder=[f for f, _ in found], similarity=[v for _, v in found])

    ordered = distinct.select(*GROUP, "normalized", "first").repartition(*GROUP).sortWithinPartitions(*GROUP, "first").select(*GROUP, "normalized")
    return ordered.mapInPandas(assign, "topic string, legal_anchor_id string, signature string, normalized string, founder string, similarity double")


def _in_rounds(distinct: DataFrame, batch: int, most: int) -> DataFrame:
    """What _walked() gives, for groups of any size.

    A round takes each group's earliest undecided claims. None of them is similar to a founder so far, so walking them alone tells which of them found
    clusters. The other undecided claims that are similar to a new founder will join some cluster and leave; the rest is the next round's. At the end
    members are compared with the founders before them. Both comparisons are a similarity join under rare words: pairs are of a claim and a founder,
    never of two members.
    """
    keys = [*GROUP, "normalized"]
    words = F.filter(F.array_distinct(F.split("normalized", " ")), lambda w: w != "")
    each = distinct.select(*keys, "first", F.explode_outer(words).alias("word"))
    weights = each.groupBy(*GROUP, "word").agg(F.count("*").alias("df"))
    sorted_ = each.join(weights, [*GROUP, "word"], "left").groupBy(*keys).agg(F.any_value("first").alias("first"), F.transform(F.array_sort(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("df", "word")))), lambda x: x["word"]).alias("words"))
    rows = cut(sorted_)
    undecided, founders, size = rows, None, batch
    while undecided.limit(1).count():
        order = Window.partitionBy(*GROUP).orderBy("first")
        now = cut(undecided.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= size).drop("_n"))
        new = cut(now.join(_walked(now).where("founder = normalized").select(*keys), keys, "left_semi"))
        founders = new if founders is None else founders.unionByName(new)
        left = undecided.join(now.select(*keys), keys, "left_anti")
        undecided = cut(left.join(_similar(left, new).select(*keys), keys, "left_anti"))
        size = min(most, 2 * size)
    founded = founders.select(*keys, F.col("normalized").alias("founder"), F.lit(1.0).alias("similarity"))
    members = rows.join(founders.select(*keys), keys, "left_anti")
    best = _similar(members, founders).groupBy(*keys).agg(F.min_by("founder", F.struct(-F.col("similarity"), "before")).alias("founder"), F.max("similarity").alias("similarity"))
    return founded.unionByName(best)


def _similar(claims: DataFrame, founders: DataFrame) -> DataFrame:
    """GROUP, normalized, founder, similarity, before (its place in the order) of claims with founders before them in their group, from CLUSTER on.

    A claim of n words shares at least `need` of them with any text so similar (see Founders), so the two meet at one of their n - need + 1 rarest. The pair is
    formed at the first such word alone, and compared by character only if words and lengths allow the similarity."""
    f1 = (CLUSTER - 0.3) / 0.7
    rare = lambda d: d.withColumn("_rare", F.slice("words", 1, F.size("words") - F.ceil(f1 * F.size("words") / (2 - f1) - 1e-9).cast("int") + 1))
    a = rare(claims.where("size(words) > 0")).select(*GROUP, "normalized", "first", "words", "_rare", F.explode("_rare").alias("_word"))
    b = rare(founders.where("size(words) > 0")).select(*GROUP, F.col("normalized").alias("founder"), F.col("first").alias("_first"), F.col("words").alias("_words"), F.col("_rare").alias("_other"), F.explode("_rare").alias("_word"))
    b = F.broadcast(b) if b.limit(200_001).count() <= 200_000 else b
    met = a.join(b, [*GROUP, "_word"]).where((F.col("_first") < F.col("first")) & (F.element_at(F.array_intersect("_rare", "_other"), 1) == F.col("_word")))
    share = 2 * F.size(F.array_intersect("words", "_words")) / (F.size("words") + F.size("_words"))
    long = 2 * F.least(F.length("normalized"), F.length("founder")) / (F.length("normalized") + F.length("founder"))
    likely = met.where(0.7 * share + 0.3 * long >= CLUSTER - 1e-6)
    scored = likely.select(*GROUP, "normalized", "founder", arrow.claim_similarity(F.col("normalized"), F.col("founder")).alias("similarity"), F.col("_first").alias("before"))
    return scored.where(F.col("similarity") >= CLUSTER)


def verdict(hist: Column, curr: Column) -> Column:
    """The verdict of two checks, structs (lineage_id, provision_id, label, score, needs_review), before and now."""
    unsure = hist["needs_review"] | curr["needs_review"] | (hist["score"] < CONFIDENT) | (curr["score"] < CONFIDENT)
    other = hist["provision_id"] != curr["provision_id"]
    return (
        F.when(hist["provision_id"].isNull() | curr["provision_id"].isNull(), "NEEDS_REVIEW")
        .when(hist["lineage_id"] != curr["lineage_id"], "NEEDS_REVIEW")
        .when(unsure, "NEEDS_REVIEW")
        .when(~other & (hist["label"] != curr["label"]), "NEEDS_REVIEW")
        .when((hist["label"] == "khop") & (curr["label"] == "mau_thuan") & other, "OUTDATED_BUT_PREVIOUSLY_TRUE")
        .when(curr["label"] == "khop", "SUPPORTED")
        .when((curr["label"] == "mau_thuan") & (hist["label"] == "mau_thuan"), "CONTRADICTED")
        .otherwise("UNVERIFIABLE")
    )


def cluster_verdicts(evaluations: DataFrame) -> DataFrame:
    """misconception_id, verdict: review if any needs it, the one verdict if all agree, else PARTIALLY_INCORRECT."""
    v = F.collect_set("verdict")
    grouped = evaluations.groupBy("misconception_id").agg(v.alias("all"))
    one = F.when(F.array_contains("all", "NEEDS_REVIEW"), "NEEDS_REVIEW").when(F.size("all") == 1, F.element_at("all", 1)).otherwise("PARTIALLY_INCORRECT")
    return grouped.select("misconception_id", one.alias("verdict"))


def severity(score: Column) -> Column:
    out = F.lit("low")
    for least, name in reversed(SEVERITIES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def volume_severity(volume: Column, threshold: int) -> Column:
    return F.when(volume >= 3 * threshold, "high").when(volume >= 2 * threshold, "medium").otherwise("low")


def risk_scores(occurrences: DataFrame, current_date: str) -> DataFrame:
    """Risk of clusters from occurrences (misconception_id, ykien_id, content_id, content_hash, source_type, published_at, engagement_score, provenance_complete,
    legal_text, label, score, effective_from): the factors, risk_score and severity. Syndicated copies of one hash count once."""
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    identity = F.coalesce(F.nullif(F.trim("content_hash"), F.lit("")), F.col("content_id"), F.col("ykien_id"))
    reach = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in REACH.items() for x in (k, v)]), F.col("source_type")), F.lit(0.4))
    impact = F.when(F.regexp_like("legal_text", F.lit(CRITICAL)), 0.9).when(F.regexp_like("legal_text", F.lit(MONEY_OR_TERM)), 0.7).otherwise(0.45)
    age = F.date_diff(F.to_date(F.lit(current_date)), F.col("effective_from"))
    recent = F.when(F.col("effective_from").isNull(), 0.0).when(age <= 90, 1.0).when(age <= 365, 0.5).otherwise(0.0)
    rows = occurrences.withColumn("_who", identity).withColumn("_has_hash", F.trim("content_hash") != "")
    # By source first, so a body that was copied a million times is one row before the clusters are formed.
    source = rows.groupBy("misconception_id", "_who").agg(
        F.min("published_at").alias("first"), F.bool_or(F.coalesce("_has_hash", F.lit(False))).alias("hashed"), F.count("*").alias("n"), F.max(reach).alias("reach"), F.max(F.when(F.col("legal_text").isNotNull(), impact)).alias("impact"),
        F.max(F.when(F.col("label") == "mau_thuan", F.col("score"))).alias("contradiction"), F.max(recent).alias("recent"), F.sum(F.coalesce("engagement_score", F.lit(0.0))).alias("engagement"), F.count_if(~F.coalesce("provenance_complete", F.lit(True))).alias("incomplete"),
    )
    g = source.groupBy("misconception_id").agg(
        F.count_if("hashed").alias("hashes"), F.sum("n").alias("n"), F.max("reach").alias("reach"), F.max("impact").alias("impact"), F.max("contradiction").alias("contradiction"), F.max("recent").alias("recent"),
        F.sum("engagement").alias("engagement"), F.sum("incomplete").alias("incomplete"), F.count("*").alias("sources"), ((F.unix_timestamp(F.max("first")) - F.unix_timestamp(F.min("first"))) / 3600).alias("hours"),
    )
    volume = F.when(F.col("hashes") > 0, F.col("hashes")).otherwise(F.col("n"))
    hours = F.greatest(F.lit(1.0), F.when(F.col("sources") > 1, F.col("hours")).otherwise(24.0))
    factors = {
        "legal_impact": F.coalesce("impact", F.lit(0.45)), "source_reach": F.coalesce("reach", F.lit(0.4)), "contradiction": F.coalesce("contradiction", F.lit(0.0)), "velocity": clamp(volume / hours / 0.5),
        "diversity": clamp(volume / 3), "recent_change": F.coalesce("recent", F.lit(0.0)), "engagement": clamp(F.col("engagement") / F.col("n")), "provenance_penalty": clamp(F.col("incomplete") / F.col("n")),
    }
    out = g.select("misconception_id", *[F.round(v, 6).alias(k) for k, v in factors.items()])
    total = sum((F.round(F.col(k) * w, 6) for k, w in RISK.items()), F.lit(0.0)) - PROVENANCE * F.col("provenance_penalty")
    return out.withColumn("risk_score", F.round(clamp(total), 6)).withColumn("severity", severity(F.col("risk_score")))


def alerts(signals: DataFrame, *, threshold: int, recent: DataFrame | None = None) -> DataFrame:
    """Alerts from signals (topic, khoan_id, misconception_id, ykien_id, bai_dang_id, claim_text, evidence_span, post_content, post_url, label, score, needs_review,
    content_hash, risk_score), one per (misconception, topic, clause) that reaches `threshold` distinct signals.

    Only signals with whole provenance and a score that counts take part; equal (hash, misconception, clause, claim) count once.
    Keys of `recent` (dedupe_key) are in their cool-down and give none.
    """
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    whole = ~(blank("bai_dang_id") | blank("ykien_id") | blank("claim_text") | blank("evidence_span") | blank("post_url") | blank("khoan_id"))
    sound = whole & F.coalesce(F.regexp_like(F.trim("content_hash"), F.lit(r"(?i)^[0-9a-f]{64}$")) & F.contains("post_content", "evidence_span"), F.lit(False))
    counts = (F.col("score") >= CONFIDENT) | (F.coalesce("needs_review", F.lit(False)) & (F.col("score") >= 0.1))
    fit = signals.where(sound & counts & F.col("label").isin("mau_thuan", "khong_ro")).withColumn("content_hash", F.lower(F.trim("content_hash")))
    key = ["misconception_id", "topic", "khoan_id"]
    once = fit.groupBy(*key, "content_hash", "claim_text").agg(F.max("risk_score").alias("risk_score"), F.min("ykien_id").alias("ykien_id"))
    groups = once.groupBy(*key).agg(F.count("*").alias("volume"), F.max("risk_score").alias("risk_score")).where(F.col("volume") >= threshold)
    dedupe = F.when(F.col("misconception_id").isNotNull(), F.concat(F.lit("misconception:"), "misconception_id")).otherwise(F.concat_ws(":", "topic", "khoan_id"))
    out = groups.withColumn("dedupe_key", dedupe).withColumn("severity", F.when(F.col("risk_score").isNotNull(), severity(F.col("risk_score"))).otherwise(volume_severity(F.col("volume"), threshold)))
    return out if recent is None else out.join(recent.select("dedupe_key").distinct(), "dedupe_key", "left_anti")


def clarity(checks: DataFrame, key: str, label: str, *, least: int = 1, unclear: tuple[str, ...] = ("mau_thuan", "khong_ro")) -> DataFrame:
    """key, n, risk (the share of unclear labels), rank_value = risk * ln(n + 1), of keys with at least `least` checks."""
    g = checks.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(label).isin(*unclear)).alias("n_unclear")).where(F.col("n") >= least)
    g = g.withColumn("risk", F.col("n_unclear") / F.col("n"))
    return g.withColumn("rank_value", F.round(F.col("risk") * F.ln(F.col("n") + 1), 9))


def topic_clarity(posts: DataFrame, checks: DataFrame) -> DataFrame:
    """topic, volume, needs_review, risk: unclear share of checks (post_id, label); of posts (post_id, topic, needs_review) that wait for review where a topic
    has no checks; 0 without posts. Posts are counted once however many checks they have."""
    p = posts.groupBy("topic").agg(F.countDistinct("post_id").alias("volume"), F.countDistinct(F.when(F.col("needs_review"), F.col("post_id"))).alias("needs_review"))
    c = checks.join(posts.select("post_id", "topic").distinct(), "post_id").groupBy("topic").agg(F.count("*").alias("n"), F.count_if(F.col("label").isin("mau_thuan", "khong_ro")).alias("unclear"))
    risk = F.when(F.col("n") > 0, F.col("unclear") / F.col("n")).when(F.col("volume") > 0, F.col("needs_review") / F.col("volume")).otherwise(0.0)
    return p.join(c, "topic", "left").select("topic", "volume", "needs_review", risk.alias("risk"))


def topic_popularity(topics: DataFrame, links: DataFrame, posts: DataFrame) -> DataFrame:
    """topic, n_posts: linked posts (topic, post_id), or posts that name the topic themselves where none is linked; topics without any have 0."""
    a = links.groupBy("topic").agg(F.countDistinct("post_id").alias("linked"))
    b = posts.groupBy("topic").agg(F.countDistinct("post_id").alias("named"))
    n = F.when(F.coalesce("linked", F.lit(0)) > 0, F.col("linked")).otherwise(F.coalesce("named", F.lit(0)))
    return topics.select("topic").distinct().join(a, "topic", "left").join(b, "topic", "left").select("topic", n.alias("n_posts"))


def faithfulness(answers: DataFrame) -> DataFrame:
    """answer_id, n_risky, n_supported, score over (answer_id, claim, premise): a claim with figures or duties is supported if any premise
    entails it and none contradicts it. An answer without risky claims scores 1."""
    risky = F.regexp_like("claim", F.lit(r"\d")) | T.contains_any(F.col("claim"), ("phạt", "cấm", "phải", "thời hạn", "mức"))
    checked = answers.withColumn("risky", risky).withColumn("r", infer(F.col("premise"), F.col("claim")))
    per = checked.groupBy("answer_id", "claim", "risky").agg(F.bool_or(F.col("r.label") == "khop").alias("yes"), F.bool_or((F.col("r.label") == "mau_thuan") & ~F.col("r.needs_review")).alias("no"))
    g = per.groupBy("answer_id").agg(F.count_if("risky").alias("n_risky"), F.count_if(F.col("risky") & F.col("yes") & ~F.col("no")).alias("n_supported"))
    return g.withColumn("score", F.when(F.col("n_risky") > 0, F.col("n_supported") / F.col("n_risky")).otherwise(1.0))


def citation_gate(citations: DataFrame, provisions: DataFrame) -> DataFrame:
    """answer_id, claim_id, verdict of citations (answer_id, claim_id, claim, provision_id, text_checksum, quote) against provisions in force: the first failure
    of unknown provision, checksum, quote, support; else valid."""
    p = provisions.select("provision_id", F.col("text_checksum").alias("_sum"), F.col("text").alias("_text"))
    r = infer(F.col("_text"), F.col("claim"))
    code = (
        F.when(F.col("_sum").isNull(), "CITATION_NOT_EFFECTIVE")
        .when(~F.col("text_checksum").eqNullSafe(F.col("_sum")), "CHECKSUM_MISMATCH")
        .when(~F.coalesce(F.contains(T.canonical(F.col("_text")), T.canonical(F.col("quote"))), F.lit(False)), "QUOTE_NOT_FOUND")
        .when(r["label"] != "khop", "CLAIM_NOT_SUPPORTED")
        .otherwise("VALID")
    )
    return citations.join(p, "provision_id", "left").select("answer_id", "claim_id", "provision_id", code.alias("verdict"))
