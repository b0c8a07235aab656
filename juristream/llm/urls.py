"""Operator 8: URL filters. Host and path rules decide first; gradient-boosted trees on lexical features the rest.

DataFrame functions and Spark's own JVM library of models only. The trees learn from the URLs that a rule decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juristream.llm.common import finished, scope

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are tested one by one on each row; longer lists belong in a table that is joined by host suffix.
MOST_RULES = 1000
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "entropy", "parameters", "marks", "secure", "fragment", "top_rate", "ending_rate")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null or without '://'."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def first_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. rules: (verdict, 'host/path')."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    known = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(r.partition("/")[0]).alias("host"), F.lit("/" + r.partition("/")[2]).alias("path")) for v, r in ordered])
    fits = lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"])
    best = F.get(F.filter(known, fits), F.lit(0))
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def _lexical(rows: DataFrame) -> DataFrame:
    """Adds the features that need only the URL itself, and the two suffixes."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    n = F.greatest(F.length(url), F.lit(1))
    share = lambda c: F.length(F.replace(url, c, F.lit(""))) / n
    entropy = F.aggregate(
        F.array_distinct(F.split(url, "")),
        F.lit(0.0),
        lambda total, c: total + F.when(c == "", 0.0).otherwise(-(1 - share(c)) * F.log2(F.greatest(1 - share(c), F.lit(1e-9)))),
    )
    return rows.select(
        "*",
        F.length(url).cast("double").alias("length"),
        F.length(host).cast("double").alias("host_length"),
        F.length(path).cast("double").alias("path_length"),
        F.regexp_count(path, F.lit("/")).cast("double").alias("depth"),
        F.regexp_count(host, F.lit("[.]")).cast("double").alias("labels"),
        (F.regexp_count(url, F.lit("[0-9]")) / n).alias("digit_ratio"),
        (F.regexp_count(host, F.lit("[0-9]")) / F.greatest(F.length(host), F.lit(1))).alias("host_digit_ratio"),
        entropy.alias("entropy"),
        F.regexp_count(url, F.lit("[?&][^=&#]*=")).cast("double").alias("parameters"),
        F.regexp_count(url, F.lit("[-_%~@]")).cast("double").alias("marks"),
        F.startswith(url, F.lit("https://")).cast("double").alias("secure"),
        F.contains(url, F.lit("#")).cast("double").alias("fragment"),
        F.substring_index(host, ".", -1).alias("top"),
        F.right(path, F.lit(3)).alias("ending"),
    )


def sampled(distinct: DataFrame, counts: dict[float, int], most: int) -> DataFrame:
    """At most `most` (200 at least) of the distinct URLs, those with the smallest hashes of each label; no label is left without any.

    A label has its share of them, and 100 if it has so many. A first cut at twice that share keeps the sort small.
    """
    most, parts, steps = max(most, 200), [], 1 << 30
    least = {label: min(n, 100) for label, n in counts.items()}
    spare = most - sum(least.values())
    rest = max(1, sum(counts.values()) - sum(least.values()))
    for label, n in counts.items():
        quota = min(n, least[label] + int(spare * (n - least[label]) / rest))
        part = distinct.where(F.col("label") == label)
        if quota < n:
            part = part.where(F.pmod(F.xxhash64("url"), F.lit(steps)) < int(min(1.0, 2 * quota / n) * steps))
            part = part.orderBy(F.pmod(F.xxhash64("url"), F.lit(steps)), "url").limit(quota)
        parts.append(part)
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    sample_rows: int = 20_000,
    trees: int = 10,
    depth: int = 4,
    seed: int = 7,
) -> DataFrame:
    """A verdict (allow or block) for every URL: the longest fitting rule's, else the trees'.

    The trees are fitted on at most `sample_rows` of the distinct URLs that rules decide (see sampled), each weighing as
    often as it occurs: a bounded sample, whose share falls as the table grows. All rows are judged. Suffix statistics
    (the smoothed share of block among sample rows with this last host label, or these last three path characters)
    come from the same sample, so their tables have no more rows than it.

    Returns the id column, host, path, rule, verdict and p_block (the trees' probability).

    Null or scheme-less URLs have an empty host and path and are judged by the trees like others; URLs of any length are looked at whole. If
    the rules decide no URL, or all the same way, no tree is fitted and the rest get that one verdict, or allow. Null and repeated ids and equal
    rows are passed on, further columns are ignored whatever their names, an empty table gives an empty one.
    """
    host, path = parts(pages[url_col])
    rows = pages.select(pages[id_col].alias("id"), F.coalesce(pages[url_col], F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("hit", first_rule(F.col("host"), F.col("path"), rules))
    label = (F.col("hit.verdict") == "block").cast("double")
    labelled = rows.where("hit IS NOT NULL").select("url", "host", "path", label.alias("label"))

    # Rules see nothing but the URL, so equal URLs have one label.
    distinct = labelled.groupBy("url").agg(*[F.any_value(c).alias(c) for c in ("host", "path", "label")], F.count("*").cast("double").alias("weight"))
    seen = {r["label"]: r for r in distinct.groupBy("label").agg(F.count("*").alias("n"), F.sum("weight").alias("rows")).collect()}  # two rows at most
    out = [F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule")]
    if len(seen) < 2:
        only = "block" if 1.0 in seen else "allow"
        return rows.select(*out, F.coalesce("hit.verdict", F.lit(only)).alias("verdict"), F.lit(float(1.0 in seen)).alias("p_block"))

    prior = seen[1.0]["rows"] / sum(r["rows"] for r in seen.values())
    # Written once: each tree reads the sample again and again, not the table that it is drawn from.
    with scope():
        sample = finished(_lexical(sampled(distinct, {label: r["n"] for label, r in seen.items()}, sample_rows)), "url-sample")
    rate = ((F.sum(F.col("label") * F.col("weight")) + 10 * prior) / (F.sum("weight") + 10)).cast("double")
    tops = F.broadcast(sample.groupBy("top").agg(rate.alias("top_rate")))
    endings = F.broadcast(sample.groupBy("ending").agg(rate.alias("ending_rate")))

    def features(df: DataFrame) -> DataFrame:
        df = df.join(tops, "top", "left").join(endings, "ending", "left").fillna({"top_rate": prior, "ending_rate": prior})
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)

    trees_model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=32, stepSize=0.3, seed=seed, featuresCol="features", labelCol="label", weightCol="weight").fit(features(sample).select("features", "label", "weight"))
    judged = trees_model.transform(features(_lexical(rows)))
    p = vector_to_array("probability")[1]
    verdict = F.coalesce("hit.verdict", F.when(p >= 0.5, "block").otherwise("allow"))
    return judged.select(*out, verdict.alias("verdict"), p.alias("p_block"))
