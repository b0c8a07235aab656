"""Operator 6: mixing sources to target weights, in DataFrame functions only.

Every row gets a hash-random key. Rows are ordered by that key within their source; the words before each row are
the total of the earlier key buckets (a prefix sum over at most BUCKETS rows a source) plus the running sum within
the row's own bucket. No task ever holds more than one bucket of a source, however large the source is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from juristream.llm.common import WORD

#: Three hexadecimal digits of the key.
BUCKETS = 4096


def mix(
    documents: DataFrame,
    *,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most_epochs: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """How many words of each document a mix takes.

    The sources, by code point with null last, weigh `weights`, repeating. They share `share` times the words of all
    documents by weight, but none gets more than `most_epochs` times its own words; what is above goes to the others
    by weight. A source's budget is its target rounded down. It takes whole epochs of the source while they fit and
    then the documents in key order up to the exact word; the document at the cut is taken in part.

    Returns one row per input row: `doc` (a struct of the columns in `keep`, all by default, so no name can clash),
    size, source_size, target, taken.

    A null or blank text has size 0 and takes 0; texts of any length are counted whole. Null sources are one source. A null id is
    replaced by the text's hash. Equal ids are ordered by size and text, so reruns agree; equal rows are interchangeable. A table
    without words has targets of 0, an empty table gives an empty one.
    """
    keep = documents.columns if keep is None else keep
    text = F.coalesce(documents[text_col].cast("string"), F.lit(""))
    ident = F.coalesce(documents[id_col].cast("string"), F.concat(F.lit("text:"), F.md5(text)))
    rows = documents.select(
        F.struct(*[documents[c] for c in keep]).alias("doc"),
        F.coalesce(F.concat(F.lit("="), documents[source_col].cast("string")), F.lit("")).alias("source"),
        F.md5(F.concat_ws(":", F.lit(seed), ident)).alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(ident, text).alias("tie"),
    ).withColumn("bucket", F.substring("key", 1, 3))

    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    targets = source_targets(sums, weights, share, most_epochs)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("start"))
    starts = starts.join(targets, "source")

    within = Window.partitionBy("source", "bucket").orderBy("key", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("size").over(within)).join(starts, ["source", "bucket"])
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size") - (F.col("start") + F.col("upto") - F.col("size"))
    return placed.select(
        "doc",
        "size",
        "source_size",
        "target",
        (epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))).cast("long").alias("taken"),
    )


def source_targets(sums: DataFrame, weights: Sequence[float], share: float, most_epochs: float) -> DataFrame:
    """source, source_size, target: one row per source, so the windows without a key see only as many rows.

    With the sources ordered by cap over weight, the common level is the largest of (what is left after the caps
    of the sources before) / (the weights from here on): while sources are above their cap that value rises, then falls.
    """
    everything = Window.partitionBy()
    numbered = (
        sums.groupBy("source")
        .agg(F.sum("words").alias("source_size"))
        .withColumn("n", F.row_number().over(Window.orderBy(F.col("source") == "", "source")))
        .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("n") - 1) % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(float(most_epochs)))
    )
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "n")
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    onward = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    levels = numbered.withColumn("level", (total - before) / onward).withColumn("level", F.max("level").over(everything))
    return levels.select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def taken_documents(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as often as the mix takes it, in whole texts, with the columns of `doc`."""
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    return mixed.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select("doc.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), n AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s
), w AS (
  SELECT *, CASE n % 3 WHEN 1 THEN 3.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM n
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w
), t AS (
  SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - start)) AS BIGINT) AS taken
FROM e
"""
