"""Text queries over documents, pages and conversations. Patterns mean the same in Java and RE2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from juristream.functions import arrow
from juristream.functions import text as T
from juristream.operators import frequent
from juristream.plans.common import Collected, table

found = Collected()
QUERIES, ORACLES = found.queries, found.oracles


@found.add(r"""
SELECT sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS checksum, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1
""")
def doc_checksum_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", T.checksum(F.col("text")).alias("checksum"))
    return rows.groupBy("checksum").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


_SPACE = r"\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_LETTER = r"A-Za-z\x{C0}-\x{1EF9}"
_MARK = r".,;:!?()/%+\-\x{2013}\x{2014}\x{22}\x{27}\x{201C}\x{201D}\x{2018}\x{2019}\[\]{}|\\@#&*=<>\x{B0}\x{2030}\x{2026}"


@found.add(rf"""
WITH t AS (SELECT doc_id, regexp_replace(text, '\A[{_SPACE}]+|[{_SPACE}]+\z', '', 'g') AS t FROM documents),
c AS (
  SELECT doc_id, t, CAST(greatest(length(t), 1) AS DOUBLE) AS n, len(regexp_extract_all(t, '[{_LETTER}]')) AS letters,
         len(regexp_extract_all(t, '[^\p{{L}}\p{{N}}_{_SPACE}{_LETTER}{_MARK}]')) AS odd, len(regexp_extract_all(t, '\x{{FFFD}}')) AS lost, len(regexp_extract_all(t, '[.]')) AS dots FROM t
), q AS (
  SELECT doc_id, CASE WHEN length(t) < 20 THEN 0.0 ELSE greatest(0.0, least(1.0, letters / n - 2 * (odd / n) - 0.05 * lost
    - CASE WHEN regexp_matches(t, '[.]{{8,}}|_{{8,}}|-{{8,}}') THEN 0.15 ELSE 0.0 END - CASE WHEN dots / n > 0.08 THEN 0.2 ELSE 0.0 END)) END AS quality FROM c
)
SELECT doc_id, round(CAST(quality AS DOUBLE), 6) AS quality FROM q
""")
def doc_text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.text_quality(F.col("text")), 6).alias("quality"))


@found.add(r"""
WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(list_distinct(list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS gram FROM t WHERE len(w) >= 3)
SELECT gram, count(*) AS n FROM g GROUP BY gram HAVING count(*) >= 5
""")
def doc_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word runs that at least five documents have; runs are made distinct inside their row. Only what may be frequent is shuffled."""
    words = table(spark, sf_dir, "documents").select(T.tokens(F.col("text")).alias("w"))
    grams = words.select(F.explode(F.array_distinct(T.word_ngrams(F.col("w"), 3))).alias("gram"))
    return frequent.maybe_frequent(grams, "gram", 5).groupBy("gram").agg(F.count("*").alias("n")).where("n >= 5")


@found.add(r"""
WITH s AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^.!?\n]+[.!?]?')) AS sentence FROM conversations),
t AS (SELECT conv_id, turn, trim(sentence) AS sentence FROM s)
SELECT conv_id, turn, count(*) AS n, max(length(sentence)) AS longest FROM t WHERE length(sentence) >= 8 GROUP BY 1, 2
""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.transform(F.regexp_extract_all("text", F.lit(r"([^.!?\n]+[.!?]?)"), 1), lambda x: F.trim(x))
    long = F.filter(parts, lambda x: F.length(x) >= 8)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", long.alias("s")).where(F.size("s") > 0)
    sizes = F.transform("s", lambda x: F.length(x).cast("long"))
    return rows.groupBy("conv_id", "turn").agg(F.sum(F.size("s")).alias("n"), F.max(F.array_max(sizes)).alias("longest"))


@found.add(r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
x AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM l),
m AS (SELECT *, lag(line) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM x)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (line = before) AS n_repeated FROM m GROUP BY doc_id
""")
def consecutive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines equal to the one before them, counted inside each row: no line is ever shuffled."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("l"))
    pairs = F.zip_with(F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(1))), F.slice("l", 1, F.greatest(F.size("l") - 1, F.lit(1))), lambda a, b: a == b)
    again = F.when(F.size("l") > 1, F.size(F.filter(pairs, lambda x: x))).otherwise(0)
    return rows.groupBy("doc_id").agg(F.sum(F.size("l")).alias("n_lines"), F.sum(again).alias("n_repeated"))


@found.add(r"""
SELECT doc_id, len(regexp_extract_all(text, '\d+(?:[.,]\d+)*')) AS n_numbers, len(list_distinct(list_transform(regexp_extract_all(text, '\d+(?:[.,]\d+)*'), lambda x: replace(replace(x, '.', ''), ',', '.')))) AS n_distinct
FROM documents
""")
def doc_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    n = F.size(F.regexp_extract_all(text, F.lit(f"({T.NUMBER})"), 1))
    return table(spark, sf_dir, "documents").select("doc_id", n.cast("long").alias("n_numbers"), F.size(T.number_set(text)).cast("long").alias("n_distinct"))


_STRIP = r"""
trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)\b.*?</(?:script|style)\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?i)<br\s*/?>|</(?:p|div|li|tr|h[1-6])\s*>', chr(10), 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t\r\f]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'))
"""


@found.add(f"SELECT page_id, {_STRIP} AS text FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@found.add(r"""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]+)"', 1)) AS href FROM pages)
SELECT page_id, href, count(*) AS n FROM l GROUP BY 1, 2
""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = F.explode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]+)"'), 1))
    return table(spark, sf_dir, "pages").select("page_id", links.alias("href")).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@found.add(r"SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("title"))


@found.add(r"""
WITH u AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, len(list_filter(string_split(path, '/'), lambda x: x <> '')) AS depth, host LIKE '%.org' AND len(list_filter(string_split(path, '/'), lambda x: x <> '')) >= 2 AS is_article FROM u
""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, path = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1), F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    depth = F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"), depth.alias("depth"), (F.endswith(host, F.lit(".org")) & (depth >= 2)).alias("is_article"))


@found.add(r"""
SELECT doc_id, length(trim(text)) >= 20 AND NOT regexp_matches(text, '\.{5,}') AND length(regexp_replace(text, '[^.]', '', 'g')) / CAST(greatest(length(trim(text)), 1) AS DOUBLE) <= 0.08 AND length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= 12 AS quotable FROM documents
""")
def quotable(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    n = F.greatest(F.length(F.trim(t)), F.lit(1)).cast("double")
    ok = (F.length(F.trim(t)) >= 20) & ~F.regexp_like(t, F.lit(r"\.{5,}")) & (T.count_matches(t, r"\.") / n <= 0.08) & (T.count_matches(t, r"\p{L}") >= 12)
    return table(spark, sf_dir, "documents").select("doc_id", ok.alias("quotable"))


@found.add(r"""
SELECT conv_id, turn, CASE WHEN role = 'user' AND (contains(text, '?') OR length(text) < 40) THEN 'question' WHEN role = 'assistant' THEN 'answer' ELSE 'other' END AS kind,
       sha256(conv_id || ':' || turn || ':' || text) AS content_hash FROM conversations
""")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when((F.col("role") == "user") & (F.contains("text", F.lit("?")) | (F.length("text") < 40)), "question").when(F.col("role") == "assistant", "answer").otherwise("other")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", kind.alias("kind"), F.sha2(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"), "text"), 256).alias("content_hash"))


@found.add()
def seq_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation against the one before it by word sequence; Ratcliff-Obershelp has no SQL form."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    rows = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(w)).where("before IS NOT NULL")
    return rows.select("conv_id", "turn", F.round(arrow.token_ratio("before", "text"), 6).alias("similarity"))
