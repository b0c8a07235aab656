"""Sources: legal texts, HTML, feeds, gold sets and captured API answers as tables; and sinks that never overwrite.

All of them read through Spark, so they take any path its file systems know, and files are split over executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from juristream.functions import arrow
from juristream.functions import text as T

TEXT = ("txt", "md", "html", "htm", "rtf")


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, modified, size, content, checksum of files below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content", F.sha2("content", 256).alias("checksum"))


def extract_text(files: DataFrame, readers: dict[str, object] | None = None) -> DataFrame:
    """path, checksum, kind, text of binary files by their suffix: plain text, HTML, RTF and DOCX here, other kinds by `readers` (suffix -> pandas UDF of the
    content). A kind without a reader has a null text."""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    known = files.select("path", "checksum", "content", kind.alias("kind"))
    decoded = arrow.decode_bytes(F.when(F.col("kind").isin(*TEXT), F.col("content")))
    rows = known.withColumn("_t", decoded)
    text = F.when(F.col("kind").isin("html", "htm"), T.strip_html(F.col("_t"))).when(F.col("kind") == "rtf", rtf_text(F.col("_t"))).otherwise(F.col("_t"))
    for suffix, reader in ({"docx": arrow.docx_text} | (readers or {})).items():
        text = F.when(F.col("kind") == suffix, reader(F.when(F.col("kind") == suffix, F.col("content")))).otherwise(text)
    return rows.select("path", "checksum", "kind", F.when(text.isNotNull(), T.clean_text(text)).alias("text"))


def rtf_text(rtf: Column) -> Column:
    """The text of RTF: groups that hold no text go, paragraph marks become line ends, control words and braces vanish."""
    t = F.regexp_replace(rtf, r"(?s)\{\\\*?\\?(?:fonttbl|colortbl|stylesheet|info|generator)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "")
    t = F.regexp_replace(t, r"\\(?:par|line)[d]?\b ?", "\n")
    t = F.regexp_replace(t, r"\\'[0-9a-fA-F]{2}|\\u-?\d+\??|\\[a-zA-Z]+-?\d* ?|[{}]", "")
    return F.trim(t)


def split_files(spark: SparkSession, path: str, separator: str = r"(?m)^={5,}\s*$") -> DataFrame:
    """path, part (from 0), text: files that hold several documents, cut at separator lines; empty parts are left out."""
    whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    parts = whole.select("path", F.posexplode(F.split("value", separator)).alias("part", "text"))
    return parts.where(F.trim("text") != "")


def headed_texts(texts: DataFrame) -> DataFrame:
    """number, number_norm, title, agency, issued, body of texts (path, text) with 'Key: value' lines in front; a missing number comes from the file name."""
    field = lambda names: F.nullif(F.trim(F.regexp_extract("text", rf"(?imU)^\s*(?:{names})\s*:\s*(.+)$", 1)), F.lit(""))
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+?)(?:\.[^.]*)?$", 1), "_", "/")
    number = F.coalesce(field("số hiệu|so_hieu|so hieu"), stem)
    date = field("ngày ban hành|ngay_ban_hanh")
    issued = F.coalesce(F.try_to_date(date, "dd/MM/yyyy"), F.try_to_date(date, "yyyy-MM-dd"))
    body = F.regexp_replace(F.regexp_replace("text", r"(?imU)\A(?:\s*[\w ]+\s*:.*\R)+", ""), r"\A\s+|\s+\z", "")
    return texts.select("path", number.alias("number"), T.document_number(number).alias("number_norm"), field("tiêu đề|ten|title").alias("title"), field("cơ quan|co_quan").alias("agency"), issued.alias("issued"), body.alias("body"))


def feed(spark: SparkSession, path: str, topics: list[str] | None = None) -> DataFrame:
    """id, title, text, link, published of RSS items and Atom entries in files; with topics, those that mention one."""
    whole = spark.read.text(path, wholetext=True).select("value")
    items = whole.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), 1)).alias("x"))
    tag = lambda names: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("x", rf"(?s)<(?:{names})\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</(?:{names})>", 1), r"<[^>]*>", " ")), F.lit(""))
    link = F.coalesce(tag("link"), F.nullif(F.regexp_extract("x", r'<link\b[^>]*href="([^"]+)"', 1), F.lit("")))
    rows = items.select(tag("title").alias("title"), T.canonical(F.concat_ws(" ", tag("title"), T.strip_html(tag("description|summary|content")))).alias("text"), link.alias("link"), T.event_time(tag("pubDate|published|updated")).alias("published"))
    rows = rows.withColumn("id", T.stable_id("feed", F.coalesce("link", "title")))
    return rows if topics is None else rows.where(T.contains_any(F.col("text"), topics))


def article_url(url: Column, host: str, section: str, depth: int = 3) -> Column:
    """Whether an address is an article's: of the host or one below it, in the section, so many path parts deep."""
    path = F.regexp_extract(url, r"^https?://[^/]+(/[^?#]*)", 1)
    deep = F.size(F.filter(F.split(path, "/"), lambda x: x != "")) >= depth
    return F.regexp_like(url, F.lit(rf"^https?://(?:[\w-]+\.)*\Q{host}\E/")) & F.contains(path, F.lit(section)) & deep


def news_links(pages: DataFrame, host: str, section: str) -> DataFrame:
    """page_id, url, title: links of listing pages (page_id, html) to articles of a host's section; each url once per page."""
    a = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'(?is)(<a\s[^>]*href="[^"]+"[^>]*>.*?</a>)'), 1)).alias("a"))
    url = F.regexp_replace(F.regexp_extract("a", r'(?i)href="([^"#]+)', 1), "^/", f"https://{host}/")
    rows = a.select("page_id", url.alias("url"), T.canonical(T.strip_html(F.col("a"))).alias("title"))
    return rows.where(article_url(F.col("url"), host, section)).groupBy("page_id", "url").agg(F.max_by("title", F.length("title")).alias("title"))


def posts(spark: SparkSession, path: str, platform: str, schema: str = "external_id string, text string, published string, likes long, comments long, shares long, topic string") -> DataFrame:
    """Captured answers of a platform's API, one JSON object a line, as posts; broken lines are left out."""
    rows = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").option("mode", "PERMISSIVE").json(path)
    return rows.where("external_id IS NOT NULL").drop("_bad").withColumn("platform", F.lit(platform)).withColumn("published", T.event_time(F.col("published")))


def fan_in(sources: list[DataFrame]) -> DataFrame:
    """Posts of several sources as one table, (platform, external_id) once: the source named first wins."""
    from juristream.operators.claims import first_by_key

    out = None
    for n, s in enumerate(sources):
        one = s.withColumn("_source", F.lit(n))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return first_by_key(out, ["platform", "external_id"], [F.col("_source"), F.col("published"), F.xxhash64("text")]).drop("_source")


def gold(spark: SparkSession, path: str, schema: str, field: str = "cases") -> DataFrame:
    """The cases (or predictions) of gold files; raises if a case_id is missing or repeated."""
    rows = spark.read.schema(f"{field} array<struct<{schema}>>").option("multiLine", "true").option("mode", "FAILFAST").json(path).select(F.explode(field).alias("c")).select("c.*")
    bad = rows.groupBy("case_id").agg(F.count("*").alias("n")).where("n > 1 OR case_id IS NULL").limit(5).collect()
    if bad:
        raise ValueError(f"case_id missing or repeated: {[r['case_id'] for r in bad]}")
    return rows


def add_objects(files: DataFrame, path: str) -> DataFrame:
    """Appends files (checksum, content, modified) whose checksum the sink lacks, below year and month; returns what was new."""
    spark = files.sparkSession
    once = files.dropDuplicates(["checksum"]).withColumn("yyyy", F.date_format("modified", "yyyy")).withColumn("mm", F.date_format("modified", "MM"))
    try:
        known = spark.read.parquet(path).select("checksum")
    except Exception as e:  # nothing there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], "checksum string")
    new = once.join(known, "checksum", "left_anti")
    new.write.mode("append").partitionBy("yyyy", "mm").parquet(path)
    return new


def objects(spark: SparkSession, path: str) -> DataFrame:
    """What add_objects() has stored, each checksum once: two writers at a time may both have added one."""
    return spark.read.parquet(path).dropDuplicates(["checksum"])


def capped(rows: DataFrame, keys: list[str], most: int, order: list[Column]) -> DataFrame:
    """The first `most` rows of each key: what a source takes for a topic, a query or a channel in one poll."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def since(rows: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Posts published in the hours before a poll; undated ones stay."""
    return rows.where(F.col("published").isNull() | (F.col("published") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")))


def expanded_queries(topics: DataFrame, orders: tuple[str, ...] = ("relevance", "date"), suffixes: tuple[str, ...] = ("", " quy định", " mức phạt")) -> DataFrame:
    """topic, query, order: what a video search is asked for each topic (column topic)."""
    one = lambda values: F.explode(F.array(*map(F.lit, values)))
    rows = topics.select("topic", one(suffixes).alias("_s")).select("topic", F.concat("topic", "_s").alias("query"))
    return rows.select("topic", "query", one(orders).alias("order"))


def on_topic(rows: DataFrame, topics: dict[str, tuple[str, ...]], default: str | None = None) -> DataFrame:
    """Posts with the topic they mention first, or the default (posts of a page that is itself about one); without either they go."""
    from juristream.functions.dialogue import first_topic

    named = rows.withColumn("topic", F.coalesce(first_topic(F.col("text"), topics), F.lit(default).cast("string")))
    return named.where("topic IS NOT NULL")


def with_bodies(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Listed articles (url, title) with the text of their page (url, html) where that was fetched; without, the title stands for it."""
    body = pages.select("url", T.clean_text(T.strip_html(F.col("html"))).alias("body")).dropDuplicates(["url"])
    return links.join(body, "url", "left").withColumn("text", F.coalesce(F.nullif("body", F.lit("")), "title")).drop("body")


def report(df: DataFrame, path: str) -> None:
    """An evaluation report as JSON lines."""
    df.write.mode("errorifexists").json(path)
