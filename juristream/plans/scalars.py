"""Queries that put scalar functions over the driver's tables; where SQL lacks a function, their values are written out for each kind of input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from juristream.functions import arrow, dialogue
from juristream.functions import text as T
from juristream.operators import claims, graph
from juristream.plans.common import Collected, table
from juristream.plans.law import _LAW, provisions

found = Collected()
QUERIES, ORACLES = found.queries, found.oracles
W = r"[\p{L}\p{N}_]+"

# Questions and passages by remainder, and what is to come out: topic phrases, relevance, small talk, keywords, required terms.
_QUESTIONS = (
    ("Mức phạt nồng độ cồn?", "Vi phạm nồng độ cồn bị phạt", "nong do con|vi pham nong do con", 1.0, False, "mức phạt|phạt|nồng|phạt nồng|Mức phạt nồng độ cồn?", "nồng cồn|nồng|cồn"),
    ("phạt nồng độ cồn", "đăng ký kinh doanh", "nong do con|vi pham nong do con", 0.0, False, "phạt|nồng|phạt nồng|phạt nồng độ cồn", "nồng cồn|nồng|cồn"),
    ("thuế cá cược", "thuế thu nhập cá nhân", "co bac|danh bac|ca cuoc|ca do|casino|tro choi co thuong|danh bac trai phep|dat cuoc", 0.6, False, "cá cược|thuế|cược|thuế cược|thuế cá cược", "thuế cược|thuế|cược"),
    ("Bạn là model gì vậy?", "văn bản", "", 0.0, True, "Bạn là model gì vậy?", "vậy"),
    ("xin chào, Nghị định 15/2020/NĐ-CP quy định gì?", "quy định", "", 0.0, False, "nghị định|chào|xin chào, Nghị định 15/2020/NĐ-CP quy định gì?", "xin chào|xin|chào"),
    ("hoàn thuế giá trị gia tăng", "thủ tục hoàn thuế", "hoan thue", 1.0, False, "hoàn thuế|hoàn|thuế|tăng|hoàn thuế tăng|thuế tăng|hoàn thuế giá trị gia tăng", None),
    ("", "x", "", 1.0, False, "", ""),
)


def _by_row(position: int) -> str:
    return " ".join(f"WHEN {k} THEN {repr(q[position]) if isinstance(q[position], str) else q[position]}" for k, q in enumerate(_QUESTIONS) if q[position] is not None)


_N = len(_QUESTIONS)


@found.add(f"""
SELECT doc_id, CASE doc_id % {_N} {_by_row(2)} END AS anchors, CAST(CASE doc_id % {_N} {_by_row(3)} END AS DOUBLE) AS relevance, CASE doc_id % {_N} {_by_row(4)} END AS small_talk, CASE doc_id % {_N} {_by_row(5)} END AS keywords,
       CASE doc_id % {_N} {_by_row(6)} ELSE 'hoàn thuế giá|thuế giá trị|giá trị gia|trị gia tăng|hoàn thuế|thuế giá|giá trị|trị gia|gia tăng|hoàn' END AS required FROM documents
""")
def text_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven questions dealt over the documents, judged against seven passages."""
    k = F.col("doc_id") % _N
    pick = lambda i: F.element_at(F.array(*[F.lit(q[i]) for q in _QUESTIONS]), (k + 1).cast("int"))
    rows = table(spark, sf_dir, "documents").select("doc_id", pick(0).alias("q"), pick(1).alias("p"))
    q = F.col("q")
    return rows.select("doc_id", F.array_join(dialogue.anchor_phrases(q), "|").alias("anchors"), dialogue.topic_relevance(q, F.col("p")).alias("relevance"), dialogue.small_talk(q).alias("small_talk"), F.array_join(dialogue.keyword_queries(q), "|").alias("keywords"), F.array_join(dialogue.required_terms(q), "|").alias("required"))


@found.add(_LAW + """
SELECT number, provision_id || '|' || lineage_id AS ids, upper(logical_vb_id) AS numbers, CASE WHEN article = '0' THEN TRUE ELSE logical_vb_id || '::D0' = lineage_id END AS same FROM p
""")
def text_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and numbers of documents found in a sentence about a version."""
    rows = provisions(spark, sf_dir)
    text = F.concat(F.lit("theo "), F.col("provision_id"), F.lit(", "), F.col("lineage_id"), F.lit(". và Nghị định "), F.col("logical_vb_id"), F.lit(" (2020)"))
    first = F.col("article") == "0"
    return rows.select("number", F.array_join(T.legal_identifiers(text), "|").alias("ids"), F.element_at(T.document_numbers(F.col("logical_vb_id")), 1).alias("numbers"), (first | (F.concat("logical_vb_id", F.lit("::D0")) == F.col("lineage_id"))).alias("same"))


@found.add(_LAW + """
SELECT number, CAST(number % 50 + 1 AS VARCHAR) || 'trieu' AS amounts, CASE number % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'mismatch_soft' ELSE 'contradiction' END AS consistency, CAST((number % 50 + 1) * 1000000 AS DOUBLE) AS first_amount FROM p
""")
def text_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of a version's text, and whether a claim's agree with it."""
    n = F.col("number")
    claim = F.when(n % 3 == 0, F.col("text")).otherwise(F.lit("phạt 99.999 triệu"))
    premise = F.when(n % 3 == 2, F.lit("phạt nặng")).otherwise(F.col("text"))
    return provisions(spark, sf_dir).select("number", F.array_join(T.claim_amounts(F.col("text")), "|").alias("amounts"), T.numeric_consistency(premise, claim).alias("consistency"), F.element_at(T.amounts(F.col("text")), 1).cast("double").alias("first_amount"))


@found.add(rf"""
WITH t AS (SELECT item_id, list_distinct(list_filter(regexp_extract_all(lower(text), '{W}'), lambda x: length(x) >= 2 AND NOT regexp_full_match(x, '[0-9]+') AND x NOT IN ('the', 'und'))) AS unordered, list_filter(regexp_extract_all(lower(text), '{W}'), lambda x: length(x) >= 2 AND NOT regexp_full_match(x, '[0-9]+') AND x NOT IN ('the', 'und')) AS w FROM benchmark),
f AS (SELECT item_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t), g AS (SELECT item_id, x, min(i) AS i FROM f GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS n FROM g)
SELECT item_id, array_to_string(list(x ORDER BY i), ' ') AS terms FROM r WHERE n <= 24 GROUP BY 1
""")
def text_search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.search_terms(F.col("text"), ("the", "und")), " ").alias("terms")).where("terms <> ''")


@found.add(r"""
SELECT doc_id, contains(lower(text), 'the') OR contains(lower(text), 'der') AS any_of, regexp_matches(lower(text), '(^|[^a-z0-9])thing([^a-z0-9]|$)') AS word, lower(trim(regexp_replace(source, '\s+', ' ', 'g'))) AS slug FROM documents
""")
def text_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms anywhere, and a term as a word, in every document."""
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", T.contains_any(F.col("text"), ("the", "DER")).alias("any_of"), T.contains_term(F.lower("text"), F.lit("thing")).alias("word"), F.lower(T.canonical(F.col("source"))).alias("slug"))


@found.add("""
SELECT event_id, date_trunc('minute', ts) - INTERVAL 7 HOUR AS news, date_trunc('second', ts) AS iso, CAST(CAST(ts AS DATE) AS TIMESTAMP) - INTERVAL 7 HOUR AS day, date_trunc('second', ts) AS rfc, NULL::TIMESTAMP AS odd FROM events
""")
def text_event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as feeds and news pages write them, read back."""
    ts = F.col("ts").cast("timestamp")
    as_text = lambda p: F.date_format(ts, p)
    rows = table(spark, sf_dir, "events").select("event_id", as_text("dd/MM/yyyy HH:mm").alias("a"), as_text("yyyy-MM-dd'T'HH:mm:ss'Z'").alias("b"), as_text("dd/MM/yyyy").alias("c"), F.concat(as_text("E, d MMM yyyy HH:mm:ss"), F.lit(" +0000")).alias("d"))
    plain = lambda c: T.event_time(F.col(c)).cast("timestamp_ntz")
    return rows.select("event_id", plain("a").alias("news"), plain("b").alias("iso"), plain("c").alias("day"), plain("d").alias("rfc"), T.event_time(F.concat(F.lit("x"), F.col("a"))).cast("timestamp_ntz").alias("odd"))


def _cleaned(text: str) -> str:
    """What cleaning does, step by step, in SQL."""
    steps = (
        (r"\r\n?", "chr(10)"), (r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}]", "''"), (r"[\x{200B}-\x{200F}\x{2060}\x{FEFF}]", "''"), (r"[\x{A0}\x{2000}-\x{200A}\x{202F}\x{3000}]", "' '"),
        (r"(?m)^[\s|+\-=_]{3,}$", "''"), (r"[ \t]+", "' '"), (r" ?\n ?", "chr(10)"), (r"\n{3,}", "chr(10) || chr(10)"), (r"^\s+|\s+$", "''"),
    )
    for pattern, to in steps:
        text = f"regexp_replace({text}, '{pattern}', {to}, 'g')"
    return text


@found.add(f"""
SELECT conv_id, turn, {_cleaned("chr(65279) || replace(text, ' ', chr(7) || ' ' || chr(8203) || ' ')")} AS clean FROM conversations
""")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with control and invisible characters put in, cleaned."""
    dirty = F.concat(F.lit("\ufeff"), F.replace(F.col("text"), F.lit(" "), F.lit("\x07 \u200b ")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_text(dirty).alias("clean"))


@found.add("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'audio' ELSE 'text' END AS medium, CASE WHEN event_id % 5 = 3 OR event_type = 'click' THEN 'local' ELSE 'large' END AS route,
       CASE WHEN event_id % 7 = 0 THEN 'thuế' WHEN event_id % 7 = 1 THEN 'tài chính' END AS topic, CASE WHEN event_id % 100 >= 85 THEN 'critical' WHEN event_id % 100 >= 70 THEN 'high' WHEN event_id % 100 >= 50 THEN 'medium' ELSE 'low' END AS severity,
       CASE WHEN event_id % 3 = 0 THEN 'x234567890123456789012345678…' ELSE 'short' END AS label FROM events
""")
def text_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media, routes, topics, severities and labels."""
    e = F.col("event_id")
    names = F.when(e % 5 == 0, F.array(F.lit("Infographic"))).when(e % 5 == 1, F.array(F.lit("video_script"), F.lit("text"))).when(e % 5 == 2, F.array(F.lit("audio"))).otherwise(F.array().cast("array<string>"))
    text = F.when(e % 7 == 0, "Thuế và tài chính").when(e % 7 == 1, "TÀI CHÍNH").otherwise("khác")
    return table(spark, sf_dir, "events").select(
        "event_id", dialogue.media_type(names).alias("medium"), dialogue.route(F.when(e % 5 == 3, "extract_short").otherwise("qa"), F.when(F.col("event_type") == "click", "low").otherwise("high")).alias("route"),
        dialogue.first_topic(text, {"thuế": ("thuế",), "tài chính": ("tài chính",)}).alias("topic"), claims.severity((e % 100) / 100.0).alias("severity"), dialogue.short_label(F.when(e % 3 == 0, "x2345678901234567890123456789012").otherwise("short")).alias("label"),
    )


@found.add("""
SELECT page_id, 'post-' || substr(sha256(url || '|' || CAST(page_id AS VARCHAR)), 1, 24) AS stable, substr(sha256(CAST(page_id AS VARCHAR) || '_2020-01-02'), 1, 16) AS document, round(0.4::DOUBLE * (page_id % 9) + 0.3::DOUBLE * (page_id % 4) + 0.2::DOUBLE * 2 + 0.1::DOUBLE * (page_id % 50), 9) AS importance,
       round(greatest(12.0, least(70.0, 12.0 + 5.0::DOUBLE * sqrt(page_id % 200))), 9) AS marker FROM pages
""")
def text_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        "page_id", T.stable_id("post", F.col("url"), k.cast("string")).alias("stable"), T.document_id(k.cast("string"), F.lit("2020-01-02").cast("date")).alias("document"), F.round(graph.importance(k % 9, k % 4, F.lit(2), k % 50), 9).alias("importance"), F.round(graph.marker_size((k % 200).cast("double")), 9).alias("marker")
    )


@found.add("""
SELECT o_orderkey, upper('N' || CAST(o_custkey % 40 AS VARCHAR) || '/2020/ND-CP') = upper('N' || CAST(o_orderkey % 40 AS VARCHAR) || '/2020/ND-CP') OR (o_orderkey % 3 = 0 AND o_custkey % 40 = o_orderkey % 40) AS same FROM orders
""")
def text_document_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of documents as written: with accents and blanks, and in one of three without the year."""
    wanted = F.concat(F.lit(" n"), (F.col("o_custkey") % 40).cast("string"), F.lit(" / 2020 / NĐ - CP"))
    end = F.when(F.col("o_orderkey") % 3 == 0, "/ND-CP").otherwise("/2020/ND-CP")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.same_document_number(wanted, F.concat(F.lit("N"), (F.col("o_orderkey") % 40).cast("string"), end)).alias("same"))


@found.add("""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Điều 1' WHEN 1 THEN 'Miễn lệ phí' WHEN 2 THEN 'Hội đồng công bố' WHEN 3 THEN NULL ELSE 'Café' END AS read, event_id % 5 < 2 AS vietnamese FROM events
""")
def text_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes in several encodings, text that was read wrongly once, and misread scans, put right."""
    k = F.col("event_id") % 5
    raw = F.when(k == 0, F.encode(F.lit("Điều 1"), "UTF-16")).when(k == 4, F.lit(bytearray("Café".encode("latin-1")))).when(k == 2, F.encode(F.lit("HỘI ĐÔNG công bồ"), "UTF-8")).when(k == 1, F.encode(F.lit("Miễn lệ phí".encode().decode("latin-1")), "UTF-8"))
    text = arrow.repair_encoding(arrow.decode_bytes(raw))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("t"))
    fixed = dialogue.repair_scan(F.col("t"))
    return rows.select("event_id", fixed.alias("read"), F.coalesce(dialogue.looks_vietnamese(fixed) & (F.col("event_id") % 5 < 2), F.lit(False)).alias("vietnamese"))


@found.add("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN FALSE ELSE TRUE END AS insufficient, doc_id % 4 <> 0 AS risky, doc_id % 4 <> 0 AS material, CASE doc_id % 4 WHEN 1 THEN 'sửa đổi điều 5; bãi bỏ khoản 2' ELSE '' END AS changes FROM documents
""")
def text_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that admit not to know, cite, or claim figures and duties."""
    k = F.col("doc_id") % 4
    text = F.when(k == 0, "Ngữ cảnh không quy định về vấn đề này.").when(k == 1, "Sửa đổi, bổ sung Điều 5; bãi bỏ khoản 2").when(k == 2, "có cấm").otherwise("Chưa đủ căn cứ về mức phạt")
    rows = table(spark, sf_dir, "documents").select("doc_id", text.alias("t"))
    changes = F.array_join(F.transform(dialogue.named_changes(F.col("t")), lambda x: F.concat_ws(" ", x["action"], x["target"], x["id"])), "; ")
    return rows.select("doc_id", dialogue.says_insufficient(F.col("t")).alias("insufficient"), dialogue.risky_claim(F.col("t")).alias("risky"), dialogue.material_claim(F.col("t")).alias("material"), changes.alias("changes"))
