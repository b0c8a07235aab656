"""Legal documents from plain text: articles, clauses and points as rows, and provision versions from them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juristream.functions import text as T

# How the parts of a document are headed, and what stands for a document without any.
ARTICLE = re.compile(r"^\s*điều\s+(\d+[a-zđ]?)\s*[.:]?\s*(.*)$", re.I)
CLAUSE = re.compile(r"^\s*(\d+[a-zđ]?)\s*[.)]\s+(.*)$")
POINT = re.compile(r"^\s*([a-zđ])\s*\)\s*(.*)$")
FALLBACK_CHARS = 500
ROW = "doc string, level string, article string, clause string, point string, text string"


def parts_of(doc: str | None, text: str) -> Iterator[tuple]:
    """Lines before the first article are preamble; a line without a heading goes on with the deepest part. A text without any
    article is one article with one clause if it is long enough."""
    parts: list[list] = []
    article = clause = None
    for line in text.splitlines():
        if m := ARTICLE.match(line):
            article, clause = m[1].lower(), None
            parts.append([doc, "dieu", article, None, None, [m[2]]])
        elif article and (m := CLAUSE.match(line)):
            clause = m[1].lower()
            parts.append([doc, "khoan", article, clause, None, [m[2]]])
        elif clause and (m := POINT.match(line)):
            parts.append([doc, "diem", article, clause, m[1].lower(), [m[2]]])
        elif parts and line.strip():
            parts[-1][5].append(line)
    if not parts and len(text) > FALLBACK_CHARS:
        parts = [[doc, "dieu", "1", None, None, [""]], [doc, "khoan", "1", "1", None, [text]]]
    for *head, lines in parts:
        yield *head, " ".join(" ".join(lines).split())


def parse_documents(texts: DataFrame) -> DataFrame:
    """doc, level, article, clause, point, text of texts (doc, text). Rows are independent; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in ROW.split(", ")]
        for b in batches:
            yield pd.DataFrame([r for d, t in zip(b["doc"], b["text"], strict=True) if t for r in parts_of(d, t)], columns=names)

    return texts.select("doc", "text").mapInPandas(run, ROW)


def provisions(parts: DataFrame, sources: DataFrame) -> DataFrame:
    """Provision versions of parts; sources: doc, source_vb_id, logical_vb_id, effective_from, version_no, visibility, review_status."""
    rows = parts.join(sources, "doc")
    lineage = T.lineage_id(F.col("logical_vb_id"), F.col("article"), F.col("clause"), F.col("point"))
    named = rows.withColumn("text", T.canonical(F.col("text"))).withColumn("lineage_id", lineage).withColumn("text_checksum", T.checksum(F.col("text")))
    return named.select(
        T.version_id(F.col("lineage_id"), F.col("effective_from"), F.col("text_checksum")).alias("provision_id"), "lineage_id", T.parent_lineage(F.col("lineage_id")).alias("parent_lineage_id"), "level", "version_no", "source_vb_id", "logical_vb_id", "article", "clause", "point", "text",
        "effective_from", F.lit(None).cast("date").alias("effective_to"), "text_checksum", F.sha2("source_vb_id", 256).alias("source_checksum"), "visibility", F.current_timestamp().alias("recorded_at"), "review_status",
    )
