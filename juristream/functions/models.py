"""Where models plug in: an inference model, an embedder and an entity extractor as Arrow-batched functions, each with a default that needs no model.

A model is a plain function of a list, called once a batch inside the workers; what it closes over is sent to them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as D

VERDICT = D.StructType([D.StructField("label", D.StringType()), D.StructField("score", D.DoubleType()), D.StructField("model", D.StringType()), D.StructField("needs_review", D.BooleanType())])
LABELS = ("khop", "mau_thuan", "khong_ro")
CONFIDENT = 0.70
# Categories of what a clause says, and how sentences of each are worded.
CUES = (
    ("hanh_vi_cam", r"nghiêm cấm|không được|bị cấm|\bcấm\b"),
    ("che_tai", r"phạt|xử lý|đình chỉ|tước"),
    ("thoi_han", r"thời hạn|trong vòng|\d+\s*(?:ngày|tháng|năm)"),
    ("nghia_vu", r"\bphải\b|có nghĩa vụ|có trách nhiệm"),
    ("quyen_loi", r"có quyền|được hưởng|\bđược\b"),
    ("chu_the", r"\b(?:tổ chức|cá nhân|doanh nghiệp|người)\b"),
)


def inference(premise: Column, hypothesis: Column, model: Callable[[list[tuple[str, str]]], list[tuple[str, float]]] | None = None, name: str = "heuristic") -> Column:
    """struct(label, score, model, needs_review) of pairs: a model's (label, score), or the rules of claims.infer(). Unknown labels and scores below CONFIDENT need review."""
    if model is None:
        from juristream.operators.claims import infer

        r = infer(premise, hypothesis)
        return F.struct(r["label"].alias("label"), r["score"].alias("score"), F.lit(name).alias("model"), r["needs_review"].alias("needs_review"))

    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        found = model([(x or "", y or "") for x, y in zip(a, b, strict=True)])
        rows = [(label if label in LABELS else "khong_ro", float(score), name, label not in LABELS or score < CONFIDENT) for label, score in found]
        return pd.DataFrame(rows, columns=["label", "score", "model", "needs_review"])

    return F.pandas_udf(run, VERDICT)(premise, hypothesis)


def hashed_embedding(texts: list[str], dims: int = 64) -> list[np.ndarray]:
    """Signed hashed word counts, scaled to norm 1: a stand-in that puts texts with like words near each other."""
    out = []
    for text in texts:
        v = np.zeros(dims, np.float32)
        for w in text.casefold().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            v[h % dims] += 1 if h >> 63 else -1
        n = float(np.sqrt((v * v).sum()))
        out.append(v / n if n else v)
    return out


def embedded(text: Column, model: Callable[[list[str]], list] = hashed_embedding, batch: int = 32) -> Column:
    """A vector (array<float>) of each text, `batch` texts a call; a null text is an empty one."""

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = [x or "" for x in part]
            vectors = [v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])]
            yield pd.Series([np.asarray(v, np.float32) for v in vectors], dtype=object)

    return F.pandas_udf(run, D.ArrayType(D.FloatType()))(text)


def cued_entities(text: str) -> list[tuple[str, str]]:
    """(category, sentence): each sentence under the first category whose cue it has."""
    out = []
    for sentence in re.split(r"(?<=[.;!?])\s+|\n+", text):
        kind = next((k for k, cue in CUES if re.search(cue, sentence, re.IGNORECASE)), None)
        if kind and sentence.strip():
            out.append((kind, sentence.strip()))
    return out


def entities(clauses: DataFrame, extractor: Callable[[str], list[tuple[str, str]]] = cued_entities) -> DataFrame:
    """khoan_id, category, mo_ta of clauses (khoan_id, text): what an extractor finds in each, rows independent."""
    kind = clauses.schema["khoan_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(k, c, m) for k, text in zip(part["khoan_id"], part["text"], strict=True) for c, m in extractor(text or "")]
            yield pd.DataFrame(rows, columns=["khoan_id", "category", "mo_ta"])

    return clauses.select("khoan_id", "text").mapInPandas(run, f"khoan_id {kind}, category string, mo_ta string")
