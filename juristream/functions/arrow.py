"""Scalar functions that Spark has no expression for, as Arrow-batched pandas functions of two or one columns."""

from __future__ import annotations

import html
import io
import re
import unicodedata
import zipfile
from difflib import SequenceMatcher
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as D

from juristream.functions.text import FORM_RUNS, LETTERS, MARKS

#: Types as objects: workers import this module, and they have no session to parse names with.
HUNKS = D.ArrayType(D.StructType([D.StructField(n, D.StringType()) for n in ("type", "old", "new")]))
_CLAIM = re.compile(r"\d+(?:[.,]\d+)*|[^\W_]+")


def _ratio(a: list | str, b: list | str) -> float:
    return SequenceMatcher(None, a, b, autojunk=False).ratio() if a or b else 1.0


def _words(text: str | None) -> list[str]:
    return (text or "").casefold().split()


@F.pandas_udf(D.DoubleType())
def token_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of the case-folded words; two empty texts are equal."""
    return pd.Series([_ratio(_words(x), _words(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(D.DoubleType())
def claim_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """0.7 word F1 + 0.3 character ratio of normalised claims, six digits; 0 if either has no words."""
    return pd.Series([similarity(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    return round(0.7 * (2 * len(x & y) / (len(x) + len(y))) + 0.3 * _ratio(a, b), 6)


@F.pandas_udf(HUNKS)
def token_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """What turns one text into the other, word by word: equal, replace, delete and insert hunks."""
    out = []
    for x, y in zip(a, b, strict=True):
        old, new = (x or "").split(), (y or "").split()
        hunks = SequenceMatcher(None, old, new).get_opcodes()
        out.append([{"type": kind, "old": " ".join(old[i:j]), "new": " ".join(new[k:m])} for kind, i, j, k, m in hunks])
    return pd.Series(out)


@F.pandas_udf(D.StringType())
def normalized_claim_nfkc(text: pd.Series) -> pd.Series:
    """As text.normalized_claim, after Unicode compatibility composition and full case folding."""
    return text.map(lambda t: " ".join(_CLAIM.findall(unicodedata.normalize("NFKC", t or "").casefold())))


@F.pandas_udf(D.StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    return text.map(lambda t: html.unescape(t) if t is not None else None)


_LETTER, _ODD, _RUN = re.compile(f"[{LETTERS}]"), re.compile(rf"[^\w\s{LETTERS}{MARKS}]"), re.compile("|".join(map(re.escape, FORM_RUNS)))


def quality(text: str) -> float:
    """text.text_quality of one string, for choosing between decodings."""
    t = text.strip()
    if len(t) < 20:
        return 0.0
    value = (len(_LETTER.findall(t)) - 2 * len(_ODD.findall(t))) / len(t) - 0.05 * t.count("\ufffd") - 0.15 * bool(_RUN.search(t)) - 0.2 * (t.count(".") / len(t) > 0.08)
    return max(0.0, min(1.0, value))


# What UTF-8 read as a single-byte encoding looks like, and letters that such a text lacks.
MISREAD = ("Ã", "Â", "Ä", "Å", "á»", "áº", "Æ°", "Æ¡")
REGAINED = ("ệ", "ễ", "ộ", "ấ")


def mended(text: str) -> str:
    """UTF-8 that was once read as a single-byte encoding, read again; only if that makes the text no worse."""
    if not any(m in text for m in MISREAD):
        return text
    for encoding in ("latin-1", "cp1252"):
        try:
            again = text.encode(encoding).decode("utf-8")
        except UnicodeError:
            continue
        regained = any(c in again for c in REGAINED) or again.count("Ã") < text.count("Ã")
        if quality(again) >= quality(text) and (regained or not any(m in again for m in MISREAD)):
            return again
    return text


@F.pandas_udf(D.StringType())
def repair_encoding(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", mended(t)) if t is not None else None)


def _wide(data: bytes) -> str | None:
    """The byte order of UTF-16 without a mark: zero bytes, which UTF-8 texts lack, all in the upper halves of characters."""
    if not data or len(data) % 2:
        return None
    even, odd = data[::2].count(0), data[1::2].count(0)
    if 8 * max(even, odd) < len(data) // 2 or min(even, odd):
        return None
    return "utf-16-le" if odd else "utf-16-be"


def decoded(data: bytes) -> str:
    """By its byte-order mark or the zero bytes of UTF-16; else UTF-8 wherever it is valid; else the single-byte encoding of best quality."""
    for mark, encoding in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            return data.decode(encoding, "replace")
    for encoding in (_wide(data), "utf-8"):
        try:
            if encoding:
                return data.decode(encoding)
        except UnicodeError:
            continue
    best, text = -1.0, ""
    for encoding in ("cp1258", "cp1252", "latin-1"):
        try:
            found = data.decode(encoding)
        except UnicodeError:
            continue
        value = quality(found) if len(found) >= 20 else 0.1
        if value > best:
            best, text = value, found
    return text


@F.pandas_udf(D.StringType())
def decode_bytes(data: pd.Series) -> pd.Series:
    return data.map(lambda b: decoded(bytes(b)) if b is not None else None)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_lines(data: bytes) -> str:
    """A word-processing package's paragraphs, a line each, and table rows as lines of cells; in the document's order."""
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        body = ElementTree.fromstring(package.read("word/document.xml")).find(f"{_W}body")

    def words(paragraph) -> str:
        pieces = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n"}
        return "".join(pieces[e.tag](e) for e in paragraph.iter() if e.tag in pieces)

    lines = []
    for part in body if body is not None else ():
        if part.tag == f"{_W}p":
            lines.append(words(part))
        elif part.tag == f"{_W}tbl":
            for row in part.iter(f"{_W}tr"):
                cells = (" ".join(words(p).strip() for p in cell.iter(f"{_W}p")).strip() for cell in row.iter(f"{_W}tc"))
                lines.append(" | ".join(c for c in cells if c))
    return "\n".join(lines)


@F.pandas_udf(D.StringType())
def docx_text(data: pd.Series) -> pd.Series:
    """Null where the bytes are no such package."""

    def one(raw) -> str | None:
        try:
            return docx_lines(bytes(raw)) if raw is not None else None
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
            return None

    return data.map(one)
