"""Operator 13: fill-in-middle transformation over run-length encoded character classes.

A text is cut at places counted in characters, but lies in memory as UTF-8. Its characters fall into classes by the bytes that they take; maximal
runs of one class are stored with the characters and bytes before them. A cut is found by binary search of its run; within the run its byte is
a product. So no text is decoded, and a cut costs the logarithm of its runs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from juristream.llm.common import tidy

#: Bytes that one character takes, by its first byte; 0 for bytes inside a character.
WIDTH = np.array([1] * 0x80 + [0] * 0x40 + [2] * 0x20 + [3] * 0x10 + [4] * 0x10, np.uint8)
#: Bytes whose characters are looked at together.
STEP = 1 << 20


class Runs:
    """The runs of a text in UTF-8."""

    def __init__(self, data: bytes | memoryview):
        raw, widths, counts = np.frombuffer(data, np.uint8), [], []
        for at in range(0, len(raw), STEP):
            width = WIDTH[raw[at : at + STEP]]
            width = width[width > 0]
            if len(width):
                first = np.append(0, np.flatnonzero(width[1:] != width[:-1]) + 1)
                widths.append(width[first])
                counts.append(np.diff(np.append(first, len(width))))
        width = np.concatenate([*widths, np.empty(0, np.uint8)])
        count = np.concatenate([*counts, np.empty(0, np.int64)])
        # A run that goes on in the next step stays two runs of one class, which does no harm.
        self.width = width
        self.characters = np.append(0, np.cumsum(count))
        self.bytes = np.append(0, np.cumsum(count * width))

    def __len__(self) -> int:
        return int(self.characters[-1])

    def byte(self, cut: int) -> int:
        """Where the character number `cut` begins (the end, if it is the length)."""
        run = int(np.searchsorted(self.characters, cut, "right")) - 1
        if run == len(self.width):
            return int(self.bytes[-1])
        return int(self.bytes[run]) + (cut - int(self.characters[run])) * int(self.width[run])


class Forms:
    """Marks, and how often which form is taken."""

    def __init__(self, marks: tuple[str, str, str] = ("<P>", "<S>", "<M>"), whole: int = 90, suffix_first: int = 20, seed: str = "1"):
        self.prefix, self.suffix, self.middle = (m.encode() for m in marks)
        self.whole, self.suffix_first, self.seed = whole, suffix_first, seed

    def draws(self, key) -> list[int]:
        """Four numbers of 32 bits from a row's id (nothing in its place, if that is null)."""
        digest = hashlib.sha256(f"{self.seed}:{'' if key is None else key}".encode()).hexdigest()
        return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]

    def marked(self, text: bytes) -> bool:
        return self.prefix in text or self.suffix in text or self.middle in text

    def apply(self, key, text: bytes) -> tuple[int, str, int | None, int | None, bytes]:
        """Characters, form, characters of prefix and middle, output."""
        runs, (a, b, c, d) = Runs(text), self.draws(key)
        n = len(runs)
        if not n or c % 100 >= self.whole or self.marked(text):
            return n, "plain", None, None, text
        lo, hi = sorted((a % (n + 1), b % (n + 1)))
        x, y = runs.byte(lo), runs.byte(hi)
        prefix, middle, suffix = text[:x], text[x:y], text[y:]
        if d % 100 < self.suffix_first:
            return n, "spm", lo, hi - lo, b"".join([self.suffix, suffix, self.prefix, prefix, self.middle, middle])
        return n, "psm", lo, hi - lo, b"".join([self.prefix, prefix, self.suffix, suffix, self.middle, middle])

    def restore(self, form: str, output: bytes) -> bytes:
        """The text, from output and form alone. A text that has a mark stays plain, so each mark is found where it was put."""
        if form == "plain":
            return output
        first, second = (self.suffix, self.prefix) if form == "spm" else (self.prefix, self.suffix)
        at = output.index(second, len(first))
        then = output.index(self.middle, at + len(second))
        parts = output[len(first) : at], output[at + len(second) : then]
        prefix, suffix = parts[::-1] if form == "spm" else parts
        return b"".join([prefix, output[then + len(self.middle) :], suffix])


def transform(documents: DataFrame, *, forms: Forms | None = None, id_col: str = "doc_id", text_col: str = "text", with_output: bool = True) -> DataFrame:
    """Each text in a form to learn filling in from: its middle behind prefix and suffix, or behind suffix and prefix, or as it is.

    Returns per row the id column, n (characters), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output (only if
    with_output), output_sha256, restored_sha256 (of the text rebuilt from output and form).

    A text is plain if it is empty or null, holds a mark, or is drawn so. Draws depend on the id alone: rows that repeat an id share them (each
    with its own text's length), null ids draw as an empty name. Further columns are ignored whatever their names; an empty table gives an empty
    one. No shuffle: rows are independent, and a worker holds a text and its output at a time."""
    how = forms or Forms()
    one = documents.select(documents[id_col], documents[text_col])
    schema = f"`{id_col}` {one.schema[0].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long" + ", output string" * with_output + ", output_sha256 string, restored_sha256 string"
    names = [id_col, "n", "form", "prefix_chars", "middle_chars", *["output"] * with_output, "output_sha256", "restored_sha256"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * with_output, pa.string(), pa.string()]

    def some(batch: pa.RecordBatch) -> Iterator[tuple]:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            n, form, lo, middle, output = how.apply(key, raw)
            sha = hashlib.sha256(output).hexdigest(), hashlib.sha256(how.restore(form, output)).hexdigest()
            yield n, form, lo, middle, *[output.decode()] * with_output, *sha

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(zip(*some(batch), strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names=names)

    return one.mapInArrow(tidy(run), schema)


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), h AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS b, CAST('0x' || h[17:24] AS BIGINT) % 100 AS c, CAST('0x' || h[25:32] AS BIGINT) % 100 AS e FROM d
), f AS (
  SELECT *, least(a, b) AS x, greatest(a, b) AS y,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (SELECT *, substring(text, 1, x) AS prefix, substring(text, x + 1, y - x) AS middle, substring(text, y + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
