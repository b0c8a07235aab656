"""Operator 2: greedy longest-match word-piece counts by a linear automaton.

The trie of the pieces gets failure links in the manner of Aho and Corasick, with one difference: following a
link means that pieces of the greedy segmentation are complete. How many is known when the automaton is built, so
the scan adds a precomputed number per link and never builds a piece. Each character is read once.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from juristream.llm.common import BoundedCache

NONE = -1


class LongestMatch:
    """initial: pieces that may begin a word; inner: pieces that may go on. Both without their markers.

    count(word) is the number of pieces of the greedy longest-match segmentation, or None where it gets stuck.
    """

    START, INNER = 0, 1

    def __init__(self, initial: Iterable[str], inner: Iterable[str]):
        self.go: list[dict[str, int]] = [{}, {}]
        ends = [False, False]
        for root, pieces in ((self.START, initial), (self.INNER, inner)):
            for piece in pieces:
                v = root if piece else None
                for c in piece:
                    u = self.go[v].get(c)
                    if u is None:
                        u = self.go[v][c] = len(self.go)
                        self.go.append({})
                        ends.append(False)
                    v = u
                if v is not None:
                    ends[v] = True
        self.fail = [NONE] * len(self.go)
        self.popped = [0] * len(self.go)
        queue = deque((self.START, self.INNER))
        while queue:
            v = queue.popleft()
            for c, u in self.go[v].items():
                queue.append(u)
                if ends[u]:
                    self.fail[u], self.popped[u] = self.INNER, 1
                    continue
                z, total = self.fail[v], self.popped[v]
                while z != NONE and c not in self.go[z]:
                    total += self.popped[z]
                    z = self.fail[z]
                if z != NONE:
                    self.fail[u], self.popped[u] = self.go[z][c], total

    def count(self, word: str) -> int | None:
        go, fail, popped = self.go, self.fail, self.popped
        v, n = self.START, 0
        for c in word:
            u = go[v].get(c)
            while u is None:
                n += popped[v]
                v = fail[v]
                if v == NONE:
                    return None
                u = go[v].get(c)
            v = u
        while v > self.INNER:
            n += popped[v]
            v = fail[v]
            if v == NONE:
                return None
        return n


def read_pieces(path: str, marker: str = "▁") -> tuple[list[str], list[str]]:
    """The pieces of a sentencepiece model that may begin a word (they carry the marker) and that may go on.

    Control, unknown and byte pieces aren't text and are left out.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i))]
    return [p[1:] for p in pieces if p.startswith(marker) and len(p) > 1], [p for p in pieces if marker not in p]


_models: dict[int, tuple[LongestMatch, BoundedCache]] = {}
UNKNOWN = 1 << 40  # a stuck word: one token, and one in the count of unknown words


def token_counts(documents: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words and greedy word-piece tokens of each row's whole text, by the pieces in a sentencepiece model file.

    A word is a run of characters other than space and U+0009 to U+000D, of any length. A word that the pieces
    can't segment counts as one token and as unknown. Returns the id column, n_words, n_tokens and n_unknown.

    A null or empty text has zeros. Null and repeated ids are passed on, further columns are ignored whatever their
    names, an empty table gives an empty one. No shuffle: rows are independent.
    """
    pieces = documents.sparkSession.sparkContext.broadcast(read_pieces(path))
    one = documents.select(documents[id_col], documents[text_col])
    id_type = one.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        initial, inner = pieces.value
        key = hash((tuple(initial), tuple(inner)))
        if key not in _models:
            automaton = LongestMatch(initial, inner)

            def value(word: bytes) -> int:
                n = automaton.count(word.decode())
                return UNKNOWN + 1 if n is None else n

            _models[key] = automaton, BoundedCache(value, 600_000)
        look = _models[key][1].__getitem__
        for batch in batches:
            words, tokens, unknown = [], [], []
            for text in batch.column(1):
                found = (text.as_py() or "").encode().split()
                total = sum(map(look, found))
                words.append(len(found))
                tokens.append(total % UNKNOWN)
                unknown.append(total // UNKNOWN)
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (words, tokens, unknown))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "n_tokens", "n_unknown"])

    return one.mapInArrow(run, f"`{id_col}` {id_type}, n_words long, n_tokens long, n_unknown long")
