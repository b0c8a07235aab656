"""Operator 9: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Every pre-token is a linked list of byte pieces, and many of them share one queue. A bucket per merge rank holds the
positions at which a pair of that rank starts; a three-level bitmap over the ranks finds the lowest bucket that holds
anything by find-first-set. Entries aren't removed when a merge changes a pair: they are recognised as stale when they
are popped, and skipped. A bucket's merges are whole-array steps. n bytes take O(n log n) time however long their
pre-tokens are, where the usual rescan for the smallest rank takes O(n^2).
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from juristream.llm.common import BoundedCache, tidy


class RankQueue:
    """Buckets of positions by rank, under a bitmap of three levels.

    One bit per rank, one per 64 ranks, one per 4096 ranks, these last in a single integer. All is empty again once
    everything is popped, so one queue serves a whole worker.
    """

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << ((rank >> 6) & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list[np.ndarray]]:
        """The lowest rank that has positions, by find-first-set on each level, and its bucket."""
        a = (self.top & -self.top).bit_length() - 1
        word = self.mid[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        rank = b << 6 | (word & -word).bit_length() - 1
        self.low[b] = word & (word - 1)
        if not self.low[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        by = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[by], positions[by]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, some in zip(ranks[np.append(0, cuts)].tolist(), np.split(positions, cuts), strict=True):
            self.push(rank, some)


#: A space between two characters that are no white space always begins a pre-token of the usual patterns, which
#: take one space in front of letters, digits or marks; so texts can be cut there, and the cuts remembered.
CUT = re.compile(r"(?<=\S)(?= \S)")
#: Bytes of texts that are looked at together: what a worker holds is a few dozen times as much.
TOGETHER = 1 << 21


class ByteBPE:
    """ranks: token bytes -> id, where a lower id merges first, as in a tiktoken rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        size = max(ranks.values(), default=-1) + 1
        self.queue = RankQueue(size)
        self.tokens = [b""] * size
        for token, i in ranks.items():
            self.tokens[i] = token
        self.pieces: dict[str, bytes] = BoundedCache(lambda piece: self.encode_pieces([piece.encode()])[0], 50_000)
        self.chunks: dict[str, bytes] = BoundedCache(self.encode_chunk, 150_000)
        self.byte_id = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        # What two neighbours merge to, if their bytes together are a token: every way to cut a token into two tokens.
        found = [(x, y, i) for token, i in ranks.items() for n in range(1, len(token)) if (x := ranks.get(token[:n])) is not None and (y := ranks.get(token[n:])) is not None]
        self.left_right = np.array([x << 32 | y for x, y, _ in found], np.int64)
        self.merges_to = np.array([i for *_, i in found], np.int32)
        by = np.argsort(self.left_right)
        self.left_right, self.merges_to = np.append(self.left_right[by], np.iinfo(np.int64).max), np.append(self.merges_to[by], np.int32(-1))
        # Tokens that may be part of one of lower rank: a merge to such a token can make room for an earlier merge.
        self.falls = np.zeros(size, bool)
        self.falls[[x for pair in found for x in pair[:2] if pair[2] < x]] = True

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.searchsorted(self.left_right, key)
        return np.where(self.left_right[at] == key, self.merges_to[at], np.int32(-1))

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of many pre-tokens, each as unsigned 32-bit integers, by one queue for all of them.

        The pre-tokens lie behind one another; no merge crosses an end. As they don't touch, taking the lowest rank of all
        is for each of them taking its own lowest. A bucket's positions merge at once, of overlapping ones the leftmost first.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n, queue = len(data), self.queue
        token, after, before = self.byte_id[data], np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        whole = np.array([self.ranks.get(x, -1) for x in pieces], np.int32)
        stop = np.repeat(ends.astype(np.int32), sizes)
        before[(ends - sizes)[sizes > 0]] = -1
        pair = np.full(n, -1, np.int32)
        at = np.flatnonzero((after < stop) & np.repeat(whole < 0, sizes))
        pair[at] = self.merged(token[at], token[at + 1])
        alive = np.ones(n, bool)
        at = at[pair[at] >= 0]
        if len(at):
            queue.push_all(pair[at], at)
        while queue.top:
            rank, bucket = queue.pop()
            i = bucket[0] if len(bucket) == 1 else np.unique(np.concatenate(bucket))
            i = i[pair[i] == rank]  # the others are stale
            if not len(i):
                continue
            if len(i) > 1:
                if self.falls[rank]:  # then the leftmost of each pre-token alone
                    first = np.append(True, stop[i[1:]] != stop[i[:-1]])
                    if not first.all():
                        queue.push(rank, i[~first])
                        i = i[first]
                chained = np.append(False, i[1:] == after[i[:-1]])
                if chained.any():
                    place = np.arange(len(i))
                    i = i[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
            j = after[i]
            then = after[j]
            after[i], token[i], pair[i], pair[j], alive[j] = then, rank, -1, -1, False
            goes_on = then < stop[i]
            x, y = i[goes_on], then[goes_on]
            before[y] = x
            z = before[i]
            z = z[z >= 0]
            # Read after all of this bucket's merges are done, so neighbours that merged too are seen as they are now.
            pair[x] = self.merged(token[x], token[y])
            pair[z] = self.merged(token[z], token[after[z]])
            new = np.concatenate([x, z])
            new = new[pair[new] >= 0]
            if len(new):
                queue.push_all(pair[new], new)
        ids = token[alive].astype("<u4").tobytes()
        kept = np.concatenate([[0], np.cumsum(alive)])[np.concatenate([[0], ends])] * 4
        out = [ids[a:b] for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)]
        for k in np.flatnonzero(whole >= 0).tolist():
            out[k] = int(whole[k]).to_bytes(4, "little")
        return out

    def encode_chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(chunk)))

    @staticmethod
    def together(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """A batch's rows in slices of at most TOGETHER bytes of text, or of one row."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        lo = 0
        while lo < len(ends):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TOGETHER, "right")))
            yield batch.slice(lo, hi - lo)
            lo = hi

    @staticmethod
    def slices(text: str) -> Iterator[str]:
        """A long text in parts of about TOGETHER characters, cut where a pre-token always begins (a text without such a place is one part)."""
        at = 0
        while at < len(text):
            cut = CUT.search(text, at + TOGETHER) if at + TOGETHER < len(text) else None
            yield text[at : cut.start() if cut else len(text)]
            at = cut.start() if cut else len(text)

    def encode_some(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as unsigned 32-bit integers."""
        if len(texts) == 1 and len(texts[0]) > TOGETHER:
            yield b"".join(x for part in self.slices(texts[0]) for x in self._encode_together([part]))
        else:
            yield from self._encode_together(texts)

    def _encode_together(self, texts: list[str]) -> Iterator[bytes]:
        cut = [CUT.split(text) for text in texts]
        known = self.chunks.recall(set(chain.from_iterable(cut)))
        split = {x: self.split(x) for x, y in known.items() if y is None}
        of_piece = self.pieces.recall(set(chain.from_iterable(split.values())))
        new = [x for x, y in of_piece.items() if y is None]
        found = dict(zip(new, self.encode_pieces([x.encode() for x in new]), strict=True))
        of_piece |= found
        self.pieces.remember(found)
        look = of_piece.__getitem__
        found = {x: look(pieces[0]) if len(pieces) == 1 else b"".join(map(look, pieces)) for x, pieces in split.items()}
        del split, of_piece, new
        known |= found
        self.chunks.remember(found)
        look = known.__getitem__
        for chunks in cut:
            yield b"".join(map(look, chunks))

    def encode(self, text: str) -> array:
        return array("I", next(self.encode_some([text])))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def load_ranks(path: str) -> bytes:
    """A rank file's bytes; the driver reads it once and broadcasts it (one line per id, so its size is bound by the vocabulary)."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


_models: dict[tuple[str, str], ByteBPE] = {}


def model(data: bytes, pattern: str) -> ByteBPE:
    """A worker's model, made once per process."""
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _models:
        _models[key] = ByteBPE(parse_ranks(data), pattern)
    return _models[key]


def encode(documents: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode each row's whole text, then decode the ids again.

    Returns one row per input row: the id column, n_tokens, ids (array<int>, only if with_ids), ids_sha256 of the
    ids as little-endian unsigned 32-bit integers, decoded_sha256 of the decoded bytes, round_trip (whether these
    equal the text's bytes).

    A null text counts as empty (no ids; the hashes of nothing). Null or repeated ids are passed on, further
    columns are ignored whatever their names, an empty table gives an empty one. No shuffle: rows are independent.
    """
    spark = documents.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(path))
    one = documents.select(documents[id_col], documents[text_col])
    id_type = one.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, n_tokens long" + ", ids array<int>" * with_ids + ", ids_sha256 string, decoded_sha256 string, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(ranks.value, pattern)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            for part in m.together(batch):
                counts, ids_of, a, b, same = [], [], [], [], []
                texts = [x or "" for x in part.column(1).to_pylist()]
                for text, raw in zip(texts, m.encode_some(texts), strict=True):
                    back = m.decode(array("I", raw))
                    counts.append(len(raw) // 4)
                    if with_ids:
                        ids_of.append(np.frombuffer(raw, np.int32))
                    a.append(sha(raw))
                    b.append(sha(back))
                    same.append(back == text.encode())
                columns = [part.column(0), pa.array(counts, pa.int64())] + [pa.array(ids_of, pa.list_(pa.int32()))] * with_ids
                columns += [pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256", "round_trip"])
        # A worker goes on to other stages' tasks: it keeps the tables, not the texts' pieces.
        m.chunks.forget()
        m.pieces.forget()

    return one.mapInArrow(tidy(run), schema)
