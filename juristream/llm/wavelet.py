"""A shard of token ids as a wavelet matrix: one compressed file that answers access, count and occurrence lookup.

Plane by plane, from the highest bit of the ids down, the bits are stored in the order that the planes above leave (zeros in front of ones, each
in the order they had). A plane is cut into blocks of 2 ** BLOCK bits, compressed one by one; a directory says where each block lies and how many
ones come before it. So rank and select read one block a plane, whatever the shard's size.

Layout of a file, all numbers little-endian: HEADER; a directory of uint64 (for each plane its zeros, the ones before each block, the end of
each block's bytes); the documents' ids and numbers of tokens as a compressed Arrow stream; the blocks, plane by plane; a line feed.
"""

from __future__ import annotations

import io
import struct

import numpy as np
import pyarrow as pa
import pyarrow.ipc as ipc

BLOCK = 18
#: Magic, planes, part and number of the shard in its part, tokens, documents, bytes of the documents' stream.
HEADER = struct.Struct("<4sIQQQQQ")
MAGIC, END = b"JWM1", b"\n"


def _codec() -> pa.Codec:
    return pa.Codec("zstd", 1)


def build(ids: np.ndarray, documents: pa.Table, part: int = 0, number: int = 0) -> bytes:
    """The file of a shard: ids (unsigned) of its documents, whose columns are id and n (tokens)."""
    n, planes, codec = len(ids), max(1, int(ids.max(initial=0)).bit_length()), _codec()
    directory, blocks, at = [], [], 0
    ids = ids.astype(np.uint16 if planes <= 16 else np.uint32)
    for plane in range(planes - 1, -1, -1):
        bits = (ids >> ids.dtype.type(plane) & ids.dtype.type(1)).astype(bool)
        ones, ends = [0], []
        for lo in range(0, n, 1 << BLOCK):
            some = bits[lo : lo + (1 << BLOCK)]
            ones.append(ones[-1] + int(np.count_nonzero(some)))
            blocks.append(codec.compress(np.packbits(some).tobytes(), asbytes=True))
            at += len(blocks[-1])
            ends.append(at)
        directory.append(np.array([n - ones[-1], *ones[:-1], *ends], "<u8").tobytes())
        ids = np.concatenate([ids[~bits], ids[bits]])
    out = io.BytesIO()
    with ipc.new_stream(out, documents.schema, options=ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(documents)
    stream = out.getvalue()
    return b"".join([HEADER.pack(MAGIC, planes, part, number, n, documents.num_rows, len(stream)), *directory, stream, *blocks, END])


class Shard:
    """Reads a file of build(); only the blocks that a question needs are decompressed."""

    def __init__(self, data: bytes):
        self.data = memoryview(data).cast("B")
        if self.data[: len(MAGIC)] != MAGIC or len(self.data) < HEADER.size:
            raise ValueError("not a whole file of a shard")
        _, self.planes, self.part, self.number, self.n, self.n_documents, stream = HEADER.unpack_from(self.data)
        blocks = -(-self.n // (1 << BLOCK))
        each = 8 * (1 + 2 * blocks)
        self._stream = HEADER.size + self.planes * each, stream
        self._first = sum(self._stream)
        directory = np.frombuffer(self.data, "<u8", self.planes * each // 8, HEADER.size).astype(np.int64).reshape(self.planes, -1)
        self.zeros, self.ones, self.ends = directory[:, 0], directory[:, 1 : 1 + blocks], directory[:, 1 + blocks :]
        whole = self._first + (int(self.ends[-1, -1]) if blocks else 0)
        if len(self.data) != whole + 1 or self.data[whole:] != END:
            raise ValueError("not a whole file of a shard")
        self.decompressed = 0  # blocks so far

    @property
    def documents(self) -> pa.Table:
        """Columns id, n in the shard's order."""
        at, size = self._stream
        return ipc.open_stream(self.data[at : at + size]).read_all()

    def _bits(self, plane: int, block: int) -> np.ndarray:
        flat = plane * self.ends.shape[1] + block
        lo, hi = (int(self.ends.flat[flat - 1]) if flat else 0), int(self.ends.flat[flat])
        size = min(1 << BLOCK, self.n - (block << BLOCK))
        self.decompressed += 1
        raw = _codec().decompress(pa.py_buffer(self.data[self._first + lo : self._first + hi]), decompressed_size=-(-size // 8))
        return np.unpackbits(np.frombuffer(raw, np.uint8), count=size).view(bool)

    def plane(self, plane: int) -> np.ndarray:
        return np.concatenate([self._bits(plane, b) for b in range(self.ends.shape[1])] or [np.empty(0, bool)])

    def _by_block(self, block: np.ndarray):
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order])) + 1
        return [(int(block[some[0]]), some) for some in np.split(order, cuts) if len(some)]

    def rank(self, plane: int, at: np.ndarray) -> np.ndarray:
        """How many ones lie before each of the places 0 to n."""
        at = np.asarray(at, np.int64)
        out = np.full(len(at), self.n - self.zeros[plane], np.int64)
        inside = np.flatnonzero(at < self.n)
        for block, some in self._by_block(at[inside] >> BLOCK):
            some = inside[some]
            before = np.concatenate([[0], np.cumsum(self._bits(plane, block))])
            out[some] = self.ones[plane, block] + before[at[some] - (block << BLOCK)]
        return out

    def bits(self, plane: int, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), bool)
        for block, some in self._by_block(at >> BLOCK):
            out[some] = self._bits(plane, block)[at[some] - (block << BLOCK)]
        return out

    def select(self, plane: int, bit: int, k: np.ndarray) -> np.ndarray:
        """The places of the k-th (from 0) ones, or zeros."""
        starts = self.ones[plane] if bit else (np.arange(self.ones.shape[1], dtype=np.int64) << BLOCK) - self.ones[plane]
        out = np.zeros(len(k), np.int64)
        for block, some in self._by_block(np.searchsorted(starts, k, "right") - 1):
            bits = self._bits(plane, block)
            out[some] = (block << BLOCK) + np.flatnonzero(bits if bit else ~bits)[k[some] - starts[block]]
        return out

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at some places."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for plane in range(self.planes):
            bit, ones = self.bits(plane, at), self.rank(plane, at)
            out = out << 1 | bit
            at = np.where(bit, self.zeros[plane] + ones, at - ones)
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of token among the places lo to hi lie below the last plane."""
        if token < 0 or token >> self.planes:
            return 0, 0
        for plane in range(self.planes):
            if lo >= hi:
                break
            a, b = self.rank(plane, np.array([lo, hi])).tolist()
            one = token >> (self.planes - 1 - plane) & 1
            lo, hi = (int(self.zeros[plane]) + a, int(self.zeros[plane]) + b) if one else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return max(0, b - a)

    def find(self, token: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The places lo to hi that hold the token, in order."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        at = np.arange(a, max(a, b), dtype=np.int64)
        for plane in range(self.planes - 1, -1, -1):
            one = token >> (self.planes - 1 - plane) & 1
            at = self.select(plane, one, at - (int(self.zeros[plane]) if one else 0))
        return np.sort(at)

    def ids(self) -> np.ndarray:
        """All ids: from the last plane up, zeros and ones go back to where the plane has them."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for plane in range(self.planes - 1, -1, -1):
            bits, above = self.plane(plane), np.empty(self.n, kind)
            zeros = int(self.zeros[plane])
            above[~bits] = out[:zeros]
            above[bits] = out[zeros:] | kind(1 << (self.planes - 1 - plane))
            out = above
        return out.astype(np.uint32)
