"""Rows whose value is frequent, without shuffling the rare ones.

A value's hash of 32 bits is counted instead of the value: each task sorts its hashes, and sends them in SHARDS parts as the steps from one to
the next. A part has a counter for every hash; those that reach the least number are set in a bit field of FIELD bits a part (16 MB in all,
whatever the table), which is broadcast. What it lets through is all that is frequent and some that is not, so the caller still counts values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARDS = 1 << 10
#: Hashes of a part.
PLACES = (1 << 32) // SHARDS
FIELD = 1 << 17
#: Hashes that a task sorts together.
HELD = 1 << 22


def packed(hashes: np.ndarray, least: int) -> pa.RecordBatch:
    """One row a part: the steps between its distinct hashes, ascending, as three planes of bytes, and how often each occurs (`least` at most)."""
    x = hashes.view(np.uint32)
    found, times = np.unique((x % SHARDS) * np.uint32(PLACES) + x // SHARDS, return_counts=True)
    shards, edges = np.unique(found // PLACES, return_index=True)
    steps = np.diff(found % PLACES, prepend=np.uint32(0))
    steps[edges] = found[edges] % PLACES
    planes = steps.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    times = np.minimum(times, least).astype(np.uint8)
    cuts = list(zip(edges, np.append(edges[1:], len(found)), strict=True))
    columns = [pa.array(shards, pa.int32()), pa.array([planes[a:b].T.tobytes() for a, b in cuts], pa.binary()), pa.array([times[a:b].tobytes() for a, b in cuts], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["shard", "steps", "times"])


def field(parts: Iterator[tuple[bytes, bytes]], least: int) -> np.ndarray:
    """The bit field, as longs, of a part's hashes that occur `least` times; hashes share a bit if they differ by a multiple of FIELD."""
    counts = np.zeros(PLACES, np.uint8)
    for steps, times in parts:
        planes = np.frombuffer(steps, np.uint8).reshape(3, -1).astype(np.int64)
        at = np.cumsum(planes[0] | planes[1] << 8 | planes[2] << 16)
        counts[at] = np.minimum(counts[at] + np.frombuffer(times, np.uint8), least)
    bits = (counts >= least).reshape(-1, FIELD).any(axis=0)
    return np.packbits(bits, bitorder="little").view("<i8")


def _fields(rows: DataFrame, value: str, least: int) -> DataFrame:
    """its_shard, bits: the bit field of each part that has a hash of `value` in `least` rows or more."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            n += len(held[-1])
            if n >= HELD:
                yield packed(np.concatenate(held), least)
                held, n = [], 0
        if n:
            yield packed(np.concatenate(held), least)

    def count(table: pa.Table) -> pa.Table:
        bits = field(zip(table["steps"].to_pylist(), table["times"].to_pylist(), strict=True), least)
        some = [table["shard"][0].as_py()] if bits.any() else []
        return pa.table([pa.array(some, pa.int32()), pa.array([bits] if some else [], pa.list_(pa.int64()))], names=["its_shard", "bits"])

    parts = rows.select(F.hash(F.col(value)).alias("h")).mapInArrow(pack, "shard int, steps binary, times binary")
    return parts.groupBy("shard").applyInArrow(count, "its_shard int, bits array<long>")


def _let_through(rows: DataFrame, value: str, fields: DataFrame) -> DataFrame:
    h = F.hash(F.col(value))
    place = F.shiftrightunsigned(h, SHARDS.bit_length() - 1).bitwiseAND(FIELD - 1)
    is_set = F.getbit(F.get("bits", F.shiftright(place, 6)), place.bitwiseAND(63)) == 1
    return rows.join(F.broadcast(fields), (h.bitwiseAND(SHARDS - 1) == F.col("its_shard")) & is_set, "left_semi")


def maybe_frequent(rows: DataFrame, value: str, least: int) -> DataFrame:
    """The rows whose value in `value` occurs in `least` rows or more, and some others (those whose hashes share a bit with a frequent one's).

    Nulls are a value. Values of any type that Spark can hash; an empty table gives an empty one. `least` is 1 to 127.
    """
    if not 1 <= least <= 127:
        raise ValueError("counts are of 1 to 127")
    return _let_through(rows, value, _fields(rows, value, least))


def maybe_among(rows: DataFrame, value: str, wanted: DataFrame, its: str) -> DataFrame:
    """The rows whose value in `value` occurs in the column `its` of wanted, of the same type, and some others: so a join of all rows with wanted shuffles
    few that meet none. With more than some 10^7 wanted values more rows pass."""
    return _let_through(rows, value, _fields(wanted, its, 1))
