"""Operator 4: SimHash near-dedup with the codewords of a covering code as anchors.

The 64 bits are cut into blocks with thresholds t such that two fingerprints that differ in at most four bits differ
in at most t bits of some block (thresholds 1, 1 and 0: were all exceeded, five bits would differ). In a block of
threshold 1 the anchors are the words whose first 15 bits lie in the perfect Hamming code, with any values in the
other bits: every word has its home anchor within the covering radius 1. A fingerprint is replicated to its home and
to the anchors within radius plus threshold that can be home to a word within the threshold; so each linked pair
meets at the home of one of them, and is compared there in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juristream.llm.common import finished, materialise, scope, tidy
from juristream.llm.components import connected_components, local_roots

#: (lowest bit, width, threshold) of each block.
BLOCKS = ((0, 24, 1), (24, 24, 1), (48, 16, 0))
CODED = 15
#: Rows of one anchor beyond which its rows are dealt to several groups.
GROUP_ROWS = 20_000
#: Pairs compared at a time: a few MB of arrays.
CHUNK = 1 << 17
#: Rows of ids and hashes (about 40 bytes) that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 250_000


def fingerprint(text: str, shingle: int = 4, seed: int = 42) -> int:
    words = text.encode().lower().split()  # bytes: only A-Z change, and only space and 09-0D part words
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    votes, n = np.zeros(64, np.int64), len(words) - k + 1
    for at in range(0, n, 1 << 16):
        part = [digest(joined[a:b], seed) for a, b in zip(starts[at : at + (1 << 16)][: n - at].tolist(), (ends[k - 1 + at : k - 1 + at + (1 << 16)] - 1).tolist(), strict=False)]
        h = np.array(part, dtype=">u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def _homes() -> np.ndarray:
    """The codeword within distance 1 of each 15-bit word: its syndrome, the XOR of the places (from 1) of its ones, names the wrong bit."""
    x = np.arange(1 << CODED)
    syndrome = np.zeros_like(x)
    for place in range(1, CODED + 1):
        syndrome ^= np.where(x >> (place - 1) & 1, place, 0)
    return np.where(syndrome > 0, x ^ (1 << np.maximum(syndrome - 1, 0)), x)


HOME = _homes()


def home(words: np.ndarray, threshold: int) -> np.ndarray:
    """threshold 0: every word is an anchor, of radius 0."""
    low = (1 << CODED) - 1
    return words if threshold == 0 else words & ~low | HOME[words & low]


def anchors(prints: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By block: anchor, index into prints, and whether it is the print's home. No (anchor, print) comes twice."""
    for b, (low, width, threshold) in enumerate(BLOCKS):
        words = (prints.view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1)
        own = home(words, threshold)
        near = [own] + [home(words ^ (1 << i), threshold) for i in range(width)] * (threshold > 0)
        anchor, index = np.concatenate(near), np.tile(np.arange(len(words)), len(near))
        _, first = np.unique(anchor << 32 | index, return_index=True)
        anchor, index = anchor[first], index[first]
        yield b, anchor, index, anchor == own[index]


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy()
        for b, anchor, index, at_home in anchors(prints):
            yield pa.RecordBatch.from_arrays([pa.array(anchor << 2 | b), pa.array(prints[index]), pa.array(at_home)], names=["anchor", "print", "at_home"])


def _compare(threshold: int):
    """Over rows sorted by group: a forest of the pairs (home, any other) of all groups within the threshold."""

    def pairs(group: np.ndarray, prints: np.ndarray, at_home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]).any(axis=1)]))
        sizes = np.diff(np.append(starts, len(group)))
        of = np.repeat(np.arange(len(starts)), sizes)
        homes = np.flatnonzero(at_home & (sizes[of] > 1))
        a, b = [prints[:0]], [prints[:0]]
        count = sizes[of[homes]]
        done = np.cumsum(count)
        lo = 0
        while lo < len(homes):
            hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + CHUNK, "right")))
            h, c = homes[lo:hi], count[lo:hi]
            left = np.repeat(h, c)
            right = np.repeat(starts[of[h]], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            differ = np.bitwise_count((prints[left] ^ prints[right]).view(np.uint64))
            close = (differ <= threshold) & (left != right)
            x, y = local_roots(np.append(a[-1], prints[left[close]]), np.append(b[-1], prints[right[close]]))
            a, b = [x], [y]
            lo = hi
        return a[-1], b[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        a = b = np.empty(0, np.int64)
        for batch in batches:
            now = [np.stack([batch.column(c).to_numpy() for c in (0, 1, 2)], axis=1), batch.column(3).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False)]
            if kept is not None:
                now = [np.concatenate(z) for z in zip(kept, now, strict=True)]
            cut = len(now[0]) - int((now[0][::-1] == now[0][-1]).all(axis=1).argmin() if (now[0] != now[0][-1]).any() else len(now[0]))
            kept = [z[cut:] for z in now]  # the last group may go on in the next batch
            if cut:
                x, y = pairs(*(z[:cut] for z in now))
                a, b = local_roots(np.concatenate([a, x]), np.concatenate([b, y]))
        if kept is not None and len(kept[0]):
            x, y = pairs(*kept)
            a, b = local_roots(np.concatenate([a, x]), np.concatenate([b, y]))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def linked_prints(distinct: DataFrame, threshold: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """a, b: edges between fingerprints (column print) whose components are those of all pairs within the threshold (4 at most)."""
    if threshold > sum(t + 1 for _, _, t in BLOCKS) - 1:
        raise ValueError("these blocks cover at most four differing bits")
    rows = distinct.select("print").mapInArrow(_replicate, "anchor long, print long, at_home boolean")
    # An anchor that many prints share is cut into parts; each part meets each other, in a group of its own.
    hot = materialise(rows.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > group_rows).select("anchor", F.ceil(F.col("n") / group_rows).cast("int").alias("parts")), "hot-anchors")
    few = hot.count()
    if few:
        rows = rows.join(F.broadcast(hot) if few <= 10_000 else hot, "anchor", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64("print"), F.col("parts"))
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
        # A print at home asks in its part's row of groups, and answers in its part's column like the others.
        asks = rows.where("at_home").select("anchor", F.col("own").alias("i"), F.col("other").alias("j"), "print", "at_home")
        answers = rows.select("anchor", F.col("other").alias("i"), F.col("own").alias("j"), "print", (F.col("at_home") & (F.col("parts") == 1)).alias("at_home"))
        rows = asks.join(F.broadcast(hot) if few <= 10_000 else hot, "anchor", "left_semi").union(answers)
    else:
        rows = rows.select("anchor", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "print", "at_home")
    key = ["anchor", "i", "j"]
    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(tidy(_compare(threshold)), "a long, b long")


def _marked(documents: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """id, t (a hash of the text), print of every row, as a written table."""
    id_type = documents.schema[id_col].dataType.simpleString()

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", shingle) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["id", "t", "print"])

    text = documents[text_col]
    rows = documents.select(documents[id_col].alias("id"), F.xxhash64(text, text.isNull()).alias("t"), text.alias("text"))
    return materialise(rows.mapInArrow(tidy(prints), f"id {id_type}, t long, print long"), "prints")


def _named(marked: DataFrame, threshold: int) -> DataFrame:
    """print, component (a print), least (the smallest id) of every distinct print, as a written table."""
    with scope():
        distinct = marked.groupBy("print").agg(F.min("id").alias("least"))
        groups = connected_components(linked_prints(distinct, threshold), shrink=False)
        named = distinct.join(groups, distinct["print"] == groups["node"], "left").select("print", "least", F.coalesce("component", "print").alias("component"))
        return finished(named, "named")


def near_duplicates(documents: DataFrame, *, shingle: int = 4, threshold: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of whole texts, and components of fingerprints that differ in at most `threshold` bits.

    Returns one row per input row: the id, fingerprint (16 hexadecimal digits), component_id (the smallest id reachable).

    A null or blank text has fingerprint zero, linked like any other; fewer words than a shingle are one shingle.
    Equal fingerprints are compared once. Repeated ids stay rows of their own; null ids never name a component
    (only components without any other id have a null name). Further columns are ignored; an empty table gives an empty one.
    """
    marked = _marked(documents, shingle, id_col, text_col)
    named = _named(marked, threshold)
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = named.join(smallest, "component").select("print", "component_id")
    return marked.join(ids, "print").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_group(documents: DataFrame, *, shingle: int = 4, threshold: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near-duplicates: of each component of near_duplicates() the row of smallest id stays, with all its columns.

    Of rows that repeat that id the one of smallest text hash stays, of wholly equal rows one; a null id only stays where a component has
    no other. Only ids and hashes are shuffled, unless so many rows go that a list of them can't be broadcast.
    """
    with scope():
        goes, again = _to_drop(_marked(documents, shingle, id_col, text_col), threshold)
        goes, again = finished(goes, "goes"), finished(again, "again")
    key = F.struct(documents[id_col].alias("id"), F.xxhash64(documents[text_col], documents[text_col].isNull()).alias("t")).alias("key")
    rows = documents.select(F.struct(*[documents[c] for c in documents.columns]).alias("doc"), key)
    few = goes.count() <= BROADCAST_ROWS
    out = F.broadcast(goes) if few else goes
    left = rows.join(out, rows["key.id"].eqNullSafe(out["id"]) & (rows["key.t"] == out["t"]), "left_anti")
    n = again.count()
    if not n:
        return left.select("doc.*")
    twice = F.broadcast(again) if n <= BROADCAST_ROWS else again
    same = left["key.id"].eqNullSafe(twice["id"]) & (left["key.t"] == twice["t"])
    return left.join(twice, same, "left_anti").union(left.join(twice, same, "left_semi").dropDuplicates(["key"])).select("doc.*")


def _to_drop(marked: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(id, t) of the rows that go, and of those that stay but occur more than once."""
    named = _named(marked, threshold).select("print", "component")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("first")
    # Twice grouped: by print first, which combines before the shuffle, so a component of any size is a few rows.
    best = marked.groupBy("print").agg(first).join(named, "print").groupBy("component").agg(F.min("first").alias("first"))
    stays = materialise(best.select("first.id", "first.t"), "stays")
    goes = marked.select("id", "t").distinct().join(stays, _same(marked, stays), "left_anti")
    again = marked.groupBy("id", "t").agg(F.count("*").alias("n")).where("n > 1").join(stays, _same(marked, stays), "left_semi").select("id", "t")
    return goes, again


def _same(a: DataFrame, b: DataFrame):
    return a["id"].eqNullSafe(b["id"]) & (a["t"] == b["t"])
