"""Operator 7: removing repeated passages by suffix arrays over shards.

A string of `length` bytes that starts at two places has equal anchors there: of the hashes of its k-byte substrings the
smallest is chosen, so equal strings choose at equal offsets. Each anchor is kept with its stretch, the text of all
strings that choose it. An anchor that occurs once in the corpus rules its stretch out; all other stretches go to shards by
anchor, equal stretches once. A shard's suffix array, by induced sorting, and its permuted common prefixes then show
which strings start at several places. This loses nothing: equal strings have equal anchors, so they meet in a shard.

Runs of a number of words are found the same way, in texts whose every word is written as its hash of CODE bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juristream.llm.common import WORD, finished, give_back, materialise, scope, tidy
from juristream.llm.induced import SEPARATOR, permuted_prefixes, suffix_array

ANCHOR = 64
#: Bytes of a word's hash. Strings that start inside one are equal by an accident of 64 bits only, as are hashes of different words.
CODE = 8
#: Bytes of stretches that one suffix array covers.
SHARD_BYTES = 1 << 19
#: Of one anchor; the strings of more are dealt out by their own hash.
HOT_BYTES = 2 << 20
#: Of row keys that are broadcast, by a count of them first; more are joined by a shuffle.
BROADCAST_BYTES = 12 << 20
#: Places of a text that are looked at together.
SPAN = 1 << 20
MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def window_hashes(t: np.ndarray, k: int) -> np.ndarray:
    """A hash of every k-byte substring: a polynomial modulo 2^64, from prefix sums and inverse powers, then mixed."""
    n = len(t)
    powers = np.full(n, np.uint64(MULTIPLIER))
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    inverse = np.full(n - k + 1, np.uint64(pow(MULTIPLIER, -1, 1 << 64)))
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate((t.astype(np.uint64) + np.uint64(1)) * powers)])
    h = (sums[k:] - sums[:-k]) * inverse
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Of every w neighbours: from running minima forwards and backwards in blocks of w."""
    n = len(x)
    padded = np.concatenate([x, np.full(-n % w, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    forward = np.minimum.accumulate(padded, axis=1).ravel()
    backward = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[: n - w + 1], forward[w - 1 : n])


def stretches(text: bytes, length: int, k: int = ANCHOR) -> Iterator[tuple[int, int, int]]:
    """(place of the anchor, first and last place of the strings that choose it). The leftmost of equal hashes is chosen."""
    low = np.uint64(2 * SPAN - 1)
    for base in range(0, len(text) - length + 1, SPAN):
        t = np.frombuffer(text[base : base + SPAN + length - 1], np.uint8)
        h = window_hashes(t, k) & ~low | np.arange(len(t) - k + 1, dtype=np.uint64)
        chosen = (sliding_min(h, length - k + 1) & low).astype(np.int64)
        starts = np.append(0, np.flatnonzero(chosen[1:] != chosen[:-1]) + 1)
        for q, a, b in zip(chosen[starts].tolist(), starts.tolist(), np.append(starts[1:], len(chosen)).tolist(), strict=True):
            yield base + q, base + a, base + b - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def word_codes(text: bytes) -> bytes:
    """The hashes of a text's words; bytes.split() parts where WORD ends."""
    return b"".join(map(xxhash.xxh64_digest, text.split()))


def word_cuts(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of word_codes(text) as spans of the text, from the first whole word's start to the last one's end."""
    places = [m.span() for m in re.finditer(WORD.encode(), text)] if spans else []
    runs = [(-(-a // CODE), b // CODE) for a, b in spans]
    return [(places[a][0], places[b - 1][1]) for a, b in runs if a < b]


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def repeated_strings(owners: list[tuple], starts: list[int], texts: list[bytes], length: int) -> Iterator[tuple[int, int, int]]:
    """(index, from, to) of places, in the index-th stretch's own text, from where strings of `length` bytes also start elsewhere.

    Stretches of a row may overlap, so a string may lie twice at one place: only different (owner, place) count.
    """
    sizes = np.array([len(x) for x in texts])
    t = np.frombuffer(bytes([SEPARATOR]).join(texts), np.uint8)
    begins = np.cumsum(sizes + 1) - sizes - 1
    sa = suffix_array(t)
    common = permuted_prefixes(t, sa)[sa]
    number = {o: i for i, o in enumerate(dict.fromkeys(owners))}
    which = np.repeat(np.arange(len(texts)), sizes + 1)[: len(t)]
    place = np.arange(len(t)) - begins[which] + np.array(starts, np.int64)[which]
    corpus = np.array([number[o] for o in owners], np.int64)[which] << 40 | place
    heads = np.flatnonzero(common < length)
    there = corpus[sa]
    several = np.minimum.reduceat(there, heads) != np.maximum.reduceat(there, heads)
    found = np.zeros(len(t), bool)
    found[sa[np.repeat(several, np.diff(np.append(heads, len(t))))]] = True
    found &= np.arange(len(t)) + length <= (begins + sizes)[which]
    edge = np.diff(np.concatenate([[0], found.astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        i = which[a]
        yield int(i), int(a - begins[i]), int(b - begins[i])


def _few(keys: DataFrame) -> bool:
    """Whether keys, a table of long columns, may be broadcast; a row of a hashed relation takes some 32 bytes besides."""
    return keys.count() * (32 + 8 * len(keys.columns)) <= BROADCAST_BYTES


def _near(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """df's rows whose keys are in `keys` (distinct): before anything large is shuffled, if the keys are few."""
    return df.join(F.broadcast(keys) if _few(keys) else keys, on, "left_semi")


def repeated_spans(texts: DataFrame, length: int, by_words: bool = False) -> DataFrame:
    """texts: id, t (a hash of the text), text as binary; rows with equal id and t are equal. Returns id, t, at, to: what strings of `length`
    bytes cover that start elsewhere too, a row several times maybe. With by_words all of it, length too, is of word_codes(text)."""
    least = 2 * length // CODE - 1 if by_words else length

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.set_column(2, "text", pa.array([word_codes(x.as_py()) for x in batch.column(2)], pa.binary()))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = word_codes(text.as_py()) if by_words else text.as_py()
                for q, a, b in stretches(text, length):
                    s = xxhash.xxh64_intdigest(text[a : b + length])
                    out.append((_signed(xxhash.xxh64_intdigest(text[q : q + ANCHOR], 1)), _signed(s), i, t, a, b - a + length))
                if len(out) > 50_000:
                    yield rows(out)
                    out = []
            yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i > 3 else pa.int64()) for i, c in enumerate(columns)], names=["h", "s", "id", "t", "at", "size"])

    kinds = "h long, s long, id long, t long, at int, size int"
    all_rows = materialise(texts.where(F.octet_length("text") >= least).select("id", "t", "text").mapInArrow(tidy(find), kinds), "stretches")
    repeated = materialise(all_rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated-anchors")
    rows_left = materialise(_near(all_rows, repeated, ["h"]), "candidates")
    # One stretch stands for all equal ones; counts combine before the shuffle, so copies in thousands are no hot key.
    classes = materialise(rows_left.groupBy("h", "s").agg(F.count("*").alias("times"), F.min(F.struct("id", "t", "at")).alias("one"), F.any_value("size").alias("size")), "classes")
    copies = rows_left.join(classes.where("times > 1").select("h", "s"), ["h", "s"]).select("id", "t", "at", (F.col("at") + F.col("size")).alias("to"))

    groups = classes.groupBy("h").agg(F.count("*").alias("n"), F.sum(F.col("size").cast("long")).alias("bytes")).where("n > 1")
    members = materialise(classes.join(groups, "h").select("h", "one.*", "size", "bytes"), "members")
    sums = members.agg(F.sum(F.when(F.col("bytes") <= HOT_BYTES, F.col("size").cast("long"))), F.count_if(F.col("bytes") > HOT_BYTES)).first()
    shards = max(1, -(-(sums[0] or 0) // SHARD_BYTES))

    # The stretches' text: each text with members is cut up once.
    wanted = members.groupBy("id", "t").agg(F.collect_list(F.struct("h", "at", "size", "bytes")).alias("cuts"))
    holders = _near(texts, members.select("id", "t").distinct(), ["id", "t"])
    holders = holders.dropDuplicates(["id", "t"])
    holders = holders.select("id", "t", "text").mapInArrow(tidy(coded), "id long, t long, text binary") if by_words else holders
    cut = holders.join(wanted, ["id", "t"]).select("id", "t", "text", F.explode("cuts").alias("c"))
    cut = cut.select("id", "t", "c.h", "c.at", "c.bytes", F.expr("substring(text, c.at + 1, c.size)").alias("part"))
    cut = materialise(cut, "parts") if sums[1] else cut

    def shard(table: pa.Table) -> pa.Table:
        ids, ts, at, parts = (table[c].to_pylist() for c in ("id", "t", "at", "part"))
        found = [(ids[i], ts[i], at[i] + a, at[i] + b - 1 + length) for i, a, b in repeated_strings(list(zip(ids, ts, strict=True)), at, parts, length)]
        columns = list(zip(*found, strict=True)) or [()] * 4
        if table.nbytes > SHARD_BYTES // 2:
            give_back()
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["id", "t", "at", "to"])

    usual = cut.where(F.col("bytes") <= HOT_BYTES).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    spans = usual.groupBy("shard").applyInArrow(shard, "id long, t long, at long, to long").unionByName(copies)
    if sums[1]:
        spans = spans.unionByName(hot_strings(cut.where(F.col("bytes") > HOT_BYTES), length))
    return spans


def hot_strings(cut: DataFrame, length: int) -> DataFrame:
    """The exact way for anchors with too many different stretches for one suffix array: every string of them is a row, dealt by its
    hash. Strings at many places are counted before the shuffle; runs of neighbouring places come back as one span."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ts, ats, parts = (batch.column(i).to_pylist() for i in range(4))
            for i, t, at, part in zip(ids, ts, ats, parts, strict=True):
                n = len(part) - length + 1
                x = [xxhash.xxh3_128_intdigest(part[a : a + length]) for a in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_signed(v >> 64) for v in x], pa.int64()), pa.array([_signed(v & (1 << 64) - 1) for v in x], pa.int64()), pa.array([i] * n, pa.int64()), pa.array([t] * n, pa.int64()), pa.array(range(at, at + n), pa.int64())],
                    names=["a", "b", "id", "t", "at"],
                )

    rows = materialise(cut.select("id", "t", "at", "part").mapInArrow(tidy(strings), "a long, b long, id long, t long, at long").distinct(), "hot-strings")
    place = F.struct("id", "t", "at")
    several = rows.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("a", "b")
    return rows.join(several, ["a", "b"]).select("id", "t", "at", (F.col("at") + length).alias("to"))


def remove_repeats(documents: DataFrame, *, length: int = 400, words: int | None = None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, with_kept: bool = True, with_text: bool = False) -> DataFrame:
    """Removes every byte of a text's UTF-8 covered by a string of `length` bytes that also starts anywhere else in the table, the same text
    included; all are judged on the input. With `words`, so is every run of that many words, whatever blanks are between them: from its first
    word's start to its last one's end.

    Returns one row per input row: `doc` (a struct of the columns in `keep`, all by default), n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256 and, with with_kept, kept (binary); with with_text, text, the same as a string: parts of characters that a cut leaves
    behind are not in it.

    A null text counts as empty; texts shorter than `length` lose nothing. Strings never cross texts. Rows that repeat an id, or are equal, are
    places of their own, null ids too. An empty table gives an empty one.
    """
    keep = documents.columns if keep is None else keep
    if any(c == text_col for c in keep):
        keep = [c for c in keep if c != text_col]
    text = F.coalesce(documents[text_col], F.lit(""))
    doc = F.struct(*[documents[c] for c in keep]).alias("doc") if keep else F.struct(F.lit(None).alias("none")).alias("doc")
    ident = documents[id_col].cast("string")
    rows = documents.select(doc, F.xxhash64(F.coalesce(ident, F.lit("")), ident.isNull()).alias("id"), F.xxhash64(text).alias("t"), F.encode(text, "UTF-8").alias("text"))
    texts = rows.select("id", "t", "text")
    with scope():
        found = repeated_spans(texts, length)
        if words:
            by_words = repeated_spans(texts, words * CODE, by_words=True)
            found = found.withColumn("words", F.lit(False)).unionByName(by_words.withColumn("words", F.lit(True)))
        spans = finished(found.groupBy("id", "t").agg(F.collect_set(F.struct(*found.columns[2:])).alias("spans")), "spans")
    kind = rows.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept + ", text string" * with_text

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, runs, digests, kept = [], [], [], [], []
            for value, found in zip(batch.column(1), batch.column(2), strict=True):
                value = value.as_py()
                found = found.as_py()
                runs_of_words = word_cuts(value, [(x["at"], x["to"]) for x in found if x.get("words")])
                cuts = merged([(x["at"], x["to"]) for x in found if not x.get("words")] + runs_of_words)
                edges = [0, *(e for c in cuts for e in c), len(value)]
                left = b"".join(value[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                sizes.append(len(value))
                gone.append(len(value) - len(left))
                runs.append(len(cuts))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            columns = [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, gone, runs)), pa.array(digests, pa.string())] + [pa.array(kept, pa.binary())] * with_kept
            if with_text:
                columns.append(pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_kept, *["text"] * with_text])

    keys = spans.select("id", "t")
    if _few(keys):  # only texts that lose something are shuffled
        hit = rows.join(F.broadcast(keys), ["id", "t"], "left_semi").join(spans, ["id", "t"])
        rest = rows.join(F.broadcast(keys), ["id", "t"], "left_anti")
    else:
        both = rows.join(spans, ["id", "t"], "left")
        hit, rest = both.where("spans IS NOT NULL"), both.where("spans IS NULL")
    clean = rest.select("doc", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), *[F.col("text").alias("kept")] * with_kept, *[F.col("text").cast("string").alias("text")] * with_text)
    return hit.select("doc", "text", "spans").mapInArrow(tidy(remove), schema).unionByName(clean)
