"""Operator 11: token ids as files, a wavelet matrix a shard.

Documents are put in order by ranges of their ids; each task encodes its range and closes a shard when it is full. Spark's text writer
commits a shard as a file of its own (the format ends with a line feed for that), so a lost task leaves no half of one. A manifest, a row a shard,
has where each begins among all ids. What is asked of the files (documents, counts, places of a token) is asked shard by shard.
"""

from __future__ import annotations

import gc
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from juristream.llm.common import shared_path, tidy, written
from juristream.llm.wavelet import END, Shard, build

#: Bytes of text that a range should have, and that are encoded together.
RANGE_BYTES, TOGETHER = 16 << 20, 8 << 20
#: Chunks that a worker remembers (in two halves, the older of which is dropped), and the longest of them.
REMEMBERED, LONGEST = 500_000, 64
#: Words that are put into one text for the tokenizer.
WORDS = 256
#: Tokens at which a shard is closed.
SHARD_TOKENS = 1 << 21
#: Rows of a manifest that are broadcast; a longer one is joined by a shuffle.
BROADCAST_ROWS = 200_000
MANIFEST = "_manifest"
#: Kinds of bytes: part of other things, letter, mark, digit, blank or control.
OTHER, LETTER, MARK, DIGIT, BLANK = range(5)
KIND = np.array([BLANK if b <= 0x20 or b == 0x7F else OTHER if b > 0x7F else LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else MARK for b in range(256)], np.uint8)
#: First bytes of two that white space beyond ASCII may have; 0xC3 is followed by a letter but for these two.
BLANK_PAIRS, NO_LETTER = (0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380), (0x97, 0xB7)


def cuts(data: np.ndarray) -> np.ndarray:
    """Whether a text in UTF-8 may be cut in front of each byte, as byte-level BPE splits it: a piece surely begins there, and what is behind
    doesn't change the pieces in front. (A space goes with what follows it; a run of white space in front of that is a piece.)

    Cuts are made at a space without white space behind, between a letter and a mark, and on both sides of a line feed that stands alone."""
    kind = KIND[data]
    nothing = np.zeros(len(data) + 2, np.uint8)
    padded, kinds = nothing.copy(), nothing.copy()
    padded[:-2], kinds[:-2] = data, kind
    kinds[-2:] = BLANK
    wide = padded[:-2].astype(np.uint16) << 8 | padded[1:-1]
    solid = (kind != BLANK) & ~np.isin(wide, BLANK_PAIRS)  # begins with something that isn't white space, or is the inner byte of a character
    solid = np.append(solid, False)
    out = (data == 0x20) & solid[1:]
    letter = kind == LETTER
    letter[1:] |= (data[:-1] == 0xC3) & ~np.isin(data[1:], NO_LETTER)
    out[1:] |= letter[:-1] & (kind[1:] == MARK)
    graphic = (kind > OTHER) & (kind < BLANK)
    alone = np.zeros(len(data), bool)
    alone[1:-1] = (data[1:-1] == 0x0A) & graphic[:-2] & solid[2:-1]
    out |= alone
    out[1:] |= alone[:-1]
    return out


class Encoder:
    """A tokenizer file of the tokenizers library, text by text or, if it splits texts as byte-level BPE does, by distinct chunks.

    Chunks lie between cuts(); those of a batch are found as a dictionary in Arrow, and the library only sees what isn't remembered."""

    def __init__(self, file: str, by_chunks: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.encode_special_tokens = True  # their names in a text are text
        self.by_chunks = by_chunks
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith("\u0120")]] = True  # how byte-level BPE writes a space
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> Iterator[bytes]:
        for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            yield array("I", e.ids).tobytes()

    def _new(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk. Chunks of a space and letters are one word each for the tokenizer, also in a text of many, whose ids are parted where
        one stands for a space with what follows."""
        out: list[bytes | None] = [None] * len(chunks)
        words = [i for i, x in enumerate(chunks) if x[0] == " " and x[1:].isalpha()]
        groups = [words[i : i + WORDS] for i in range(0, len(words), WORDS)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(["".join(chunks[i] for i in g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) != len(group):
                continue  # one by one
            raw, cut = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
            for i, lo, hi in zip(group, cut, cut[1:], strict=False):
                out[i] = raw[lo:hi]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, x in zip(rest, self._library([chunks[i] for i in rest]), strict=True):
            out[i] = x
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls) behind one another, and how many each has."""
        gc.disable()  # very many small objects, none in a cycle
        try:
            return self._encode(texts)
        finally:
            gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_chunks:
            each = [np.frombuffer(x, np.uint32) for x in self._library(texts.to_pylist())]
            return np.concatenate([*each, np.empty(0, np.uint32)]), np.array([len(x) for x in each], np.int64)
        texts = pa.concat_arrays([texts.cast(pa.large_string())])
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        if offsets[0] == offsets[-1]:
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        begins = cuts(data)
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        begins = np.append(np.flatnonzero(begins), len(data))
        code = pa.LargeStringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins), pa.py_buffer(data)).dictionary_encode()
        chunks, at = code.dictionary.to_pylist(), code.indices.to_numpy()
        ids = list(map(self.young.get, chunks))
        unknown = [i for i, x in enumerate(ids) if x is None]
        again, new = self.old, []
        for i in unknown:
            if (x := again.get(chunks[i])) is None:
                new.append(i)
            else:
                ids[i] = x
        for i, x in zip(new, self._new([chunks[i] for i in new]), strict=True):
            ids[i] = x
        if len(self.young) + len(unknown) > REMEMBERED // 2:
            self.old, self.young = self.young, {}
        self.young |= {chunks[i]: ids[i] for i in unknown[: REMEMBERED // 2] if len(chunks[i]) <= LONGEST}
        sizes = np.fromiter(map(len, ids), np.int32, len(ids)) >> 2
        pool, starts, size = np.frombuffer(b"".join(ids), np.uint32), (np.cumsum(sizes) - sizes).astype(np.int32), sizes[at]
        stop = np.append(0, np.cumsum(size))
        # 32 bits do: one text is below 2 ** 31 bytes, and has no more tokens than bytes.
        every = pool[np.repeat(starts[at] - stop[:-1].astype(np.int32), size) + np.arange(stop[-1], dtype=np.int32)]
        return every, np.diff(stop[np.searchsorted(begins, offsets)])


_encoders: dict[tuple[int, bool], Encoder] = {}


def encoder(file: str, by_chunks: bool) -> Encoder:
    """A worker's encoder, made once a process."""
    key = (hash(file), by_chunks)
    if key not in _encoders:
        _encoders[key] = Encoder(file, by_chunks)
    return _encoders[key]


def together(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch's rows in slices of at most TOGETHER bytes of text (column 1), or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + TOGETHER, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def write(documents: DataFrame, tokenizer: str, path: str, *, by_chunks: bool = False, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode each row's whole text, append end_id, and write all ids in ascending order of the id column to files in `path`.

    tokenizer: a file of the tokenizers library. by_chunks: whether it splits texts by the usual pattern of byte-level BPE (letters, digits or marks with
    a space in front, white space), so that distinct chunks can be encoded once (else texts go to the library whole). Names of special tokens in
    a text are text.

    A shard is closed at shard_tokens; a document lies in one shard, which may so be longer. Null texts count as empty. Null ids come last; rows that
    repeat an id lie behind one another in the order of their texts' hashes, whatever their number: the ranges that tasks get also cut through them.
    Further columns are ignored. An empty table gives no files.

    Returns the manifest (shards())."""
    spark = documents.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        file = spark.sparkContext.broadcast(f.read())  # a vocabulary: its size is the tokenizer's
    rows = documents.select(documents[id_col].alias("id"), F.coalesce(documents[text_col], F.lit("")).alias("text"))
    # Equal rows are told apart by their number, so that any key can be cut: which of them comes first makes no difference.
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    order = [F.col("id").asc_nulls_last(), F.col("tie"), F.col("row")]
    ranges = rows.repartitionByRange(max(1, size // RANGE_BYTES), *order).sortWithinPartitions(*order).select("id", "text")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, number = encoder(file.value, by_chunks), TaskContext.get().partitionId(), 0
        ids, counts, names, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            table = pa.table({"id": pa.concat_arrays(names), "n": np.concatenate(counts)})
            file = build(np.concatenate(ids), table, part, number)
            return pa.RecordBatch.from_arrays([pa.array([file.removesuffix(END)], pa.binary())], names=["file"])  # the writer ends it

        for batch in batches:
            for some in together(batch):
                found, sizes = e.encode(some.column(1))
                stop = np.cumsum(sizes)
                found, sizes = np.insert(found, stop, np.uint32(end_id)), sizes + 1
                stop, lo = np.cumsum(sizes), 0
                while lo < len(sizes):
                    before = int(stop[lo - 1]) if lo else 0
                    hi = max(lo + 1, int(np.searchsorted(stop, before + shard_tokens - held, "right")))
                    ids.append(found[before : stop[hi - 1]])
                    counts.append(sizes[lo:hi])
                    names.append(some.column(0).slice(lo, hi - lo))
                    held += len(ids[-1])
                    lo = hi
                    if held >= shard_tokens or lo < len(sizes):
                        yield close()
                        ids, counts, names, held, number = [], [], [], 0, number + 1
        if held:
            yield close()

    files = ranges.mapInArrow(tidy(shards), "file binary").select(F.col("file").cast("string").alias("value"))
    files.write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)
    return _manifest(spark, path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Shard(x.as_buffer()) for x in batch.column(0)]
            yield pa.RecordBatch.from_pydict({"part": [s.part for s in found], "number": [s.number for s in found], "tokens": [s.n for s in found], "documents": [s.n_documents for s in found]}, schema=pa.schema([(c, pa.int64()) for c in ("part", "number", "tokens", "documents")]))

    found = written(_files(spark, path).mapInArrow(tidy(heads), "part long, number long, tokens long, documents long"), shared_path(spark, "heads"))
    # Sums of parts first, so that only a row a part, not a shard, passes the window without a key.
    parts = found.groupBy("part").agg(F.sum("tokens").alias("all")).withColumn("before", F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.sum("tokens").over(Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1))
    whole = found.withColumn("within", within).join(parts.select("part", "before"), "part")
    starts = F.coalesce("before", F.lit(0)) + F.coalesce("within", F.lit(0))
    return written(whole.select("part", "number", starts.alias("start"), "tokens", "documents"), f"{path}/{MANIFEST}")


def shards(spark: SparkSession, path: str) -> DataFrame:
    """part, number, start (ids before the shard), tokens, documents of each shard."""
    return spark.read.parquet(f"{path}/{MANIFEST}")


def _with_starts(found: DataFrame, path: str) -> DataFrame:
    starts = shards(found.sparkSession, path).select("part", "number", F.col("start").alias("shard_start"))
    return found.join(F.broadcast(starts) if starts.count() <= BROADCAST_ROWS else starts, ["part", "number"])


def documents(spark: SparkSession, path: str, id_type: str = "long", *, with_ids: bool = True) -> DataFrame:
    """Every document in the files: doc_id, start, n_tokens (with the end id), ids (array<int>, only if with_ids), ids_crc32 of the ids as
    little-endian unsigned 32-bit integers."""
    schema = f"part long, number long, doc_id {id_type}, at long, n_tokens long" + ", ids array<int>" * with_ids + ", ids_crc32 long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                s = Shard(x.as_buffer())
                table, ids = s.documents, s.ids()
                n = table["n"].to_numpy()
                stop = np.cumsum(n)
                each = np.split(ids, stop[:-1])
                columns = [pa.array(np.full(len(n), k, np.int64)) for k in (s.part, s.number)] + [table["id"].combine_chunks(), pa.array(stop - n), pa.array(n)]
                columns += [pa.ListArray.from_arrays(pa.array(np.append(0, stop), pa.int32()), pa.array(ids.view(np.int32)))] * with_ids
                columns.append(pa.array([zlib.crc32(a.astype("<u4").tobytes()) for a in each], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=["part", "number", "doc_id", "at", "n_tokens", *["ids"] * with_ids, "ids_crc32"])

    found = _with_starts(_files(spark, path).mapInArrow(tidy(read), schema), path)
    return found.select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", *["ids"] * with_ids, "ids_crc32")


def counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """token, n: how often each of the tokens (repeats are one) occurs in all files. Of each shard two ranks a plane are read."""
    asked = sorted(set(tokens))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                s = Shard(x.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array([s.count(t) for t in asked], pa.int64())], names=["token", "n"])

    return _files(spark, path).mapInArrow(tidy(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, path: str, token: int, id_type: str = "long") -> DataFrame:
    """doc_id, start of the document, place (among all ids) of every occurrence of a token, found by select from the last plane up."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                s = Shard(x.as_buffer())
                at, table = s.find(token), s.documents
                n = table["n"].to_numpy()
                stop = np.cumsum(n)
                doc = np.searchsorted(stop, at, "right")
                columns = [pa.array(np.full(len(at), k, np.int64)) for k in (s.part, s.number)]
                yield pa.RecordBatch.from_arrays([*columns, table["id"].combine_chunks().take(pa.array(doc)), pa.array((stop - n)[doc]), pa.array(at)], names=["part", "number", "doc_id", "doc_at", "at"])

    found = _with_starts(_files(spark, path).mapInArrow(tidy(find), f"part long, number long, doc_id {id_type}, doc_at long, at long"), path)
    return found.select("doc_id", (F.col("shard_start") + F.col("doc_at")).alias("start"), (F.col("shard_start") + F.col("at")).alias("place"))
