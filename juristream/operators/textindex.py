"""A stored inverted index: postings in blocks of documents, searched by BM25 with bounds that tell which blocks to read.

A segment holds the documents of one addition. Its documents lie in blocks of like length; for each word and block one row has the postings and what
bounds them: how many, the largest count of the word, the least length of a document. As a score grows with the count and falls with the length,
these bound every score in the block whatever the collection's mean length is by the time of the search. Bounds and postings are columns of one
table, so bounds are read without postings.

A search adds up the bounds of each query's words by block, scores the blocks that promise most until they surely hold enough documents,
and then reads only blocks whose bound reaches the score of the last of these. Segments become visible by a single row that is written last, and a
merge replaces them in the same way, without reading a text again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from juristream.functions import text as T
from juristream.operators.lineage import cut

#: Documents of a block, and postings that one folder of words should have.
BLOCK, FOLDER = 4096, 50_000_000
#: What scores may differ by when their parts are added in another order.
SLACK = 1e-8


def idf(n: Column, df: Column) -> Column:
    return F.ln(1 + (n - df + 0.5) / (df + 0.5))


def weight(tf: Column, length: Column, mean: Column, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def _folder(term: Column, folders: Column | int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(folders) if isinstance(folders, int) else folders).cast("int")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """segment, first, folders, n, words of the segments in use: those that no later one replaces (it names the first that it does)."""
    try:
        every = spark.read.parquet(f"{path}/segments")
    except AnalysisException:
        return spark.createDataFrame([], "segment int, first int, folders int, n long, words long, name string")
    later = every.select(F.col("segment").alias("_s"), F.col("first").alias("_f")).where("_f < _s")
    return every.join(F.broadcast(later), (F.col("_f") <= F.col("segment")) & (F.col("segment") < F.col("_s")), "left_anti")


def add(docs: DataFrame, path: str, *, key: str, text: str, block: int = BLOCK, folder: int = FOLDER) -> int:
    """Index the documents of a table as a new segment; the collection at `path` begins with the first. Returns the segment's number.

    Each text is cut into words once. Keys must be new and not null; a null text has no words. Words of a document are counted before the shuffle."""
    spark = docs.sparkSession
    words = F.sort_array(T.tokens(F.col(text)))
    name = uuid.uuid4().hex
    sized = cut(docs.select(F.col(key).alias("key"), words.alias("words"))).withColumn("length", F.size("words"))
    # Lengths in bands of a quarter more each; a band's documents are dealt to as many blocks as it needs.
    banded = sized.withColumn("band", F.floor(F.ln(F.col("length") + 1) / F.lit(0.2231)).cast("int"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("n"), F.sum("length").alias("words"), F.count_if(F.col("key").isNull()).alias("nameless")).collect()  # fewer than a hundred rows
    if any(r["nameless"] for r in sizes):
        raise ValueError("a document without a key")
    blocks, total, n_words = {}, 0, sum(r["words"] for r in sizes)
    for r in sorted(sizes):
        blocks[r["band"]] = (total, -(-r["n"] // block))
        total += blocks[r["band"]][1]
    of = F.create_map(*[F.lit(x) for band, (start, many) in blocks.items() for x in (band, F.struct(F.lit(start).alias("start"), F.lit(many).alias("many")))]) if blocks else None
    number = (segments(spark, path).agg(F.max("segment")).first()[0] or 0) + 1
    folders = max(1, n_words // folder)
    if blocks:
        banded = banded.withColumn("at", of[F.col("band")]).withColumn("block", (F.col("at.start") + F.pmod(F.xxhash64("key"), F.col("at.many"))).cast("int"))
        banded.select("key", "length", "block").write.parquet(f"{path}/keys/segment={number}/{name}")
        mine = spark.read.parquet(f"{path}/keys/segment={number}/{name}")
        repeated = mine.groupBy("key").count().where("count > 1").limit(1).count()
        known = _keys(spark, path)
        if repeated or (known is not None and mine.select("key").join(known.select("key"), "key", "left_semi").limit(1).count()):
            raise ValueError("a key is there already")
        # A word's count is the distance to where the next word begins, so nothing is shuffled for it.
        begins = F.filter(F.sequence(F.lit(1), F.col("length")), lambda i: ~F.get("words", i - 1).eqNullSafe(F.get("words", i - 2)))
        begun = banded.where("length > 0").select("key", "length", "block", "words", begins.alias("begins"))
        counts = F.transform("begins", lambda i, k: F.struct(F.get("words", i - 1).alias("term"), (F.coalesce(F.get("begins", k + 1), F.col("length") + 1) - i).cast("long").alias("tf")))
        counted = begun.select("key", "length", "block", F.inline(counts))
        rows = counted.withColumn("folder", _folder(F.col("term"), folders)).repartitionByRange(_parts(n_words), "folder", "term", "block")
        grouped = rows.groupBy("folder", "term", "block").agg(F.count("*").alias("n"), F.max("tf").alias("most"), F.min("length").alias("least"), F.collect_list(F.struct("key", "tf", "length")).alias("docs"))
        if n_words:
            _write(grouped, path, number, name)
    n = sum(r["n"] for r in sizes)
    _commit(spark, path, number, number, folders, n, n_words, name)
    return number


def _parts(words: int) -> int:
    return max(8, words // 5_000_000)


def _write(rows: DataFrame, path: str, number: int, name: str) -> None:
    # Range order by word: a file's row groups hold few words each, and a folder's words are in a few files.
    rows.sortWithinPartitions("folder", "term", "block").write.partitionBy("folder").parquet(f"{path}/postings/{number}-{name}")


def _commit(spark: SparkSession, path: str, number: int, first: int, folders: int, n: int, words: int, name: str) -> None:
    row = spark.createDataFrame([(number, first, folders, n, words, name)], "segment int, first int, folders int, n long, words long, name string")
    row.coalesce(1).write.mode("append").parquet(f"{path}/segments")


def _keys(spark: SparkSession, path: str) -> DataFrame | None:
    """key, length, block of the segments in use that have documents."""
    return _union(spark, path, "n", lambda r: spark.read.parquet(f"{path}/keys/segment={r['segment']}/{r['name']}"))


def _postings(spark: SparkSession, path: str) -> DataFrame | None:
    """segment, folders, folder, term, block, n, most, least, docs of the segments in use that have words."""
    return _union(spark, path, "words", lambda r: spark.read.parquet(f"{path}/postings/{r['segment']}-{r['name']}").select(F.lit(r["segment"]).alias("segment"), F.lit(r["folders"]).alias("folders"), "folder", "term", "block", "n", "most", "least", "docs"))


def _union(spark: SparkSession, path: str, some: str, read: Callable) -> DataFrame | None:
    out = None
    for r in segments(spark, path).where(F.col(some) > 0).orderBy("segment").collect():  # a row a segment; merge() keeps them few
        out = read(r) if out is None else out.unionByName(read(r))
    return out


def merge(spark: SparkSession, path: str) -> int:
    """Replace the segments in use by one that has all their blocks. Returns its number. Searches that began before go on reading the old ones."""
    live = segments(spark, path).orderBy("segment").collect()
    if len(live) <= 1:
        return live[0]["segment"] if live else 0
    number, name = live[-1]["segment"] + 1, uuid.uuid4().hex
    words, n = sum(r["words"] for r in live), sum(r["n"] for r in live)
    folders = max(1, words // FOLDER)
    rows, keys = _postings(spark, path), _keys(spark, path)
    if keys is not None:
        keys.write.parquet(f"{path}/keys/segment={number}/{name}")
    if rows is not None:
        # Blocks of different segments stay apart: a block's number is made of both.
        shifted = rows.withColumn("block", (F.col("block") + _shift(spark, path, live)).cast("int")).withColumn("folder", _folder(F.col("term"), folders)).drop("segment", "folders")
        _write(shifted.repartitionByRange(_parts(words), "folder", "term", "block"), path, number, name)
    _commit(spark, path, number, min(r["first"] for r in live), folders, n, words, name)
    return number


def _shift(spark: SparkSession, path: str, live: list) -> Column:
    """What a segment's block numbers are moved by: those of the segments before it."""
    out, total = F.lit(0), 0
    for r in live:
        out = F.when(F.col("segment") == r["segment"], total).otherwise(out)
        if r["words"]:
            total += 1 + spark.read.parquet(f"{path}/postings/{r['segment']}-{r['name']}").agg(F.max("block")).first()[0]
    return out


def _best_of_block(terms: list, docs: pa.ListArray, asks: pa.Table, limit: int, mean: float, k1: float, b: float) -> pa.Table:
    """query_id, key, score of the first `limit` documents of one block for each row of asks (query_id, terms: term and idf). docs: the postings of each of terms."""
    sizes, flat = pc.list_value_length(docs).to_numpy(zero_copy_only=False), docs.flatten()
    ends = np.cumsum(sizes, dtype=np.int64)
    at = {t: slice(e - n, e) for t, n, e in zip(terms, sizes, ends, strict=True)}
    keys = flat.field("key").dictionary_encode()
    own, place = keys.indices.to_numpy(zero_copy_only=False), np.empty(len(keys.dictionary), "int64")
    place[pc.sort_indices(keys.dictionary).to_numpy()] = np.arange(len(place))
    tf, length = (flat.field(c).to_numpy(zero_copy_only=False).astype("float64") for c in ("tf", "length"))
    part = weight(tf, length, mean, k1, b)
    rows, found, scores = [own[:0]], [own[:0]], [part[:0]]
    for n, words in enumerate(asks["terms"].to_pylist()):
        total = np.zeros(len(place))
        for w in words:
            if w["term"] in at:
                here = at[w["term"]]  # a document has a word once
                total[own[here]] += w["idf"] * part[here]
        hits = np.flatnonzero(total)
        # Sums of doubles depend on their order: equal scores are equal to nine digits.
        near = np.floor(total[hits] * 1e9 + 0.5) / 1e9
        if len(hits) > limit:
            least = np.partition(near, len(near) - limit)[len(near) - limit]
            hits, near = hits[near >= least], near[near >= least]
        first = np.lexsort((place[hits], -near))[:limit]
        rows.append(np.full(len(first), n))
        found.append(hits[first])
        scores.append(near[first])
    return pa.table({"query_id": asks["query_id"].take(pa.array(np.concatenate(rows))), "key": keys.dictionary.take(pa.array(np.concatenate(found))), "score": np.concatenate(scores)})


class Search:
    """One batch of queries (query_id, text) against the collection at `path`; hits() is what it finds.

    asked: query_id, term, idf, segment, folder, block, n, bound: what each query's words may give in each block.
    first, second: query_id, segment, block that are read for certain, and those that the first ones' scores leave."""

    def __init__(self, spark: SparkSession, path: str, queries: DataFrame, limit: int, k1: float = 1.2, b: float = 0.75):
        self.path, self.limit, self.k1, self.b, self.types = path, limit, k1, b, queries.schema["query_id"].dataType.simpleString()
        live = segments(spark, path).agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.collect_set("folders").alias("folders")).first()
        self.postings = _postings(spark, path)
        terms = cut(queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term")))
        if self.postings is None:
            return
        self.mean = live["words"] / live["n"]
        # A word's folder is told from the word, so that other folders are pruned while the query runs.
        self.words = cut(terms.select("term").distinct().withColumn("folders", F.explode(F.array(*map(F.lit, live["folders"])))).withColumn("folder", _folder(F.col("term"), F.col("folders"))))
        bounds = self.postings.select("segment", "folders", "folder", "term", "block", "n", "most", "least")
        found = bounds.join(_small(self.words, 1_000_000), ["folders", "folder", "term"])
        found = cut(found)  # rows of words that some query has, without postings
        df = found.groupBy("term").agg(F.sum("n").alias("df"))
        self.rated = cut(terms.join(df, "term").select("query_id", "term", idf(F.lit(float(live["n"])), F.col("df")).alias("idf")))
        every = _small(self.rated, 200_000).join(found, "term")
        self.asked = every.withColumn("bound", F.col("idf") * weight(F.col("most"), F.col("least"), F.lit(self.mean), k1, b))
        # A block's bound, and how many of its documents are hits at least.
        blocks = cut(self.asked.groupBy("query_id", "segment", "block").agg(F.sum("bound").alias("bound"), F.max("n").alias("n")))
        w = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "block")
        before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranked = cut(blocks.withColumn("before", before))
        self.first = ranked.where(F.col("before") < limit)
        self.scored = cut(self._best(self._scores(self.first)))
        least = self.scored.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("hits")).where(F.col("hits") >= limit)
        rest = ranked.where(F.col("before") >= limit).join(least, "query_id", "left")
        self.second = rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - SLACK))

    def _scores(self, blocks: DataFrame) -> DataFrame:
        """query_id, key, score of the best `limit` documents of each block for each query that reads it.

        A block's postings meet in one task, once for all queries; pairs of a query and a document never leave it."""
        limit, mean, k1, b = self.limit, self.mean, self.k1, self.b
        read = blocks.select("query_id", "segment", "block")
        some = read.select("segment", "block").distinct()
        # Folders without a word of any query are pruned while the query runs.
        met = self.postings.select("segment", "folders", "folder", "term", "block", "docs").join(_small(self.words, 1_000_000), ["folders", "folder", "term"])
        met = met.join(_small(some, 500_000), ["segment", "block"], "left_semi").select("segment", "block", "term", "docs")
        asks = self.rated.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("terms"))
        asks = read.join(_small(asks, 100_000), "query_id").select("segment", "block", "query_id", "terms")
        key = self.postings.schema["docs"].dataType.elementType["key"].dataType.simpleString()

        def score(post: pa.Table, asks: pa.Table) -> pa.Table:
            return _best_of_block(post["term"].to_pylist(), post["docs"].combine_chunks(), asks, limit, mean, k1, b)

        out = f"query_id {self.types}, key {key}, score double"
        return met.groupBy("segment", "block").cogroup(asks.groupBy("segment", "block")).applyInArrow(score, out)

    def _best(self, scores: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
        return scores.withColumn("position", F.row_number().over(w)).where(F.col("position") <= self.limit)

    def hits(self, spark: SparkSession) -> DataFrame:
        if self.postings is None:
            keys = _keys(spark, self.path)
            return spark.createDataFrame([], f"query_id {self.types}, key {keys.schema['key'].dataType.simpleString() if keys is not None else 'string'}, score double, position int")
        more = self._scores(self.second)
        return self._best(self.scored.drop("position").unionByName(more))


def _small(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast if it has few enough rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def search(spark: SparkSession, path: str, queries: DataFrame, *, limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, key, score, position: the best documents for each query (query_id, text), as bm25() scores them: all of the collection's documents count,
    blocks that can't reach the first `limit` aren't read. Equal scores go by key."""
    return Search(spark, path, queries, limit, k1, b).hits(spark)
