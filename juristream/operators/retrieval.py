"""Ranked retrieval: exact, lexical, vector and neighbourhood rankings, fused by reciprocal rank.

A ranking is a table (query_id, key, position, ...). Queries are tables too, so a batch of queries is one job: lexical
scoring joins the queries' terms with postings on the term, vectors are scored against a stated query set in blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juristream.functions import dialogue as D
from juristream.functions import text as T
from juristream.operators import vectorlists
from juristream.operators.lineage import cut

# The order of sources, the constant of the fusion, and the scores of exact hits.
SOURCES = ("exact", "lexical", "vector", "graph")
RRF_K = 60
EXACT = {"provision": 1.0, "lineage": 0.99, "document": 0.95}
#: Sources by profile; profiles that end in _rerank are reordered by token overlap.
PROFILES = {
    "lexical": ("exact", "lexical"),
    "vector": ("exact", "vector"),
    "hybrid": ("exact", "lexical", "vector"),
    "hybrid_graph": SOURCES,
    "hybrid_graph_rerank": SOURCES,
}


def pool_size(limit: int, prefetch: int | None = None) -> int:
    return min(100, max(limit, prefetch or max(16, 4 * limit)))


def ranked(scored: DataFrame, partition: Sequence[str], order: Sequence[Column], limit: int) -> DataFrame:
    """The first `limit` rows of each partition with their position from 1."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return scored.withColumn("position", F.row_number().over(w)).where(F.col("position") <= limit)


def _sent(few: DataFrame) -> DataFrame:
    """The side of a join that goes to the other one: as a broadcast where it has few enough rows, else both are sorted. The other side is never sent, however
    small the files are that it is derived from."""
    return F.broadcast(few) if bounded(few, 100_000) else few.hint("merge")


def exact(provisions: DataFrame, identifiers: DataFrame) -> DataFrame:
    """identifiers (query_id, identifier) that name a version, a lineage or (in any case) a document: query_id, provision_id, lineage_id, score."""
    rows = provisions.select("provision_id", "lineage_id", "logical_vb_id")
    names = rows.select("provision_id", "lineage_id", F.explode(F.array(*[F.struct(k.alias("identifier"), F.lit(v).alias("score")) for k, v in ((F.col("provision_id"), EXACT["provision"]), (F.col("lineage_id"), EXACT["lineage"]), (F.upper("logical_vb_id"), EXACT["document"]))])).alias("n"))
    asked = identifiers.select("query_id", F.explode(F.array_distinct(F.array("identifier", F.upper("identifier")))).alias("identifier"))
    found = names.select("provision_id", "lineage_id", "n.*").join(_sent(asked), "identifier")
    return found.groupBy("query_id", "provision_id", "lineage_id").agg(F.max("score").alias("score"))


def postings(sized: DataFrame) -> DataFrame:
    """key, length, term, tf of documents (key, length, words): words are counted inside one document, so only distinct ones are shuffled."""
    return sized.select("key", "length", F.explode("words").alias("term")).groupBy("key", "length", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, *, key: str, text: str, limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, key, score, position: the best documents for each query (query_id, text).

    Only postings of words that some query has are kept before anything is grouped. Score: sum over the query's distinct
    words of idf * tf (k1 + 1) / (tf + k1 (1 - b + b length / mean length)), idf = ln(1 + (n - df + 0.5) / (df + 0.5)).
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    # Every text is cut into words once; lengths and the queries' own words of it are written, and all else comes from there.
    vocabulary = asked.select("term").distinct()
    words = T.tokens(F.col(text))
    small = bounded(vocabulary)
    if small:
        terms = [r["term"] for r in vocabulary.collect()]  # 10,000 at most
        kept = F.filter(F.col("_w"), lambda w: w.isin(terms)) if terms else F.array().cast("array<string>")
    else:
        kept = F.col("_w")
    sized = cut(docs.select(F.col(key).alias("key"), words.alias("_w")).select("key", F.size("_w").alias("length"), kept.alias("words")))
    size = sized.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    n, mean = F.lit(float(size["n"])), F.lit(float(size["mean"] or 1.0))
    few = postings(sized)
    if not small:
        few = few.join(vocabulary, "term", "left_semi")
    df = few.groupBy("term").agg(F.count("*").alias("df"))
    near = F.broadcast if small else (lambda d: d)  # a term's postings are then never gathered, however many they are
    scored = few.join(near(df), "term").join(F.broadcast(asked) if small and bounded(asked, 200_000) else asked, "term")
    tf = F.col("tf")
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / mean))
    total = scored.groupBy("query_id", "key").agg(F.sum(part).alias("score"))
    # Sums of doubles depend on their order: equal scores are equal to nine digits.
    total = total.withColumn("score", F.round("score", 9))
    return ranked(total, ["query_id"], [F.desc("score"), F.col("key")], limit)


def bounded(df: DataFrame, most: int = 10_000) -> bool:
    """Whether a table has few enough rows to be broadcast; looks at no more than that many."""
    return df.limit(most + 1).count() <= most


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null where a vector is zero, empty or of another length."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, e: s + e)
    dot = total(F.zip_with(x, y, lambda p, q: p * q))
    norm = F.sqrt(total(F.transform(x, lambda p: p * p))) * F.sqrt(total(F.transform(y, lambda q: q * q)))
    return F.when((F.size(x) == F.size(y)) & (norm > 0), dot / norm)


def vector_top_k(points: DataFrame, queries: DataFrame, *, key: str, vector: str, limit: int, same: str | None = None, query_rows: int = 4096, point_rows: int = 8192) -> DataFrame:
    """query_id, key, score, position: each query's (query_id, vector) nearest points by cosine, among all of them; among those that agree in the column
    `same`, if it is named (nulls agree with none).

    Points lie in lists around centres; a query meets those lists that may hold a hit, in blocks of bounded size (vectorlists).
    """
    none = F.lit(None).cast("string")
    asked = queries.select("query_id", F.col("vector").alias("_q"), (F.col(same).cast("string") if same else none).alias("same"))
    every = points.select(F.col(key).alias("key"), F.col(vector).alias("_v"), (F.col(same).cast("string") if same else none).alias("same"))
    if same:
        asked, every = asked.where("same IS NOT NULL"), every.where("same IS NOT NULL")
    return ranked(_scored(every, asked, limit, query_rows, point_rows), ["query_id"], [F.desc("score"), F.col("key")], limit)


def _scored(points: DataFrame, queries: DataFrame, limit: int, query_rows: int, point_rows: int) -> DataFrame:
    """query_id, key, score: of each list and block the best `limit` points for each query row, scored as cosine() does."""

    def whole(df: DataFrame, v: str) -> DataFrame:
        df = df.withColumn("vector", F.col(v).cast("array<double>")).drop(v)
        return df.where((F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull())).withColumn("dims", F.size("vector"))

    p, q = whole(points, "_v"), whole(queries, "_q")
    compare = lambda a, b, by: _scored_in_blocks(b, a, by, limit)
    found = vectorlists.search(p, q, limit, compare, query_rows=query_rows, point_rows=point_rows)
    if found is not None:
        return found
    # Too many values of the filter for lists: rows of one value meet, in blocks of hashes.
    q_blocks, p_blocks = -(-q.count() // query_rows) or 1, -(-p.count() // point_rows) or 1
    deal = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    copies = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    q = q.select("query_id", "vector", "dims", "same", deal("query_id", q_blocks).alias("qb"), copies(p_blocks).alias("pb"))
    p = p.select("key", "vector", "dims", "same", copies(q_blocks).alias("qb"), deal("key", p_blocks).alias("pb"))
    return _scored_in_blocks(p, q, ["dims", "same", "qb", "pb"], limit)


def _scored_in_blocks(points: DataFrame, queries: DataFrame, by: list[str], limit: int) -> DataFrame:
    """query_id, key, score of queries and points (vector, and the columns `by`, in which they agree)."""
    types = {c: df.schema[c].dataType for df, c in ((points, "key"), (queries, "query_id"))}
    none = lambda c: F.lit(None).cast(types[c]).alias(c)
    left = queries.select("query_id", none("key"), "vector", F.lit(True).alias("asks"), *by)
    right = points.select(none("query_id"), "key", "vector", F.lit(False).alias("asks"), *by)

    def in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Sums of products over the last axis from first to last, as cosine() adds them."""
        total = np.zeros(np.broadcast_shapes(x.shape, y.shape)[:-1])
        for i in range(x.shape[-1]):
            total = total + x[..., i] * y[..., i]
        return total

    def block(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        asks = t["asks"].to_numpy(zero_copy_only=False)
        x = t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
        own, other = np.flatnonzero(asks), np.flatnonzero(~asks)
        # Points in the order of their keys, so that of equal scores the first come first.
        other = other[pc.sort_indices(t["key"].take(pa.array(other)), null_placement="at_start").to_numpy()]
        v, rows, found, scores = x[other], [own[:0]], [other[:0]], [np.empty(0)]
        with np.errstate(all="ignore"):
            norms = np.sqrt(in_order(x, x))
            for at in range(0, len(own) if len(other) else 0, 128):
                some = own[at : at + 128]
                norm = norms[some][:, None] * norms[other][None, :]
                near = x[some] @ v.T / norm
                rough = np.isfinite(near[norm != 0]).all()
                if not rough:
                    near = in_order(x[some][:, None, :], v[None, :, :]) / norm
                # As Spark orders them: not-a-number is the largest. Pairs without a norm have no score.
                near = np.where(norm == 0, -np.inf, np.where(np.isnan(near), np.inf, near))
                least = np.partition(near, -limit, axis=1)[:, -limit] if limit < len(other) else np.full(len(some), -np.inf)
                for n, i in enumerate(some):
                    c = np.flatnonzero((near[n] >= least[n] - 1e-9) & (norm[n] != 0))
                    score = in_order(x[i], v[c]) / norm[n, c]
                    c_best = np.argsort(-np.where(np.isnan(score), np.inf, score), kind="stable")[:limit]
                    rows.append(np.full(len(c_best), i))
                    found.append(other[c[c_best]])
                    scores.append(score[c_best])
        return pa.table({"query_id": t["query_id"].take(pa.array(np.concatenate(rows))), "key": t["key"].take(pa.array(np.concatenate(found))), "score": pa.array(np.concatenate(scores))})

    out = f"query_id {types['query_id'].simpleString()}, key {types['key'].simpleString()}, score double"
    return left.unionByName(right).groupBy(*by).applyInArrow(block, out)


def bad_vectors(points: DataFrame, vector: str, dims: int) -> DataFrame:
    """Points whose vector is null, of another size, or holds what is no finite number."""
    v = F.col(vector)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return points.where(v.isNull() | (F.size(v) != dims) | F.coalesce(odd, F.lit(False)))


def upsert_vectors(old: DataFrame, new: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """old with new points written over it, by key; raises before anything is merged if a vector of the new ones doesn't fit the collection."""
    from juristream.operators.snapshots import upsert

    bad = bad_vectors(new, vector, dims).select(key).limit(5).collect()
    if bad:
        raise ValueError(f"vectors of other size than {dims}, or not finite: {[r[key] for r in bad]}")
    return upsert(old, new, [key])


def centroids(points: DataFrame, label: str, vector: str) -> DataFrame:
    """label, vector: means by component, combined before the shuffle."""
    parts = points.select(F.col(label).alias("label"), F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg("x").alias("x"))
    return means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("vector"))


def nearest_topic(points: DataFrame, topics: DataFrame, *, key: str, vector: str, threshold: float = 0.55) -> DataFrame:
    """key, topic, score, status of the nearest topic (label, vector; few rows): classified, needs_review, or unknown without any.

    Up to 10,000 topics go to the points, as one array, and nothing is shuffled; more are searched in blocks. Ties go to the smaller label.
    """
    if not bounded(topics):
        near = vector_top_k(topics, points.select(F.col(key).alias("query_id"), F.col(vector).alias("vector")), key="label", vector="vector", limit=1)
        best = near.select(F.col("query_id").alias(key), F.col("key").alias("topic"), "score")
        status = F.when(F.col("score").isNull(), "unknown").when(F.col("score") >= threshold, "classified").otherwise("needs_review")
        return points.select(key).join(best, key, "left").withColumn("status", status)
    every = topics.agg(F.collect_list(F.struct("label", "vector")).alias("_topics"))  # 10,000 at most
    scored = points.select(key, F.col(vector).alias("_v")).join(F.broadcast(every))
    found = F.transform("_topics", lambda t: F.struct(cosine(F.col("_v"), t["vector"]).alias("score"), t["label"].alias("topic")))
    best = F.array_sort(F.filter(found, lambda x: x["score"].isNotNull()), lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["topic"] < b["topic"], -1).otherwise(1))
    one = scored.select(key, F.try_element_at(best, F.lit(1)).alias("_b"))
    score = F.col("_b.score")
    status = F.when(score.isNull(), "unknown").when(score >= threshold, "classified").otherwise("needs_review")
    return one.select(key, F.col("_b.topic").alias("topic"), score.alias("score"), status.alias("status"))


def link_entities(points: DataFrame, targets: DataFrame, *, threshold: float = 0.55, limit: int = 5) -> DataFrame:
    """query_id, key, score, position: nearest targets (key, vector, topic) of the point's topic, or of all if that topic has none."""
    same = points.join(targets.select("topic").distinct(), "topic", "left_semi")
    rest = points.join(targets.select("topic").distinct(), "topic", "left_anti")
    local = vector_top_k(targets, same.select("query_id", "vector", "topic"), key="key", vector="vector", limit=limit, same="topic")
    wide = vector_top_k(targets, rest.select("query_id", "vector"), key="key", vector="vector", limit=limit)
    return local.unionByName(wide.select(local.columns)).where(F.col("score") >= threshold)


def fuse(rankings: Mapping[str, DataFrame], *, k: int = RRF_K, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Weighted reciprocal-rank fusion of rankings (query_id, provision_id, lineage_id, position) by lineage.

    A source counts a lineage once, at its first position; positions count skipped repeats. Sources without weight, or without a row
    for a query, don't enter that query's maximum. An exact hit names the version; else the earliest source does.
    Returns query_id, lineage_id, provision_id, raw, score, exact_match, position.
    """
    weights = {s: max(0.0, float((weights or {}).get(s, 1.0))) for s in rankings}
    used = [s for s in SOURCES if s in rankings and weights[s] > 0] + [s for s in rankings if s not in SOURCES and weights[s] > 0]
    rows = None
    for n, s in enumerate(used):
        one = rankings[s].where("provision_id IS NOT NULL AND lineage_id IS NOT NULL").groupBy("query_id", "lineage_id").agg(F.min(F.struct("position", "provision_id")).alias("first"))
        one = one.select("query_id", "lineage_id", "first.*", F.lit(n).alias("source"), F.lit(s == "exact").alias("exact"), (F.lit(weights[s]) / (k + F.col("first.position"))).alias("part"))
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        raise ValueError("no source with a weight")
    most = {n: weights[s] / (k + 1) for n, s in enumerate(used)}
    share = F.element_at(F.create_map(*[F.lit(x) for n, v in most.items() for x in (n, v)]), F.col("source"))
    maxima = rows.select("query_id", "source").distinct().groupBy("query_id").agg(F.sum(share).alias("most"))
    fused = rows.groupBy("query_id", "lineage_id").agg(F.sum("part").alias("raw"), F.bool_or("exact").alias("exact_match"), F.min(F.struct(~F.col("exact"), "source", "position", "provision_id")).alias("by"))
    out = fused.join(maxima, "query_id").select("query_id", "lineage_id", F.col("by.provision_id").alias("provision_id"), F.round("raw", 12).alias("raw"), F.round(F.least(F.lit(1.0), F.col("raw") / F.col("most")), 9).alias("score"), "exact_match")
    w = Window.partitionBy("query_id").orderBy(F.desc("exact_match"), F.desc("raw"), "lineage_id")
    return out.withColumn("position", F.row_number().over(w))


def overlap(query: Column, passage: Column, stop: Sequence[str] = ()) -> Column:
    """The share of a query's distinct words (two letters or more, no stop words) that a passage has; 0 without words."""
    words = lambda t: F.array_distinct(F.filter(T.tokens(t), lambda x: (F.length(x) >= 2) & ~x.isin(list(stop))))
    q = words(query)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.size(F.array_intersect(q, words(passage))) / F.size(q)))


def retrieve(queries: DataFrame, provisions: DataFrame, *, vectors: DataFrame | None = None, edges: DataFrame | None = None, profile: str = "hybrid", limit: int = 8, weights: Mapping[str, float] | None = None) -> DataFrame:
    """Fused hits for queries (query_id, text and, for vector profiles, vector) over provisions in force.

    vectors: provision_id, vector. edges: src, dst over lineages. A query that names an identifier is answered by exact hits alone.
    """
    pool = pool_size(limit)
    lineage = provisions.select("provision_id", "lineage_id")
    named = queries.select("query_id", F.explode(F.concat(T.legal_identifiers(F.col("text")), T.document_numbers(F.col("text")))).alias("identifier"))
    hits = ranked(exact(provisions, named), ["query_id"], [F.desc("score"), F.col("lineage_id"), F.col("provision_id")], pool)
    strict = queries.where(F.size(T.legal_identifiers(F.col("text"))) > 0).select("query_id")
    free = queries.join(strict, "query_id", "left_anti")
    found = {"exact": hits.select("query_id", "provision_id", "lineage_id", "position")}
    wanted = PROFILES[profile]
    if "lexical" in wanted:
        lexical = bm25(provisions, free, key="provision_id", text="text", limit=pool)
        found["lexical"] = lexical.withColumnRenamed("key", "provision_id").join(lineage, "provision_id").select("query_id", "provision_id", "lineage_id", "position")
    if "vector" in wanted and vectors is not None:
        near = vector_top_k(vectors.join(lineage, "provision_id", "left_semi"), free, key="provision_id", vector="vector", limit=pool)
        found["vector"] = near.withColumnRenamed("key", "provision_id").join(lineage, "provision_id").select("query_id", "provision_id", "lineage_id", "position")
    if "graph" in wanted and edges is not None:
        found["graph"] = neighbours(found, edges, lineage, pool)
    fused = fuse(found, weights=weights).where(F.col("position") <= pool)
    if profile.endswith("_rerank"):
        texts = provisions.select("provision_id", F.concat_ws(" ", "logical_vb_id", "lineage_id", "text").alias("_passage"))
        both = fused.join(texts, "provision_id").join(queries.select("query_id", F.col("text").alias("_query")), "query_id")
        both = both.withColumn("rerank", overlap(F.col("_query"), F.col("_passage")))
        w = Window.partitionBy("query_id").orderBy(F.desc("exact_match"), F.desc("rerank"), F.desc("score"), "lineage_id")
        fused = both.withColumn("position", F.row_number().over(w)).drop("_query", "_passage")
    return fused.where(F.col("position") <= limit)


def neighbours(found: Mapping[str, DataFrame], edges: DataFrame, lineage: DataFrame, pool: int) -> DataFrame:
    """Lineages within two hops of what other sources found, by query, ranked by distance, lineage and version."""
    from juristream.operators.graph import undirected

    seeds = None
    for ranking in found.values():
        one = ranking.select("query_id", F.col("lineage_id").alias("node"))
        seeds = one if seeds is None else seeds.union(one)
    seen = seeds.distinct().withColumn("distance", F.lit(0))
    both = undirected(edges)
    for _ in range(2):
        step = seen.join(both, seen["node"] == both["src"]).select("query_id", F.col("dst").alias("node"), (F.col("distance") + 1).alias("distance"))
        seen = seen.union(step).groupBy("query_id", "node").agg(F.min("distance").alias("distance"))
    near = seen.where("distance > 0").join(lineage, seen["node"] == lineage["lineage_id"])
    return ranked(near.select("query_id", "provision_id", "lineage_id", "distance"), ["query_id"], [F.col("distance"), F.col("lineage_id"), F.col("provision_id")], pool).drop("distance")


def keyword_hits(text: Column, keywords: Sequence[str], required: Sequence[str] = ()) -> Column:
    """How many keywords occur, required ones counting twice more."""
    body = F.lower(F.coalesce(text, F.lit("")))
    one = lambda w: F.contains(body, F.lit(w.lower())).cast("int")
    return sum((one(w) for w in keywords), F.lit(0)) + 2 * sum((one(w) for w in required), F.lit(0))


def prefer_best_document(hits: DataFrame, *, margin: float = 2.0, most: int = 8) -> DataFrame:
    """Hits (query_id, document, score, required_hits, exact, position) of the best document alone if it leads by the margin, else all; at most `most`."""
    first = F.slice(F.reverse(F.array_sort(F.collect_list("score"))), 1, 8)
    per = hits.groupBy("query_id", "document").agg((5 * F.max("required_hits") + 3 * F.max(F.col("exact").cast("int")) + F.aggregate(first, F.lit(0.0), lambda s, x: s + x)).alias("value"), F.min("position").alias("at"))
    w = Window.partitionBy("query_id").orderBy(F.desc("value"), "at")
    top = per.withColumn("n", F.row_number().over(w)).withColumn("second", F.lead("value").over(w)).where("n = 1")
    chosen = top.select("query_id", F.when(F.col("second").isNull() | (F.col("value") - F.col("second") >= margin), F.col("document")).alias("only"))
    kept = hits.join(chosen, "query_id").where(F.col("only").isNull() | (F.col("document") == F.col("only"))).drop("only", "position_in")
    return ranked(kept.withColumnRenamed("position", "_p"), ["query_id"], [F.col("_p")], most).drop("_p")


def jaccard_link(left: DataFrame, right: DataFrame, *, limit: int = 5) -> DataFrame:
    """Per left row (id, text) the right rows (id, text) of highest word Jaccard above 0: pairs meet at shared words and only counts of them are shuffled."""
    words = lambda d, n: d.select(F.col("id").alias(n), F.array_distinct(T.tokens(F.col("text"))).alias("w"))
    a, b = words(left, "left_id"), words(right, "right_id")
    a, b = (d.select(n, F.size("w").alias(f"{n}_n"), F.explode("w").alias("term")) for d, n in ((a, "left_id"), (b, "right_id")))
    shared = a.join(b, "term").groupBy("left_id", "right_id", "left_id_n", "right_id_n").agg(F.count("*").alias("both"))
    scored = shared.select("left_id", "right_id", (F.col("both") / (F.col("left_id_n") + F.col("right_id_n") - F.col("both"))).alias("score"))
    return ranked(scored, ["left_id"], [F.desc("score"), F.col("right_id")], limit)


def reconcile_index(leaves: DataFrame, points: DataFrame) -> DataFrame:
    """provision_id, action of leaves (provision_id, text_checksum) against an index of the same columns: keep, index, reindex, delete."""
    a = leaves.select("provision_id", F.col("text_checksum").alias("want"))
    b = points.groupBy("provision_id").agg(F.max("text_checksum").alias("have"))
    action = F.when(F.col("want").isNull(), "delete").when(F.col("have").isNull(), "index").when(F.col("want") == F.col("have"), "keep").otherwise("reindex")
    return a.join(b, "provision_id", "full").select("provision_id", action.alias("action"))


# What a passage must reach to count as relevant, and how much a search score adds to it.
RELEVANT, SCORE_SHARE = 0.34, 0.1


def relevant(hits: DataFrame, queries: DataFrame, *, least: float = RELEVANT) -> DataFrame:
    """Hits (query_id, key, text, score) on their query's (query_id, text) topic, with relevance and value = relevance + SCORE_SHARE * score, by position.

    Queries that name a document, or have no topic words, keep all their hits in the order they had.
    """
    free = D.names_document(F.col("text")) | (F.size(D.required_terms(F.col("text"))) == 0)
    asked = queries.select("query_id", free.alias("_free"), D.question_profile(F.col("text")).alias("_profile"))
    both = hits.join(cut(asked), "query_id")  # a question is looked at once, not with each of its passages
    fit = D.profile_fit(F.col("_profile"), F.concat_ws(" ", F.col("key").cast("string"), "text"))
    scored = both.withColumn("relevance", F.when(~F.col("_free"), fit))
    kept = scored.where(F.col("_free") | (F.col("relevance") >= least)).withColumn("value", F.coalesce(F.col("relevance") + SCORE_SHARE * F.coalesce("score", F.lit(0.0)), F.col("score")))
    w = Window.partitionBy("query_id").orderBy(F.desc("value"), "key")
    return kept.withColumn("position", F.row_number().over(w)).select("query_id", "key", "text", "score", "relevance", "value", "position")


def select_context(hits: DataFrame, queries: DataFrame, *, least: float = RELEVANT, most: int = 3, most_named: int = 6) -> DataFrame:
    """What an answer is written from: query_id, document, key, text, position of hits (query_id, document, key, text, position) for queries (query_id, text).

    A query that names a document gets `most_named` hits, those whose key has its number if there are any. Others get `most` hits on their topic; where that
    leaves more, of the one document that fits best as a whole, by relevance and then by its number of hits. Small talk gets none.
    """
    asked_text = F.col("text")
    asked = queries.where(~D.small_talk(asked_text)).select("query_id", D.names_document(asked_text).alias("_named"), F.transform(T.document_numbers(asked_text), T.plain_lower).alias("_numbers"), D.question_profile(asked_text).alias("_profile"))
    # Questions go to the passages, which stay where they are.
    rows = hits.join(_sent(cut(asked)), "query_id")
    own = Window.partitionBy("query_id")

    named = rows.where("_named").withColumn("_hit", F.exists("_numbers", lambda n: F.contains(T.plain_lower(F.col("key")), n)))
    named = named.join(_sent(cut(named.groupBy("query_id").agg(F.bool_or("_hit").alias("_any")))), "query_id").where(F.col("_hit") | ~F.col("_any"))
    named = named.withColumn("_at", F.row_number().over(own.orderBy("position", "key"))).where(F.col("_at") <= most_named)

    fit = D.profile_fit(F.col("_profile"), F.concat_ws(" ", "key", "text"))
    free = rows.where(~F.col("_named")).withColumn("_fit", F.when(F.size("_profile.terms") > 0, fit)).where(F.col("_fit").isNull() | (F.col("_fit") >= least))
    # By fit, position and key; no query's passages are numbered in one task.
    free = cut(free.withColumn("_at", F.struct((-F.col("_fit")).alias("fit"), "position", "key")))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "text"))), lambda x: x["text"]), " ")
    whole = free.groupBy("query_id", "document").agg(texts.alias("_texts"), F.any_value("_profile").alias("_profile"), F.count("*").alias("_items"), F.min("_at").alias("_first"))
    whole = whole.withColumn("_whole", D.profile_fit(F.col("_profile"), F.concat_ws(" ", "document", "_texts")))
    best = whole.withColumn("_n", F.row_number().over(own.orderBy(F.desc("_whole"), F.desc("_items"), "_first"))).withColumn("_all", F.sum("_items").over(own)).where("_n = 1")
    one = F.when((F.col("_all") > most) & (F.col("_whole") > 0), F.col("document"))
    kept = free.join(_sent(cut(best.select("query_id", one.alias("_one")))), "query_id").where(F.col("_one").isNull() | (F.col("document") == F.col("_one")))
    kept = kept.withColumn("_at", F.row_number().over(own.orderBy("_at"))).where(F.col("_at") <= most)
    out = ["query_id", "document", "key", "text", F.col("_at").alias("position")]
    return named.select(*out).unionByName(kept.select(*out))


# Scores of keyword hits where vectors gave none, and how many of either are taken.
KEYWORD_BASE, KEYWORD_STEP, KEYWORD_MOST = 0.75, 0.03, 0.99
VECTOR_POOL, KEYWORD_POOL = 16, 40


def keyword_search(queries: DataFrame, passages: DataFrame, limit: int = KEYWORD_POOL) -> DataFrame:
    """query_id, key, hits, score of passages (key, text) that hold a keyword of the query and, if it has any, a required term; required ones count twice more.

    Pairs meet at a word of a keyword, so no query is held against every passage.
    """
    body = F.lower(F.coalesce("text", F.lit("")))
    asked = cut(queries.select("query_id", F.transform(D.keyword_queries(F.col("text")), F.lower).alias("_k"), F.transform(D.required_terms(F.col("text")), F.lower).alias("_r")))
    by_word = asked.select("query_id", F.explode(F.array_distinct(F.flatten(F.transform("_k", lambda k: T.tokens(k))))).alias("term"))
    words = passages.select("key", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    met = words.join(F.broadcast(by_word) if bounded(by_word, 100_000) else by_word, "term").select("query_id", "key").distinct()
    both = met.join(passages.select("key", body.alias("_b")).hint("merge"), "key").join(_sent(asked), "query_id")
    count = lambda terms: F.size(F.filter(terms, lambda t: F.contains(F.col("_b"), t)))
    hits = both.withColumn("_required", count(F.col("_r"))).withColumn("_found", count(F.col("_k"))).where("_found > 0 AND (size(_r) = 0 OR _required > 0)")
    scored = hits.select("query_id", "key", (F.col("_found") + 2 * F.col("_required")).alias("hits"))
    score = F.least(F.lit(KEYWORD_MOST), KEYWORD_BASE + KEYWORD_STEP * F.col("hits"))
    return ranked(scored.withColumn("score", score), ["query_id"], [F.desc("hits"), F.col("key")], limit).drop("position")


def stepwise(queries: DataFrame, provisions: DataFrame, vectors: DataFrame | None = None, *, limit: int = 8) -> DataFrame:
    """query_id, key, document, text, score, position in steps: what a query names by id or number, alone; else its nearest vectors; else keywords, also where a
    number that is named isn't known. Unreadable passages go, then other documents than a clearly best one, then what is off the topic.

    queries: query_id, text, vector (if vectors are given). provisions: provision_id, lineage_id, logical_vb_id, text. vectors: provision_id, vector.
    """
    ids, numbers = T.legal_identifiers(F.col("text")), T.document_numbers(F.regexp_replace("text", r"\S+::D\S+", " "))  # an id's own number names no document besides
    named = queries.select("query_id", F.explode(F.concat(ids, F.transform(numbers, T.document_number))).alias("identifier"))
    direct = exact(provisions, named).select("query_id", F.col("provision_id").alias("key"), "score").where("key IS NOT NULL")
    direct = cut(ranked(direct, ["query_id"], [F.desc("score"), F.col("key")], limit).drop("position"))
    rest = queries.join(direct.select("query_id").distinct(), "query_id", "left_anti").where((F.size(ids) == 0) | (F.size(numbers) > 0))
    body = provisions.select(F.col("provision_id").alias("key"), F.col("logical_vb_id").alias("document"), "text")
    found = None
    if vectors is not None:
        near = vector_top_k(vectors, rest.select("query_id", "vector"), key="provision_id", vector="vector", limit=VECTOR_POOL)
        found = body.join(_sent(near.select("query_id", "key", "score")), "key").where(T.readable(F.col("text"))).select("query_id", "key", "score")
    unmet = rest if found is None else rest.where(F.size(numbers) > 0).unionByName(rest.where(F.size(numbers) == 0).join(found.select("query_id").distinct(), "query_id", "left_anti"))
    words = keyword_search(unmet.select("query_id", "text"), body).select("query_id", "key", "score")
    every = words if found is None else found.unionByName(words)
    once = cut(every.groupBy("query_id", "key").agg(F.max("score").alias("score")))
    readable = body.join(_sent(once), "key").where(T.readable(F.col("text")))
    fit = relevant(readable.select("query_id", "key", "text", "score"), rest.select("query_id", "text"))
    later = fit.select("query_id", "key", F.col("value").alias("score"))
    out = body.join(_sent(cut(direct.unionByName(later))), "key")
    return ranked(out, ["query_id"], [F.desc("score"), F.col("key")], limit).select("query_id", "key", "document", "text", "score", "position")
