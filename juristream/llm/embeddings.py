"""Operator 1: embedding near-dedup by sorted projection passes.

A pass gives each vector a key of concatenated random hashes: bit after bit, on which side of a cut along a random
direction it lies. Vectors are put in the order of their keys, range by range, and each is compared with the `window`
vectors behind it; verified pairs of all passes are united to components.

The cuts are drawn from the data: a bit cuts at the median of a sample's vectors with the same bits before (deep bits at
the mean of the sample's vectors in the same leaf), so a dense topic is cut through its own middle and not past it.
Window and number of passes are measured, not assumed: partners at exactly the threshold are made for a sample of rows, and
passes are added until, in each region of the data, the share of them that came within a window once is the recall asked
for. Of all windows the cheapest is taken.

Links are then counted whole: a vector's links all lie in its component. In a large component, angles to the
centre settle most of them (triangle inequality) as sums; what they leave open is compared in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from juristream.llm.common import finished, materialise, scope, tidy
from juristream.llm.components import connected_components, local_roots

#: What a row's part in a pass costs besides, in comparisons of two rows.
SENDING = 2000
#: Made partners for measuring: so many sample rows with so many partners each, in up to 2 ** REGIONS regions.
PROBES, PARTNERS, REGIONS = 2048, 4, 4
#: Windows to choose from, rows of a range of keys, and the most passes.
WINDOWS = (64, 128, 256, 512, 1024, 2048, 4096)
RANGE_ROWS, MOST_PASSES = 16_384, 512
#: Bits behind a leaf's that only order it, and random ones that part ties.
DEEP, TIES = 24, 20
#: Passes that are shuffled together: so many copies of the vectors exist at once.
TOGETHER = 4
#: Rings of the threshold's angle around a large component's centre.
RINGS = 32
#: Bytes of centres that are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def usable(vector: Column) -> Column:
    """Not null or empty, no component null or non-finite, not zero, and a square sum that is finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & ~bad & some, F.lit(False))


def unit(column: pa.Array) -> np.ndarray:
    """Rows of one length, scaled to norm 1 in double precision (first by the largest component: squares may overflow)."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Pass:
    """One order of unit vectors, its cuts fitted to a sample x."""

    def __init__(self, x: np.ndarray, depth: int, ranges: int, rng: np.random.Generator):
        self.depth = depth
        self.planes = rng.standard_normal((depth + DEEP, x.shape[1]))
        self.cuts: list[np.ndarray] = []
        along, node = x @ self.planes.T, np.zeros(len(x), np.int64)
        for level in range(depth):
            p = along[:, level]
            order = np.lexsort((p, node))
            starts = np.searchsorted(node[order], np.arange((1 << level) + 1))
            self.cuts.append(p[order][np.minimum((starts[:-1] + starts[1:]) // 2, len(x) - 1)])
            node = 2 * node + (p >= self.cuts[-1][node])
        sizes = np.bincount(node, minlength=1 << depth)
        self.cuts += [np.bincount(node, along[:, level], minlength=1 << depth) / np.maximum(sizes, 1) for level in range(depth, depth + DEEP)]
        self.share = sizes / len(x)
        self.start = np.cumsum(self.share) - self.share
        keys = np.sort(self.keys(x, rng.integers(0, 1 << TIES, len(x))))
        self.ends = keys[(np.arange(1, ranges) * len(x)) // ranges]

    def keys(self, x: np.ndarray, ties: np.ndarray) -> np.ndarray:
        along, node = x @ self.planes.T, np.zeros(len(x), np.int64)
        for level in range(self.depth):
            node = 2 * node + (along[:, level] >= self.cuts[level][node])
        key = node
        for level in range(self.depth, self.depth + DEEP):
            key = 2 * key + (along[:, level] >= self.cuts[level][node])
        return key << TIES | ties

    def ranges(self, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, keys, "right").astype(np.int32)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where in the order of all rows a key is to be expected, from 0 to 1."""
        leaf = keys >> (DEEP + TIES)
        return self.start[leaf] + self.share[leaf] * ((keys & ((1 << DEEP + TIES) - 1)) / float(1 << DEEP + TIES))


class Passes:
    """Passes over unit vectors of one length, as many and with such a window as the sample x of n rows shows to be needed."""

    def __init__(self, x: np.ndarray, n: int, threshold: float, recall: float, seed: int):
        self.passes: list[Pass] = []
        self.window, self.recall = WINDOWS[-1], 1.0
        if len(x) < 2:
            return
        rng = np.random.default_rng([seed, x.shape[1]])
        depth = min(13, max(0, int(math.log2(len(x) / 16))))
        at = rng.permutation(len(x))[:PROBES]
        near = self._partners(x, at, threshold, rng).reshape(-1, x.shape[1])
        found = {w: np.zeros((len(at), PARTNERS), bool) for w in WINDOWS}
        region, best, chosen = None, math.inf, None
        while len(self.passes) < MOST_PASSES:
            p = Pass(x, depth, -(-n // RANGE_ROWS), rng)
            self.passes.append(p)
            ties = rng.integers(0, 1 << TIES, len(at) * (1 + PARTNERS))
            own, other = p.keys(x[at], ties[: len(at)]), p.keys(near, ties[len(at) :]).reshape(len(at), PARTNERS)
            gap = np.abs(p.places(own)[:, None] - p.places(other)) * n
            meet = p.ranges(own)[:, None] == p.ranges(other)
            if region is None:
                _, region = np.unique(own >> (DEEP + TIES + max(0, depth - REGIONS)), return_inverse=True)
            k = len(self.passes)
            for w in WINDOWS:
                found[w] |= meet & (gap <= w)
                share = np.bincount(region, found[w].mean(axis=1)) / np.bincount(region)
                cost = k * (SENDING + min(w, n))
                if cost < best and share.min() >= recall:
                    best, chosen = cost, (k, w, float(share.min()))
            if all((k + 1) * (SENDING + min(w, n)) >= best for w in WINDOWS):
                break
        if chosen is None:
            raise ValueError(f"{len(self.passes)} passes of window {WINDOWS[-1]} find {share.min():.3f} of made partners among {n} rows, not {recall}: no links are returned rather than some")
        k, self.window, self.recall = chosen
        self.passes = self.passes[:k]

    @staticmethod
    def _partners(x: np.ndarray, at: np.ndarray, threshold: float, rng: np.random.Generator) -> np.ndarray:
        """Unit vectors at cosine `threshold` from each of x[at]: half in random directions, half towards other rows."""
        own = x[at][:, None, :]
        way = rng.standard_normal((len(at), PARTNERS, x.shape[1]))
        way[:, ::2] = x[rng.integers(0, len(x), (len(at), (PARTNERS + 1) // 2))] + 1e-6 * way[:, ::2]
        way -= (way * own).sum(axis=2, keepdims=True) * own
        way /= np.maximum(np.sqrt((way * way).sum(axis=2, keepdims=True)), 1e-300)
        return threshold * own + math.sqrt(max(0.0, 1 - threshold * threshold)) * way


def window_pairs(x: np.ndarray, v: np.ndarray, window: int, threshold: float, new: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order: a forest of the pairs at most `window` places apart with cosine >= threshold, the later of which is at `new` or behind."""
    a = b = v[:0]
    step = max(64, min(512, window))
    for at in range(0, len(x), step):
        skip = max(0, new - at)
        some, other = x[at : at + step], x[at + skip : at + step + window]
        p, q = np.nonzero(some @ other.T >= threshold)
        q += skip
        near = (q > p) & (q - p <= window)
        if near.any():
            a, b = local_roots(np.concatenate([a, v[at + p[near]]]), np.concatenate([b, v[at + q[near]]]))
    return a, b


def near_duplicates(
    embeddings: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = 0.95,
    recall: float = 0.995,
    block: int = 2048,
    seed: int = 11,
) -> DataFrame:
    """Components of the vectors under cosine >= threshold, whatever other columns say.

    Returns one row per input row: the id, n_links (other rows linked directly), component_id (smallest id reachable),
    kept (id = component_id).

    Rows whose vector is null, empty, zero, or holds null or non-finite components link with nothing: n_links 0, their
    own component. Vectors of different lengths don't link. Equal vectors are compared once, each counting as often
    as it occurs. Rows that repeat an id are vectors of their own, in one component's name if they are linked or not. A null
    id gets a null component, isn't kept and links with nothing. An empty table gives an empty one.
    """
    rows = embeddings.select(embeddings[id_col].cast("long").alias("id"), embeddings[vector_col].alias("vector"))
    rows = rows.withColumn("good", usable(F.col("vector")) & F.col("id").isNotNull())
    key = [F.when(F.col("good"), F.xxhash64(F.lit(i), F.size("vector"), "vector")).alias(f"k{i}") for i in (1, 2)]
    rows = rows.select("id", "vector", *key)  # 128 bits for a vector
    with scope():
        per_vector = finished(_per_vector(rows, threshold, recall, block, seed), "per-vector")
    # As in any graph on ids: rows that repeat an id share its component's number.
    return (
        rows.select("id", "k1", "k2")
        .join(per_vector, ["k1", "k2"], "left")
        .select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("smallest", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
    )


def _per_vector(rows: DataFrame, threshold: float, recall: float, block: int, seed: int) -> DataFrame:
    """k1, k2, links, smallest of every distinct vector."""
    # One vector stands for all equal ones: min and count combine before the shuffle, so a frequent vector is no hot key.
    distinct = rows.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("id").alias("rid"), F.count("*").alias("times"), F.any_value("vector").alias("vector"))
    # Repeated ids may make one id stand for two vectors: dense numbers are not needed, only distinct ones.
    distinct = materialise(distinct.withColumn("v", F.monotonically_increasing_id()), "vectors")

    edges = window_edges(distinct, threshold, recall, seed)
    groups = connected_components(edges)
    groups = materialise(groups.union(groups.select("component", "component")).distinct(), "groups")
    members = distinct.join(groups, distinct["v"] == groups["node"]).select("v", "component", "rid", "times", "vector")
    counts = count_links(members, groups, threshold, block)
    smallest = members.groupBy("component").agg(F.min("rid").alias("smallest"))
    grouped = groups.join(counts, groups["node"] == counts["v"]).select("v", "component", "links").join(smallest, "component").select("v", "links", "smallest")
    per_vector = distinct.select("v", "k1", "k2", "rid", "times").join(grouped, "v", "left")
    return per_vector.select("k1", "k2", F.coalesce("links", F.col("times") - 1).alias("links"), F.coalesce("smallest", "rid").alias("smallest"))


def plan_passes(distinct: DataFrame, threshold: float, recall: float, seed: int) -> dict[int, Passes]:
    """Passes for each length of vectors; the sample only sets cuts and numbers, every row goes through every pass."""
    plans = {}
    for d, n in distinct.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).collect():  # a row per length
        rows = min(n, 1 << 16, max(4 * PROBES, (1 << 22) // d))
        some = distinct.where((F.size("vector") == d) & (F.pmod(F.xxhash64("v"), F.lit(n)) < rows)).select("vector").toArrow()
        plans[d] = Passes(unit(some["vector"].combine_chunks()) if n > 1 else np.empty((0, d)), n, threshold, recall, seed)
    return plans


def _send(passes: dict[int, list[Pass]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for d in np.unique(sizes).tolist():
                at = pa.array(np.flatnonzero(sizes == d))
                v, vectors = batch.column(0).take(at), batch.column(1).take(at)
                x, number = unit(vectors), v.to_numpy().astype(np.uint64)
                for i, p in enumerate(passes[d]):
                    ties = (number * np.uint64(0x9E3779B97F4A7C15 + 2 * i) >> np.uint64(64 - TIES)).astype(np.int64)
                    keys = p.keys(x, ties)
                    same = [pa.array(np.full(len(x), c, np.int32)) for c in (d, i)]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(p.ranges(keys)), pa.array(keys), v, vectors], names=["dims", "pass", "range", "key", "v", "vector"])

    return run


def _compare(windows: dict[int, int], threshold: float):
    """Rows come sorted by (dims, pass, range, key), all of a range in one task: what is held of a range is its last window of rows, however long it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, x, v = None, np.empty((0, 0)), np.empty(0, np.int64)
        for batch in batches:
            by = np.stack([batch.column(i).to_numpy() for i in range(3)])
            cuts = np.flatnonzero((by[:, 1:] != by[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                if lo == hi:
                    continue
                part, now = batch.slice(lo, hi - lo), tuple(by[:, lo].tolist())
                more, ids = unit(part.column(4)), part.column(3).to_numpy()
                if now != group:
                    group, x, v = now, more[:0], ids[:0]
                held = len(x)
                x, v = np.concatenate([x, more]), np.concatenate([v, ids])
                window = windows[now[0]]
                a, b = window_pairs(x, v, window, threshold, held)
                x, v = x[-window:].copy(), v[-window:]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def window_edges(distinct: DataFrame, threshold: float, recall: float, seed: int) -> DataFrame:
    """Pairs v, w with cosine >= threshold within a window of some pass: of each range only a spanning forest of them."""
    plans = plan_passes(distinct, threshold, recall, seed)
    kind = distinct.schema["vector"].dataType.simpleString()
    most = max((len(p.passes) for p in plans.values()), default=0)
    edges = None
    for first in range(0, most, TOGETHER):
        some = {d: (p.window, p.passes[first : first + TOGETHER]) for d, p in plans.items()}
        groups = sum(len(p.ends) + 1 for _, passes in some.values() for p in passes)

        sent = distinct.select("v", "vector").mapInArrow(tidy(_send({d: passes for d, (_, passes) in some.items()})), f"dims int, pass int, range int, key long, v long, vector {kind}")
        by = ["dims", "pass", "range"]
        ordered = sent.repartition(max(2, groups), *by).sortWithinPartitions(*by, "key").select(*by, "v", "vector")
        found = materialise(ordered.mapInArrow(tidy(_compare({d: w for d, (w, _) in some.items()}, threshold)), "a long, b long"), "window-edges")
        edges = found if edges is None else edges.union(found)
    # An edge joins vectors of one component; that they are linked directly is only true of the path between them.
    return distinct.select(F.col("v").alias("a"), F.col("v").alias("b")).limit(0) if edges is None else edges


def block_links(x: np.ndarray, times: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Of each row, the links (weighed by times) between rows `left` and `right`; if these are the same, a row has one with itself."""
    links = np.zeros(len(x), np.int64)
    same = left is right
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        close = x[rows] @ x[right].T >= threshold
        links[rows] += close @ times[right]
        if not same:
            links[right] += close.T @ times[rows]
    return links


def count_links(members: DataFrame, groups: DataFrame, threshold: float, block: int) -> DataFrame:
    """v, links: how many other rows of v's component have cosine >= threshold with it."""
    sizes = groups.groupBy("component").agg(F.count("*").alias("rows")).where(F.col("rows") > block)
    large = materialise(sizes.select("component"), "large")
    n, rows = large.count(), groups.count()
    small = members
    if n:
        few = F.broadcast(large) if n <= 100_000 else large
        small = members.join(few, "component", "left_anti")
    packs = max(1, rows // (4 * block))

    def count(t: pa.Table) -> pa.Table:
        """Many small components at a time."""
        t = t.combine_chunks()
        v, times, group, vectors = t["v"].to_numpy(), t["times"].to_numpy(), t["component"].to_numpy(), t["vector"].combine_chunks()
        order = np.argsort(group, kind="stable")
        x, v, times, group = unit_any(vectors.take(pa.array(order))), v[order], times[order], group[order]
        ends = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, len(group))
        links, lo = np.zeros(len(v), np.int64), 0
        for hi in ends.tolist():
            own = x[lo] if hi - lo == 1 else np.stack(x[lo:hi])
            every = np.arange(hi - lo)
            links[lo:hi] = block_links(np.atleast_2d(own), times[lo:hi], every, every, threshold) - 1
            lo = hi
        return pa.table({"v": pa.array(v), "links": pa.array(links)})

    packed = small.select(F.pmod(F.xxhash64("component"), F.lit(packs)).alias("pack"), "component", "v", "times", "vector")
    counts = packed.groupBy("pack").applyInArrow(count, "v long, links long")
    return counts.unionByName(count_in_rings(members.join(few, "component", "left_semi"), n, threshold, block)) if n else counts


def unit_any(column: pa.Array) -> list[np.ndarray]:
    """Rows of any lengths, scaled to norm 1 (a component's are of one length)."""
    sizes = np.diff(column.offsets.to_numpy())
    out: list[np.ndarray] = [np.empty(0)] * len(column)
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        for i, x in zip(at.tolist(), unit(column.take(pa.array(at))), strict=True):
            out[i] = x
    return out


def count_in_rings(members: DataFrame, components: int, threshold: float, block: int) -> DataFrame:
    """count_links for large components: by the ring of a vector's angle to its component's centre.

    Two vectors whose angles to the centre add up to no more than the threshold's angle are linked, two whose angles differ by
    more aren't; so whole rings are settled by their sums. Pairs of rings that are neither are dealt into blocks and compared.
    """
    theta = math.acos(max(-1.0, min(1.0, threshold)))
    width, sure = theta / RINGS, 1e-7
    d = 8 * (members.select(F.max(F.size("vector"))).first()[0] or 0)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            group, x = batch.column(0).to_numpy(), unit_any(batch.column(1))
            for g, one in zip(group.tolist(), x, strict=True):
                found[g] = found[g] + one if g in found else one
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.float64()))], names=["component", "total"])

    def add(t: pa.Table) -> pa.Table:  # a row per task that met the component
        return pa.table({"component": t["component"][:1], "centre": pa.array([np.sum(np.stack(unit_free(t["total"])), axis=0)], pa.list_(pa.float64()))})

    centres = members.select("component", "vector").mapInArrow(sums, "component long, total array<double>").groupBy("component").applyInArrow(add, "component long, centre array<double>")
    centres = materialise(centres, "centres")
    near = F.broadcast(centres) if components * d <= BROADCAST_BYTES else centres

    def ring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, c = unit_any(batch.column(3)), unit_free(batch.column(4))
            angle = [math.acos(max(-1.0, min(1.0, float(a @ b) / (math.sqrt(float(b @ b)) or 1.0)))) for a, b in zip(x, c, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(np.floor(np.array(angle) / width), pa.int32(), safe=False)], names=["component", "v", "times", "vector", "ring"])

    kind = members.schema["vector"].dataType.simpleString()
    ringed = members.join(near, "component").select("component", "v", "times", "vector", "centre")
    ringed = materialise(ringed.mapInArrow(ring, f"component long, v long, times long, vector {kind}, ring int"), "rings")
    totals = materialise(ringed.groupBy("component", "ring").agg(F.sum("times").alias("total"), F.ceil(F.count("*") / block).cast("int").alias("parts")), "ring-sums")
    a, b = totals.alias("a"), totals.alias("b")
    pairs = a.join(b, "component").select("component", F.col("a.ring").alias("ring"), F.col("b.ring").alias("other"), F.col("b.total").alias("total"), F.col("b.parts").alias("other_parts"))
    linked = (F.col("ring") + F.col("other") + 2) * width <= theta - sure
    apart = (F.abs(F.col("ring") - F.col("other")) - 1) * width > theta + sure
    settled = pairs.where(linked).groupBy("component", "ring").agg(F.sum("total").alias("linked"))
    left_open = pairs.where(~linked & ~apart).groupBy("component", "ring").agg(F.collect_list(F.struct("other", "other_parts")).alias("others"))
    of_ring = totals.select("component", "ring", "parts").join(settled, ["component", "ring"], "left").join(left_open, ["component", "ring"], "left")
    of_ring = materialise(of_ring.withColumn("linked", F.coalesce("linked", F.lit(0))), "ring-plan")  # a few hundred rings a component
    rows = ringed.join(F.broadcast(of_ring) if components <= 1000 else of_ring, ["component", "ring"])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int"))
    base = rows.select("v", (F.col("linked") - 1).alias("links"))  # a row's link with itself is in what follows or in the sum

    own = F.struct("ring", "part")
    meets = F.flatten(F.transform("others", lambda o: F.transform(F.sequence(F.lit(0), o["other_parts"] - 1), lambda p: F.struct(o["other"].alias("ring"), p.alias("part")))))
    dealt = rows.where("others IS NOT NULL").select("component", own.alias("own"), F.explode(meets).alias("meets"), "v", "times", "vector")
    dealt = dealt.select("component", F.least("own", "meets").alias("lo"), F.greatest("own", "meets").alias("hi"), (F.col("own") <= F.col("meets")).alias("first"), "v", "times", "vector")

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        first, v, times = t["first"].to_numpy(zero_copy_only=False), t["v"].to_numpy(), t["times"].to_numpy()
        left, right = np.flatnonzero(first), np.flatnonzero(~first)
        if t["lo"][0].as_py() == t["hi"][0].as_py():
            right = left
        return pa.table({"v": pa.array(v), "links": pa.array(block_links(unit(t["vector"].combine_chunks()), times, left, right, threshold))})

    compared = dealt.groupBy("component", "lo", "hi").applyInArrow(compare, "v long, links long")
    return base.union(compared).groupBy("v").agg(F.sum("links").alias("links"))


def unit_free(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """Rows as double arrays, unscaled."""
    return [np.array(x.as_py(), np.float64) for x in column]
