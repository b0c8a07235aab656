"""Cycles of directed graphs: strongly connected components in rounds that grow with the logarithm of the depth.

Chains go first. A node with one edge in and one out passes its edges through; pointers along such nodes are doubled, so a path of n of them
becomes one edge after log2(n) rounds, and a ring of them is found to have no end. What branches is left. There each node learns the least node that it
leads to and the least that leads to it; labels jump over labels (what my label leads to, I lead to), so that they spread by doubling too. Nodes of
one component agree in both; edges between nodes that don't are dropped. Where both labels are one node, that node's component is found; all else is
labelled again in another order of the nodes.

Every few rounds state is cut to a file, so plans don't grow with them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from juristream.operators.lineage import cut

#: Doublings between two cuts: each reads the one before twice.
STEPS = 2


def contracted(edges: DataFrame, kept: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges (src, dst) with each maximal path of pass-through nodes as one edge (src, dst, path); what lies on these: node, path; and
    rings of such nodes: node, component (the least node of the ring).

    Nodes of `kept` (column node) count as ends whatever their edges. path is null for an edge that is there itself. Loops are left out."""
    every = cut(edges.select("src", "dst").where("src <> dst").distinct())
    out = every.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"), F.min("dst").alias("to"))
    into = every.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    through = out.join(into, "node").where("n_out = 1 AND n_in = 1").select("node", "to")
    if kept is not None:
        through = through.join(kept.select("node").distinct(), "node", "left_anti")
    # to: the node a pointer has come to; last: the pass-through node before it; least: of those it passed.
    one = through.select("node", "to", F.col("node").alias("last"), F.col("node").alias("least"))
    one = cut(one.join(through.select(F.col("node").alias("to"), F.lit(True).alias("open")), "to", "left").withColumn("moved", F.lit(False)))
    n = one.count()
    rounds = 0
    while n and rounds <= math.ceil(math.log2(n + 1)) + STEPS:
        for _ in range(STEPS):
            next_ = one.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("last").alias("_last"), F.col("least").alias("_least"), F.col("open").alias("_open"), F.lit(True).alias("_met"))
            one = one.join(next_, "to", "left")
            one = one.select("node", F.coalesce("_to", "to").alias("to"), F.coalesce("_last", "last").alias("last"), F.least("least", "_least").alias("least"), F.when(F.col("_met"), F.col("_open")).otherwise(F.col("open")).alias("open"), (F.coalesce(F.col("_least") < F.col("least"), F.lit(False)) | (F.col("_met").isNotNull() & F.col("_open").isNull())).alias("moved"))
        one = cut(one)
        rounds += STEPS
        # Paths have come to their ends when no pointer is moved to one; rings when none finds a lesser node.
        if not one.agg(F.bool_or("moved")).first()[0]:
            break
    rings = one.where("open").select("node", F.col("least").alias("component"))
    paths = one.where("open IS NULL")
    inner = one.select("node")
    heads = every.join(paths.select(F.col("node").alias("dst"), "to", F.col("last").alias("path")), "dst").join(inner.select(F.col("node").alias("src")), "src", "left_anti")
    joined = heads.select("src", F.col("to").alias("dst"), "path")
    plain = every.join(inner.select(F.col("node").alias("src")), "src", "left_anti").join(inner.select(F.col("node").alias("dst")), "dst", "left_anti")
    none = F.lit(None).cast(every.schema["src"].dataType).alias("path")
    return cut(plain.select("src", "dst", none).unionByName(joined)), paths.select("node", F.col("last").alias("path")), rings


def _labelled(edges: DataFrame, turn: int) -> DataFrame:
    """node, f, b: the least nodes that each node leads to and that lead to it, itself included, in the turn's order (the first is that of the nodes)."""
    order = (lambda c: F.struct(F.lit(0).cast("long").alias("o"), F.col(c).alias("n"))) if turn == 0 else (lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("o"), F.col(c).alias("n")))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    state = cut(nodes.select("node", order("node").alias("f"), order("node").alias("b"), F.lit(True).alias("moved")))
    while True:
        label = lambda c, which: state.select(F.col("node").alias(c), F.col(which).alias("x"))  # noqa: B023, E731
        none = F.lit(None).cast(state.schema["f"].dataType)
        # What an edge's end leads to its start leads to; what leads to its start leads to its end. So do labels of labels.
        steps = edges.select(F.col("dst").alias("at"), F.col("src").alias("node")).unionByName(state.select(F.col("f.n").alias("at"), "node").where("at <> node"))
        back = edges.select(F.col("src").alias("at"), F.col("dst").alias("node")).unionByName(state.select(F.col("b.n").alias("at"), "node").where("at <> node"))
        news = steps.join(label("at", "f"), "at").select("node", F.col("x").alias("f"), none.alias("b")).unionByName(back.join(label("at", "b"), "at").select("node", none.alias("f"), F.col("x").alias("b")))
        least = news.groupBy("node").agg(F.min("f").alias("_f"), F.min("b").alias("_b"))
        both = state.select("node", "f", "b").join(least, "node", "left")
        state = cut(both.select("node", F.least("f", "_f").alias("f"), F.least("b", "_b").alias("b"), (F.coalesce(F.col("_f") < F.col("f"), F.lit(False)) | F.coalesce(F.col("_b") < F.col("b"), F.lit(False))).alias("moved")))
        if not state.agg(F.bool_or("moved")).first()[0]:
            return state


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component of every node on a directed cycle: the strongly connected components of more than one node, named by a node of theirs, and nodes
    with a loop, which are their own if they have no other."""
    core, inner, rings = contracted(edges)
    found = None
    loops = core.where("src = dst")  # a path that comes back to where it left
    work, turn = cut(core.where("src <> dst").select("src", "dst").distinct()), 0
    while work.limit(1).count():
        state = _labelled(work, turn)
        done = state.where(F.col("f.n") == F.col("b.n")).select("node", F.col("f.n").alias("component"))
        found = done if found is None else found.unionByName(done)
        ends = lambda c: state.select(F.col("node").alias(c), F.col("f").alias(f"f_{c}"), F.col("b").alias(f"b_{c}"))  # noqa: B023, E731
        both = work.join(ends("src"), "src").join(ends("dst"), "dst")
        work = cut(both.where((F.col("f_src") == F.col("f_dst")) & (F.col("b_src") == F.col("b_dst")) & (F.col("f_src.n") != F.col("b_src.n"))).select("src", "dst"))
        turn += 1
    if found is None:
        found = loops.select(F.col("src").alias("node"), F.col("src").alias("component"))
    else:
        sizes = found.groupBy("component").agg(F.count("*").alias("n"))
        found = cut(found.join(sizes.where("n > 1").select("component"), "component", "left_semi").select("node", "component"))
        alone = loops.select(F.col("src").alias("node")).distinct().join(found, "node", "left_anti")
        found = found.unionByName(alone.select("node", F.col("node").alias("component")))
    # Inner nodes of a path are on a cycle if both its ends are in one component.
    ends = core.where("path IS NOT NULL").join(found.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(found.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
    along = inner.join(ends.where("a = b").select("path", "a"), "path").select("node", F.col("a").alias("component"))
    whole = found.unionByName(along).unionByName(rings)
    own = edges.where("src = dst").select(F.col("src").alias("node")).distinct().join(whole, "node", "left_anti")
    return whole.unionByName(own.select("node", F.col("node").alias("component")))


def reachable_from(edges: DataFrame, seeds: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """origin, node: what directed paths of one edge or more lead to from stated seeds (column node), each a row; only nodes of `targets`, if given.

    With targets, chains between seeds and targets are one step; without, a step is an edge."""
    origins = seeds.select(F.col("node").alias("origin")).distinct()
    if targets is not None:
        kept = origins.select(F.col("origin").alias("node")).union(targets.select("node"))
        step = contracted(edges, kept)[0].select("src", "dst").unionByName(edges.where("src = dst").select("src", "dst")).distinct()
    else:
        step = cut(edges.select("src", "dst").distinct())
    frontier = cut(origins.join(step, F.col("origin") == F.col("src")).select("origin", F.col("dst").alias("node")).distinct())
    seen, n = frontier, frontier.count()
    while n:
        more = frontier.join(step, F.col("node") == F.col("src")).select("origin", F.col("dst").alias("node")).distinct()
        frontier = cut(more.join(seen, ["origin", "node"], "left_anti"))
        n = frontier.count()
        seen = cut(seen.union(frontier)) if n else seen
    return seen if targets is None else seen.join(targets.select("node").distinct(), "node", "left_semi").select("origin", "node")
