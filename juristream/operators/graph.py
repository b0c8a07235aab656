"""Graph operators on edge tables: reach in a few hops, version chains, cycles, degrees, neighbourhoods.

Edges are rows (src, dst). Undirected work goes over both directions. Hops are joins with a bound number of rounds; a
chain of unbound length doubles its reach each round until nothing is new, so a path of n edges takes log2(n) joins. Rounds are cut, so
plans don't grow with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from juristream.operators.cycles import reachable_from, strong_components
from juristream.operators.lineage import cut


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge between two different nodes, once."""
    one = edges.select("src", "dst").where("src <> dst")
    return one.union(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def within_hops(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """node, distance: every node at most `hops` undirected steps from a seed (column node), with the fewest steps.

    Only the nodes that a round found first are carried into the next; they and the edges are cut each round, so a round plans from files.
    """
    both = cut(undirected(edges))
    frontier = cut(seeds.select("node").distinct())
    seen = frontier.withColumn("distance", F.lit(0))
    for n in range(1, hops + 1):
        step = frontier.join(both, frontier["node"] == both["src"]).select(F.col("dst").alias("node")).distinct()
        frontier = step.join(seen.select("node"), "node", "left_anti")
        frontier = cut(frontier) if n < hops else frontier
        seen = seen.union(frontier.withColumn("distance", F.lit(n)))
    return seen


def proximity(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """node, distance, score = 1 / (distance + 1), without the seeds."""
    near = within_hops(edges, seeds, hops).where("distance > 0")
    return near.withColumn("score", 1.0 / (F.col("distance") + 1))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree: ends of edges that touch it."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def chains(edges: DataFrame, most_hops: int = 10) -> DataFrame:
    """Paths of old -> new edges from nodes without a predecessor to nodes without a successor: root, terminal, path, hops, ended.

    A node may have several successors. Paths that visit a node twice are not returned; those that go on after most_hops end
    there, with ended false. Each round is cut, so its plan reads the rounds before from files.
    """
    step = cut(edges.select("src", "dst").distinct())
    more = step.select(F.col("src").alias("at")).distinct()
    roots = step.join(step.select(F.col("dst").alias("src")), "src", "left_anti").select("src").distinct()
    paths = cut(roots.select(F.col("src").alias("root"), F.col("src").alias("at"), F.array("src").alias("path")))
    out = None
    for n in range(1, most_hops + 1):
        paths = paths.join(step, paths["at"] == step["src"]).where(~F.array_contains("path", F.col("dst"))).select("root", F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path"))
        marked = cut(paths.join(more.withColumn("goes_on", F.lit(True)), "at", "left"))
        over = marked.where("goes_on IS NULL") if n < most_hops else marked
        out = over if out is None else out.unionByName(over)
        paths = marked.where("goes_on").drop("goes_on")
    return out.select("root", F.col("at").alias("terminal"), "path", (F.size("path") - 1).alias("hops"), F.col("goes_on").isNull().alias("ended"))


def reachable(edges: DataFrame) -> DataFrame:
    """src, dst: pairs joined by a directed path, however long: as many rows as there are such pairs (cycles.reachable_from() takes stated seeds).

    Each round doubles the reach: what paths of exactly n edges lead to goes on by what paths of up to n do, so a pair is made once for each length
    that a path of it has. The first round without a new pair is the last, as a longer shortest path would begin with one of any lesser length.
    """
    pairs = exact = cut(edges.select("src", "dst").distinct())
    joined = lambda a, b: a.select("src", F.col("dst").alias("at")).join(b.select(F.col("src").alias("at"), F.col("dst").alias("to")), "at").select("src", F.col("to").alias("dst")).distinct()
    while True:
        new = cut(joined(exact, pairs).join(pairs, ["src", "dst"], "left_anti"))
        if new.isEmpty():
            return pairs
        pairs, exact = pairs.union(new), cut(joined(exact, exact))


def on_cycles(edges: DataFrame) -> DataFrame:
    """Nodes from which a directed path leads back: those of strong components, and nodes with a loop."""
    return strong_components(edges).select("node")


def would_close_cycle(edges: DataFrame, new: DataFrame) -> DataFrame:
    """New edges (src, dst) whose end already leads to their start, or that are loops.

    With the new edges in place both ends of such an edge are in one strong component, so paths are only followed inside these, and there only from the
    ends of new edges, with chains between them as one step.
    """
    asked = cut(new.select("src", "dst").distinct())
    old = edges.select("src", "dst").distinct()
    of = cut(strong_components(old.union(asked)))
    ends = lambda c: of.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    inside = lambda e: e.join(ends("src"), "src").join(ends("dst"), "dst").where("_src = _dst").select("src", "dst")
    likely = cut(inside(asked.where("src <> dst")))
    back = reachable_from(inside(old), likely.select(F.col("dst").alias("node")), likely.select(F.col("src").alias("node")))
    return asked.where("src = dst").union(likely.join(back.select(F.col("node").alias("src"), F.col("origin").alias("dst")), ["src", "dst"], "left_semi")).distinct()


def branching(edges: DataFrame) -> DataFrame:
    """node, n_out, n_in of nodes with more than one edge out or in: a version chain has none."""
    ends = edges.select("src", "dst").distinct()
    out = ends.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_out"))
    into = ends.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n_in"))
    both = out.join(into, "node", "full").na.fill(0, ["n_out", "n_in"])
    return both.where("n_out > 1 OR n_in > 1")


def importance(degree: Column, citations: Column, level: Column, accesses: Column) -> Column:
    return 0.4 * degree + 0.3 * citations + 0.2 * level + 0.1 * accesses


def marker_size(score: Column) -> Column:
    """Between 12 and 70, growing with the square root of a score."""
    return F.greatest(F.lit(12.0), F.least(F.lit(70.0), 12.0 + 5.0 * F.sqrt(score)))


def neighbourhood(edges: DataFrame, seeds: DataFrame, *, hops: int = 2, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, distance, degree, centrality) nearest to the seeds, `limit` of them, and the edges between these.

    Order: distance, then higher degree, then node; degree and centrality count edges within the neighbourhood.
    """
    near = within_hops(edges, seeds, hops)
    here = edges.select("src", "dst").distinct().join(near.select(F.col("node").alias("src")), "src", "left_semi").join(near.select(F.col("node").alias("dst")), "dst", "left_semi")
    ranked = near.join(degrees(here), "node", "left").na.fill(0, ["degree"]).orderBy("distance", F.desc("degree"), "node").limit(limit)
    kept = here.join(ranked.select(F.col("node").alias("src")), "src", "left_semi").join(ranked.select(F.col("node").alias("dst")), "dst", "left_semi")
    n = F.count("*").over(Window.partitionBy())
    return ranked.withColumn("centrality", F.col("degree") / F.greatest(F.lit(1), n - 1)), kept.select("src", "dst")


def flatten_documents(documents: DataFrame) -> DataFrame:
    """Parsed documents (doc, articles: array<struct<no,title,text,clauses:array<struct<no,text,points:array<struct<no,text>>>>>>) as
    rows doc, level, article, clause, point, text."""
    a = documents.select("doc", F.explode_outer("articles").alias("a"))
    k = a.select("doc", "a", F.explode("a.clauses").alias("k"))
    p = k.select("doc", "a", "k", F.explode("k.points").alias("p"))
    none = F.lit(None).cast("string")
    articles = a.where("a IS NOT NULL").select("doc", F.lit("dieu").alias("level"), F.col("a.no").alias("article"), none.alias("clause"), none.alias("point"), F.coalesce("a.text", "a.title", F.lit("")).alias("text"))
    clauses = k.select("doc", F.lit("khoan").alias("level"), F.col("a.no").alias("article"), F.col("k.no").alias("clause"), none.alias("point"), F.col("k.text").alias("text"))
    points = p.select("doc", F.lit("diem").alias("level"), F.col("a.no").alias("article"), F.col("k.no").alias("clause"), F.col("p.no").alias("point"), F.col("p.text").alias("text"))
    return articles.unionByName(clauses).unionByName(points)


def containment(documents: DataFrame, provisions: DataFrame, most: int = 50) -> DataFrame:
    """Per document its tree as structs for display: nodes (id, kind, label) and edges (source, target, kind), of `most` clauses at most.

    documents: doc, title. provisions: doc, article, clause (null for an article's own row). Clauses count in natural order.
    """
    from juristream.functions.text import natural_key

    order = [natural_key(F.col("article")), natural_key(F.col("clause"))]
    rows = provisions.where("clause IS NOT NULL").select("doc", "article", "clause").distinct()
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy(*order))).where(F.col("n") <= most)
    art = F.concat(F.col("doc"), F.lit("::D"), F.col("article"))
    one = F.concat(art, F.lit(".K"), F.col("clause"))
    node = lambda i, kind, label: F.struct(i.alias("id"), F.lit(kind).alias("kind"), label.alias("label"))
    edge = lambda a, b, kind: F.struct(a.alias("source"), b.alias("target"), F.lit(kind).alias("kind"))
    parts = rows.groupBy("doc").agg(
        F.collect_set(node(art, "dieu", F.concat(F.lit("Điều "), F.col("article")))).alias("articles"),
        F.collect_list(node(one, "khoan", F.concat(F.lit("Khoản "), F.col("clause")))).alias("clauses"),
        F.collect_set(edge(F.col("doc"), art, "CO_DIEU")).alias("into_articles"),
        F.collect_list(edge(art, one, "CO_KHOAN")).alias("into_clauses"),
    )
    whole = documents.join(parts, "doc", "left")
    empty = lambda c: F.coalesce(F.col(c), F.array())
    top = F.array(node(F.col("doc"), "van_ban", F.coalesce("title", "doc")))
    return whole.select("doc", F.concat(top, F.array_sort(empty("articles")), F.array_sort(empty("clauses"))).alias("nodes"), F.concat(F.array_sort(empty("into_articles")), F.array_sort(empty("into_clauses"))).alias("edges"))


def with_labels(nodes: DataFrame, labels: list[str], status: str | None = None) -> DataFrame:
    """Nodes (labels: array, status) that carry all these labels and, if asked for, that status."""
    wanted = F.size(F.array_intersect("labels", F.array(*map(F.lit, labels)))) == len(set(labels))
    return nodes.where(wanted if status is None else wanted & (F.col("status") == status))
