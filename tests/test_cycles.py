"""Strong components, cycles and guards against plain searches; rounds by depth."""

import random

from juristream.operators import cycles, graph


def reach(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    out = {}
    for start in {n for e in edges for n in e}:
        seen, todo = set(), list(after.get(start, ()))
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += after.get(n, ())
        out[start] = seen
    return out


def groups(edges):
    to = reach(edges)
    return {frozenset(m for m in to if m == n or (m in to[n] and n in to[m])) for n in to if n in to[n]}


def test_components(spark):
    """Many graphs side by side in one."""
    rng = random.Random(4)
    chain, ring = [(i, i + 1) for i in range(40)], [(i, (i + 1) % 40) for i in range(40)] + [(100, 3), (7, 200), (200, 201)]
    small = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4), (6, 7), (7, 8), (8, 7), (9, 9), (20, 21), (21, 20), (1, 2)]
    random_ones = [[(rng.randrange(n), rng.randrange(n)) for _ in range(m)] for n, m in ((12, 16), (9, 20))]
    edges = [(f"{k}-{a}", f"{k}-{b}") for k, one in enumerate([[("a", "a"), ("a", "b"), ("b", "c")], chain, ring, small, *random_ones]) for a, b in one]
    got = {}
    for node, component in cycles.strong_components(spark.createDataFrame(edges, "src string, dst string")).collect():
        got.setdefault(component, []).append(node)
    assert all(len(set(nodes)) == len(nodes) and component in nodes for component, nodes in got.items())
    assert {frozenset(nodes) for nodes in got.values()} == groups(edges)


def test_guard(spark):
    rng = random.Random(6)
    for n, m in ((10, 13),):
        old = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        new = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        to = reach(old)
        want = {(a, b) for a, b in new if a == b or a in to.get(b, ())}
        frame = lambda rows: spark.createDataFrame(sorted(rows), "src long, dst long")
        assert {tuple(r) for r in graph.would_close_cycle(frame(old), frame(new)).collect()} == want
        seeds = spark.createDataFrame([(0,), (3,), (999,)], "node long")
        assert {tuple(r) for r in cycles.reachable_from(frame(old), seeds).collect()} == {(s, x) for s in (0, 3) for x in to.get(s, ())}


def test_rounds_grow_with_the_logarithm_of_depth(spark):
    """10,000 nodes in a chain and as many in a ring, in no order of their numbers."""
    n = 10_000
    names = list(range(2 * n))
    random.Random(1).shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(2 * n - 1) if i != n - 1] + [(names[-1], names[n])]
    df = spark.createDataFrame(edges, "src long, dst long").cache()
    df.count()
    alone = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # stages and broadcasts are jobs of their own else
    before = {c: spark.conf.get(c) for c in alone}
    for c, v in alone.items():
        spark.conf.set(c, v)
    spark.sparkContext.setJobGroup("depth", "depth")
    try:
        assert graph.on_cycles(df).count() == n
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("depth")) <= 40
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
