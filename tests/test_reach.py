"""Reach over cycles, loops and side paths."""

import itertools

from juristream.operators import graph


def test_reach_with_cycles_and_side_paths(spark):
    edges = [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (1, 5), (5, 6), (6, 7), (7, 5), (8, 8), (9, 0)]
    want = set(edges)
    while more := {(a, d) for (a, b), (c, d) in itertools.product(want, want) if b == c} - want:
        want |= more
    got = [tuple(r) for r in graph.reachable(spark.createDataFrame(edges, "src int, dst int")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
