import random

from propensity.llm.components import connected_components


def plain(edges):
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {i: root(i) for i in parent}


def test_shapes(spark):
    source = random.Random(2)
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(200)]
    tree = [(2000 + i, 2000 + source.randrange(i)) for i in range(1, 200)]
    loops = [(5, 5), (7000, 7000), (3000, 3001), (3001, 3000), (3000, 3001), (-4, -9)]
    edges = path + star + tree + loops
    found = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    assert {r.node: r.component for r in found.collect()} == plain(edges)


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
