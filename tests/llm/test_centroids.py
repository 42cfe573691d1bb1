import hashlib
import math
import random

import numpy as np
import pytest

from propensity.llm.centroids import (
    Cells, cell_edges, cells_of, cluster_vectors, distances, interval_tables,
)

SCHEMA = "vec_id bigint, embedding array<float>"


def brute_force(rows, clusters=8, rounds=10, components=4):
    """Plain Lloyd in Python integers over ``(id, vector)``."""
    kept = []
    for number, vector in rows:
        if vector is None or len(vector) != components or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((number, [math.floor(1024 * float(np.float32(x))) for x in vector]))
    ordered = sorted(
        kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    )
    centroids = [v for _, v in ordered[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for i in range(len(centroids)):
            members = [v for (_, v), own in zip(kept, of) if own == i]
            if members:
                centroids[i] = [sum(column) // len(members) for column in zip(*members)]
    found = [(number, *nearest(v)[::-1]) for number, v in kept]
    per = {}
    for _, cluster, distance in found:
        per[cluster] = per.get(cluster, 0) + distance
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(number, c, d, per[c], sum(per.values()), digest[c]) for number, c, d in found]


def rows_of(result):
    return sorted(map(tuple, result.assigned.collect()), key=repr)


def random_rows(count, components=4, seed=1, spread=0.2):
    source = random.Random(seed)
    middles = [[source.uniform(-1, 1) for _ in range(components)] for _ in range(6)]
    return [(i, [m + source.gauss(0, spread) for m in source.choice(middles)]) for i in range(count)]


@pytest.mark.parametrize("bits", [1, 3, 6, 8])
def test_equals_brute_force_whatever_the_cells(spark, bits):
    rows = random_rows(700)
    result = cluster_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5), components=4, bits=bits)
    assert rows_of(result) == sorted(brute_force(rows), key=repr)


def test_odd_rows_and_clashing_columns(clashing):
    odd = [
        (1000, None), (1001, []), (1002, [1.0] * 3), (1003, [1.0] * 5), (1004, [1.0, None, 0.0, 0.0]), (1005, [float("nan")] * 4),
        (1006, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.1, 0.2, 0.3, 0.4]), (None, [-0.1, 0.2, 0.3, 0.4]), (5, [0.5] * 4), (5, [-0.5] * 4),
    ]
    rows = random_rows(60) + odd + [(2000 + i % 2, [-9.0, 9.0, -9.0, 9.0]) for i in range(40)]
    assert rows_of(cluster_vectors(clashing(rows, SCHEMA), components=4)) == sorted(brute_force(rows), key=repr)


def test_ties_take_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(i, [float(i % 3 - 1)] * 4) for i in range(30)]
    result = cluster_vectors(spark.createDataFrame(rows, SCHEMA), components=4)
    assert rows_of(result) == sorted(brute_force(rows), key=repr)
    assert len(result.centroids) == 8


def test_fewer_vectors_than_clusters(spark):
    rows = random_rows(3)
    result = cluster_vectors(spark.createDataFrame(rows, SCHEMA), components=4)
    assert rows_of(result) == sorted(brute_force(rows), key=repr) and len(result.centroids) == 3


def test_refused_settings(spark):
    table = spark.createDataFrame(random_rows(3), SCHEMA)
    for settings in ({"clusters": 0}, {"clusters": 513}, {"bits": 9}):
        with pytest.raises(ValueError, match="clusters"):
            cluster_vectors(table, components=4, **settings)


def test_empty_table_and_too_large_values(spark):
    assert cluster_vectors(spark.createDataFrame([], SCHEMA)).assigned.count() == 0
    rows = [*random_rows(50), (99, [3e38, 0.0, 0.0, 0.0]), (98, [1e6, 0.0, 0.0, 0.0])]
    assert rows_of(cluster_vectors(spark.createDataFrame(rows, SCHEMA), components=4)) == sorted(brute_force(rows[:50]), key=repr)


def test_intervals_hold_the_distances_and_decide_most():
    random_source = np.random.default_rng(5)
    middles = random_source.normal(0, 150, (8, 64))
    vectors = (middles[random_source.integers(8, size=3000)] + random_source.normal(0, 60, (3000, 64))).astype(np.int64)
    edges = cell_edges(vectors[:500], vectors.min(axis=0), vectors.max(axis=0), 6)
    cells = cells_of(vectors, edges)
    at = np.arange(64)
    assert (edges[at, cells] <= vectors).all() and (vectors < edges[at, cells + 1]).all()
    centroids = middles.astype(np.int64)
    low, high = (sum(t[d][cells[:, d]] for d in range(64)) for t in interval_tables(edges, centroids))
    exact = distances(vectors, centroids)
    assert (low <= exact).all() and (exact <= high).all()
    found = Cells.of(edges, centroids).decide(cells)
    sure = found >= 0
    assert (found[sure] == exact.argmin(axis=1)[sure]).all() and sure.mean() > 0.9


def test_later_rounds_fetch_few_vectors(spark):
    rows = random_rows(4000, 64, spread=0.05)
    result = cluster_vectors(spark.createDataFrame(rows, SCHEMA))
    assert result.fetched[0] == 4000 and max(result.fetched[2:], default=0) < 1500


def test_differences_decide_where_distances_overlap():
    """Centroids that lie close together, as those of vectors without clusters do."""
    random_source = np.random.default_rng(6)
    vectors = random_source.normal(0, 128, (4000, 64)).astype(np.int64)
    centroids = random_source.normal(0, 12, (8, 64)).astype(np.int64)
    edges = cell_edges(vectors[:1000], vectors.min(axis=0), vectors.max(axis=0), 8)
    cells = cells_of(vectors, edges)
    found = Cells.of(edges, centroids).decide(cells)
    sure = found >= 0
    assert (found[sure] == distances(vectors, centroids).argmin(axis=1)[sure]).all() and sure.mean() > 0.8
    low, high = (sum(t[d][cells[:, d]] for d in range(64)) for t in interval_tables(edges, centroids))
    assert ((low <= high.min(axis=1)[:, None]).sum(axis=1) > 1).mean() > 0.5


def test_equal_centroids_and_exact_ties_are_decided_by_number():
    vectors = np.array([[0, 0], [2, 2], [1, 1], [5, 5]], np.int64)
    centroids = np.array([[0, 0], [2, 2], [2, 2]], np.int64)
    edges = cell_edges(vectors, vectors.min(axis=0), vectors.max(axis=0), 8)
    found = Cells.of(edges, centroids).decide(cells_of(vectors, edges))
    exact = distances(vectors, centroids).argmin(axis=1)
    assert all(f in (-1, e) for f, e in zip(found, exact))
