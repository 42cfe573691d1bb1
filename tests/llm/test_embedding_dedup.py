import numpy as np
import pytest

from propensity.llm import embedding_dedup
from propensity.llm.embedding_dedup import near_duplicate_vectors, projections, table_keys, to_units


def brute(rows, cosine):
    good = []
    for i, vector, label in rows:
        if i is None or label is None or not vector or None in vector:
            continue
        v = np.array(vector, float)
        if np.isfinite(v).all() and v.any():
            good.append((i, v / np.linalg.norm(v), label))
    links = {}
    parent = {i: i for i, _, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (a, u, p) in enumerate(good):
        for b, v, q in good[x + 1 :]:
            if p == q and len(u) == len(v) and u @ v >= cosine:
                links[a] = links.get(a, 0) + 1
                links[b] = links.get(b, 0) + 1
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i: (links.get(i, 0), root(i)) for i in parent}


def vectors(count=500, size=32):
    random = np.random.default_rng(6)
    rows = []
    for group in range(count // 10):
        base = random.standard_normal(size)
        for copy in range(10):
            noise = [0, 0.05, 0.1, 0.2, 0.3, 0.35][copy % 6]
            v = base / np.linalg.norm(base) + noise * random.standard_normal(size) / size**0.5
            if copy == 9:
                v = v * 40
            rows.append((len(rows), v.astype(np.float32).tolist(), group % 3))
    rows += [(len(rows) + i, rows[0][1], 0) for i in range(40)]
    return rows


ODD = [
    (9001, None, 1), (9002, [], 1), (9003, [0.0] * 32, 1), (9004, [1.0, None] + [0.0] * 30, 1), (9005, [float("nan")] + [1.0] * 31, 1),
    (9006, [float("inf")] + [1.0] * 31, 1), (9007, [1.0] * 32, None), (9008, [1.0] * 32, 1), (9009, [2.0] * 32, 1), (9010, [1.0] * 16, 1), (9011, [1.0] * 32, 2),
]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_links_and_components_equal_brute_force(clashing, kind):
    rows = vectors() + ODD
    found = near_duplicate_vectors(clashing(rows, f"vec_id bigint, embedding array<{kind}>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == brute(rows, 0.93)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_small_blocks_change_nothing(clashing, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 20)
    random = np.random.default_rng(9)
    base = random.standard_normal(32)
    rows = [(i, (base + 0.15 * random.standard_normal(32)).tolist(), 1) for i in range(150)] + vectors(100)[:-40]
    rows = [(i, v, label) for i, (_, v, label) in enumerate(rows)]
    found = near_duplicate_vectors(clashing(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == brute(rows, 0.93)


def test_recall_at_the_boundary():
    random = np.random.default_rng(2)
    one = to_units(random.standard_normal((2000, 64)))
    side = random.standard_normal((2000, 64))
    side = to_units(side - (side * one).sum(axis=1, keepdims=True) * one)
    other = 0.93 * one + (1 - 0.93**2) ** 0.5 * side
    label, drawn = np.zeros(2000, np.uint64), projections(64)
    met = (table_keys(one, label, drawn) == table_keys(other, label, drawn)).any(axis=1)
    assert met.mean() >= 0.998


def test_extreme_scales_and_missing_ids(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [1e-200, 1e-200], 1), (None, [1.0, 1.0], 1), (3, [1.0, -1.0], 1), (3, [1.0, -1.0], 1)]
    found = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in found) == [
        (0, 0, 0, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (3, 1, 3, True),
    ]


def test_vectors_under_one_id_are_judged_each_by_itself(spark):
    schema = "vec_id bigint, embedding array<double>, label int"
    rows = [(5, [1.0, 0.0, 0.0], 1), (5, [0.0, 1.0, 0.0], 1), (3, [1.0, 0.01, 0.0], 1), (4, [0.0, 1.0, 0.01], 1), (5, [0.0, 0.0, 1.0], 1)]
    found = near_duplicate_vectors(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found) == [
        (3, 1, 3, True), (4, 1, 4, True), (5, 0, 5, True), (5, 1, 3, False), (5, 1, 4, False),
    ]


def test_one_id_for_all_vectors_changes_no_link(spark):
    rows = vectors(200)
    found = near_duplicate_vectors(spark.createDataFrame([(1, v, l) for _, v, l in rows], "vec_id bigint, embedding array<float>, label int"))
    assert sorted(r.n_links for r in found.collect()) == sorted(n for n, _ in brute(rows, 0.93).values())


def test_cosines_that_the_tables_are_not_made_for_are_refused(spark):
    with pytest.raises(ValueError, match="0.92"):
        near_duplicate_vectors(spark.createDataFrame([(1, [1.0], 1)], "vec_id bigint, embedding array<float>, label int"), cosine=0.92)


def test_empty_table(spark):
    assert near_duplicate_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0
