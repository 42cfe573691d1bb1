import hashlib
import re
from collections import defaultdict

import pytest

from propensity.llm.mixing import apply_mix, mix_sources, source_targets

SCHEMA = "doc_id bigint, text string, source string"


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets_by_rounds(sizes, weights=(5, 2, 1), limit=3):
    """Shares by weight, cutting at the limit and sharing the rest again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {name: weights[i % len(weights)] for i, name in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(limit * sizes[n] for n in full)
        open_names = [n for n in names if n not in full]
        share = {n: left * weight[n] / sum(weight[m] for m in open_names) for n in open_names}
        above = {n for n in open_names if share[n] > limit * sizes[n]}
        if not above:
            return {n: limit * sizes[n] if n in full else share[n] for n in names}
        full |= above


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 500}, {"a": 1, "b": 1, "c": 1}, {"a": 0, "b": 5, None: 3}, {"é": 7, "z": 900, "": 2, None: 50}, {"a": 0}, {"only": 9},
])
def test_targets_equal_those_by_rounds(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    found = {r.source: r.target for r in source_targets(table).collect()}
    assert found == pytest.approx(targets_by_rounds(sizes))


def test_words_taken(clashing, words):
    rows = [(i, words(i % 37, i), ["web", "books", "code", None, "tiny"][i % 5 if i % 97 else 4]) for i in range(600)]
    rows += [(1000, None, "web"), (1001, " \t\n", "books"), (1002, words(20_000, 1), "web"), (None, "a b c", "code"), (7, rows[7][1], rows[7][2])]
    result = mix_sources(clashing(rows, SCHEMA)).collect()
    assert len(result) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in result:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r["size"]
    expected = targets_by_rounds(sizes)
    for r in result:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
    assert all(abs(taken[s] - expected[s]) <= 2 for s in sizes)
    assert sorted((r.doc_id or -1, r["size"]) for r in result) == sorted((i or -1, size_of(t)) for i, t, _ in rows)


def test_order_of_the_cut(spark):
    rows = [(i, "w " * 10, "s" if i < 80 else "t") for i in range(100)]
    found = {r.doc_id: r for r in mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()}
    for low, high in ((0, 80), (80, 100)):
        budget = round(found[low].target) - (high - low) * 10 * (round(found[low].target) // found[low].source_size)
        for i in sorted(range(low, high), key=lambda i: hashlib.md5(f"mix-1:{i}".encode()).hexdigest()):
            extra = max(0, min(10, budget))
            assert found[i].taken % 10 == extra % 10
            budget -= extra


def test_applied_mix_holds_the_words_taken(clashing, words):
    rows = [(i, words(1 + i % 23, i) + "\n", "abc"[i % 3]) for i in range(200)]
    table = clashing(rows, SCHEMA)
    mixed = apply_mix(table)
    assert mixed.columns == table.columns
    texts = {i: t for i, t, _ in rows}
    got = defaultdict(int)
    for r in mixed.collect():
        assert texts[r.doc_id].startswith(r.text)
        got[r.doc_id] += size_of(r.text)
    assert got == {r.doc_id: r.taken for r in mix_sources(table).collect() if r.taken}


def test_layout_does_not_matter(spark, words):
    rows = [(i, words(i % 9, i), "ab"[i % 2]) for i in range(100)]
    one = mix_sources(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    other = mix_sources(spark.createDataFrame(rows[::-1], SCHEMA).repartition(5)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, other))


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mix_sources(empty).count() == 0 and apply_mix(empty).count() == 0
