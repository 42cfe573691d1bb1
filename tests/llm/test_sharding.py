from collections import Counter, defaultdict
from zlib import crc32

import pytest

from propensity.llm.sharding import assign_shards, grown, regular_tree, with_shard

SCHEMA = "doc_id bigint, text string"


def test_columns_slots_and_growth(clashing):
    rows = [(i, None if i % 50 == 0 else "ü" * (i % 40)) for i in range(4000)] + [(7, "again"), (7, "again"), (None, "x"), (None, None)]
    result = assign_shards(clashing(rows, SCHEMA)).collect()
    assert len(result) == len(rows)
    expected = Counter((i, len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in result) == expected
    assert {r.law for r in result} == {"key"}
    slots = defaultdict(list)
    for r in result:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert set(slots) == set(range(16))
    assert all(sorted(own) == list(range(len(own))) for own in slots.values())
    assert all(180 < len(own) < 320 for own in slots.values())
    moved = sum(r.grown_shard == 16 for r in result)
    assert 0.7 < moved * 17 / len(rows) < 1.3
    by_id = defaultdict(set)
    for r in result:
        by_id[r.doc_id].add(r.shard)
    assert all(len(shards) == 1 for shards in by_id.values())


def test_same_shards_and_slots_in_another_layout(spark):
    rows = [(i, str(i)) for i in range(500)]
    one = assign_shards(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    other = assign_shards(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, other))


def test_weights_and_confined_movement(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "k")
    tree = regular_tree()
    changed = regular_tree()
    changed[1][0][10] = 3.0
    placed = with_shard(with_shard(keys, "k", tree, "old"), "k", changed, "new").collect()
    counts = Counter(r.new for r in placed)
    assert abs(counts[10] / (3 * counts[0]) - 1) < 0.15
    # shards 8 to 15 are the region whose weight grew: nothing moves between or into the others
    assert all(r.new == r.old or r.new >= 8 for r in placed)
    assert all(r.new == r.old or r.old < 8 or r.new in (8, 9, 10, 11) for r in placed)


def test_new_racks_move_nothing_within_other_regions(spark):
    keys = spark.range(20_000).withColumnRenamed("id", "k")
    tree, changed = regular_tree(), regular_tree()
    changed[0].append({16: 1.0, 17: 1.0})
    placed = with_shard(with_shard(keys, "k", tree, "old"), "k", changed, "new").collect()
    moved = [r for r in placed if r.old != r.new]
    assert moved and all(r.new in (*range(8), 16, 17) for r in moved)
    # within the old racks of the region that grew keys stay, unless they go to the new rack
    assert all(r.new in (16, 17) for r in moved if r.old < 8)


def test_no_weight(spark):
    assert with_shard(spark.range(5), "id", [[{0: 0.0, 1: 1.0}]], "s").select("s").distinct().first().s == 1
    with pytest.raises(ValueError):
        with_shard(spark.range(5), "id", [[{0: 0.0}]], "s")
    assert len(grown(regular_tree())) == 3


def test_empty_table(spark):
    assert assign_shards(spark.createDataFrame([], SCHEMA)).count() == 0


def test_frequent_id_is_dealt_to_ranges(spark):
    rows = [(1, str(i % 3)) for i in range(3000)]
    result = assign_shards(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len({r.shard for r in result}) == 1 and sorted(r.slot for r in result) == list(range(3000))


def spark_hash(*values):
    """Spark's xxhash64 of some values: each is hashed with the hash so far as its seed."""
    import struct

    from xxhash import xxh64_intdigest

    seed = 42
    for value in values:
        data = value if isinstance(value, bytes) else struct.pack("<q" if isinstance(value, Long) else "<i", value)
        seed = xxh64_intdigest(data, seed)
    return seed


class Long(int):
    pass


def drawn_shard(doc_id, tree):
    """Down the tree one level at a time, in plain Python."""
    from math import log

    key = ("\x00" if doc_id is None else str(doc_id)).encode()

    def choose(level, parent, weights):
        draws = []
        for child, weight in weights.items():
            uniform = ((spark_hash(key, level, parent, child) >> 11) + 0.5) / 2**53
            draws.append((log(uniform) / weight, child))
        return max(draws)[1]

    region = choose(0, 0, {i: sum(sum(rack.values()) for rack in racks) for i, racks in enumerate(tree)})
    rack = choose(1, region, {i: sum(shards.values()) for i, shards in enumerate(tree[region])})
    return choose(2, region << 16 | rack, tree[region][rack])


def test_query_equals_brute_force(spark, tables):
    from propensity.llm.queries import op9_hash_tree_shards

    documents = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    tree = regular_tree()
    rows = []
    for doc_id, text in documents:
        data = (text or "").encode()
        mixed = spark_hash(Long(doc_id))
        signed = mixed - (1 << 64) if mixed >> 63 else mixed
        rows.append((drawn_shard(doc_id, tree), signed, doc_id, len(data) + 1, crc32(data), drawn_shard(doc_id, grown(tree))))
    expected, slots = [], Counter()
    for shard, _, doc_id, size, checksum, more in sorted(rows):
        expected.append((doc_id, size, checksum, "key", shard, slots[shard], more))
        slots[shard] += 1
    assert sorted(map(tuple, op9_hash_tree_shards(spark, tables).collect())) == sorted(expected)
