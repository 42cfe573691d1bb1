"""Sharding by a hierarchical weighted hash tree.

The tree has regions, racks in regions, and shards in racks, each shard with a weight; a node weighs what its shards weigh. A
key goes down the tree: at each level every child draws a number from the hash of key and child, divided by its
weight, and the largest draw wins. A draw depends on nothing but key, child and that child's weight, so a change
of weights moves keys only into or out of the subtrees whose weights change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propensity.llm.common import inputs, settle, stage
from propensity.llm.ranges import deal_ranges, range_totals, sum_within

#: regions -> racks -> {number of a shard: its weight}; regions and racks are known by their place, shards by their number
Tree = list[list[dict[int, float]]]


def regular_tree(regions: int = 2, racks: int = 2, shards: int = 4) -> Tree:
    """A tree of equal weights, its shards numbered in order."""
    first = [[(region * racks + rack) * shards for rack in range(racks)] for region in range(regions)]
    return [[{start + i: 1.0 for i in range(shards)} for start in row] for row in first]


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own.

    So no existing node changes its weight, and the only keys that move go to the new shard. (A shard added to an existing rack
    would raise the weights of its rack and region, which also draw keys for the shards they have.)
    """
    return [*tree, [{1 + max(shard for region in tree for rack in region for shard in rack): weight}]]


def _draw(key: Column, level: int, parent: Column, child: Column, weight: Column) -> Column:
    """ln(u) / weight with u uniform in (0, 1): the largest of such draws falls on a child in proportion to its weight."""
    hashed = F.xxhash64(key, F.lit(level), parent.cast("int"), child.cast("int"))
    uniform = (F.shiftrightunsigned(hashed, 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    return F.when(weight > 0, F.log(uniform) / weight).otherwise(F.lit(float("-inf")))


def _choose(key: Column, level: int, parent: Column, children: Column) -> Column:
    """Number of the child with the largest draw, of an array of structs ``(number, weight)``."""
    draws = F.transform(
        children,
        lambda child: F.struct(
            _draw(key, level, parent, child["number"], child["weight"]).alias("draw"), child["number"].alias("number")
        ),
    )
    return F.array_max(draws)["number"]


def with_shard(df: DataFrame, key: str, tree: Tree, name: str) -> DataFrame:
    """Adds the number of the shard for ``key``; a NULL key is a key like others."""
    if not any(weight > 0 for region in tree for rack in region for weight in rack.values()):
        raise ValueError("no shard has a weight")

    def children(weights: dict[int, float]) -> Column:
        pairs = [F.struct(F.lit(n).alias("number"), F.lit(float(w)).alias("weight")) for n, w in weights.items()]
        return F.array(*pairs)

    def of(tables: list[Column], place: Column) -> Column:
        return F.element_at(F.array(*tables), place + 1)

    regions = children({i: sum(sum(rack.values()) for rack in region) for i, region in enumerate(tree)})
    racks = [children({i: sum(rack.values()) for i, rack in enumerate(region)}) for region in tree]
    shards = [F.array(*(children(rack) for rack in region)) for region in tree]
    text = F.coalesce(F.col(key).cast("string"), F.lit("\x00"))
    df = df.withColumn("_region", _choose(text, 0, F.lit(0), regions))
    df = df.withColumn("_rack", _choose(text, 1, F.col("_region"), of(racks, F.col("_region"))))
    rack = F.col("_region") * F.lit(1 << 16) + F.col("_rack")
    leaves = F.element_at(of(shards, F.col("_region")), F.col("_rack") + 1)
    return df.withColumn(name, _choose(text, 2, rack, leaves)).drop("_region", "_rack")


def assign_shards(
    df: DataFrame, tree: Tree | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Shard and place in the shard for each document, by the law "key": its id and the tree decide.

    Returns one row per input row: ``doc_id``, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``law``, ``shard``, ``slot``
    (gapless from 0 in each shard, in the order of a hash of the id), ``grown_shard`` (with one more shard).
    Built from DataFrame functions only; ``tree`` is 2 regions of 2 racks of 4 shards unless given.

    Texts are read once and never shuffled. Slots come from ranges of (shard, hash), so no task numbers a whole shard.

    NULL text has size 1 and checksum 0. A NULL id is a key of its own. Rows that repeat an id share its shard
    and have slots of their own; the rows of one very frequent id are dealt to several ranges. An empty table gives an empty result.
    """
    tree = tree or regular_tree()
    return settle(df.sparkSession, "shards", lambda: _slotted(df, tree, id_col, text_col))


def _slotted(df: DataFrame, tree: Tree, id_col: str, text_col: str) -> DataFrame:
    rows = inputs(df, doc_id=id_col, text=text_col)
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    thin = rows.select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    thin = with_shard(with_shard(thin, "doc_id", tree, "shard"), "doc_id", grown(tree), "grown_shard")
    thin = thin.withColumns(
        {
            "mix": F.xxhash64("doc_id"),
            "place": F.monotonically_increasing_id(),
            "one": F.lit(1).cast("bigint"),
        }
    )
    order = ["shard", "mix", "doc_id", "text_crc32", "size", "place"]
    ranged = deal_ranges(stage(thin, "shard-rows"), order, "shard-ranges")
    totals = range_totals(ranged, "shard", rows="one").select("shard", "range_id", "rows_before")
    numbered = sum_within(ranged, "shard", order[1:], "one").join(stage(totals, "shard-totals"), ["shard", "range_id"])
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("rows_before") + F.col("within")).alias("slot"),
        "grown_shard",
    )
