"""Connected components by contraction, in a number of rounds that grows with the logarithm of the longest chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensity.llm.common import drop_staged, stage


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` for every node of ``links`` (``a``, ``b``: integers); a component is named by its smallest node.

    In each round every node moves to the neighbour, or itself, whose hash is smallest, and links between nodes that have met
    vanish. By hashes, not ids, at least half of the linked nodes move on average, whatever the shape. Minima are combined before
    the shuffle and staged, so the joins with them can split a node with very many links. Nothing goes to the
    driver but whether links are left. Links of a node with itself are ignored; repeated ones do no harm.
    """
    links = stage(links.select("a", "b").filter("a != b").distinct(), f"{name}-links")
    nodes = links.select("a").union(links.select("b")).distinct()
    places = stage(nodes.select(F.col("a").alias("node"), F.col("a").alias("at")), f"{name}-places")
    while not links.isEmpty():
        both = links.union(links.select("b", "a")).toDF("node", "near")
        nearest = both.groupBy("node").agg(
            F.min_by("near", F.xxhash64("near")).alias("near"), F.min(F.xxhash64("near")).alias("hash")
        )
        moves = nearest.filter(F.col("hash") < F.xxhash64("node")).select(F.col("node").alias("from"), F.col("near").alias("to"))
        moves = stage(moves, f"{name}-moves")

        def moved(df: DataFrame, column: str, moves: DataFrame = moves) -> DataFrame:
            joined = df.join(moves, df[column] == moves["from"], "left")
            return joined.withColumn(column, F.coalesce("to", column)).drop("from", "to")

        old = (links, places, moves)
        links = stage(moved(moved(links, "a"), "b").filter("a != b").distinct(), f"{name}-links")
        places = stage(moved(places, "at"), f"{name}-places")
        for table in old:
            drop_staged(table)
    names = stage(places.groupBy("at").agg(F.min("node").alias("component")), f"{name}-names")
    return stage(places.join(names, "at").select("node", "component"), name)
