"""Mixing sources to target weights: an exact cut through a random order of each source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propensity.llm.common import WORD, inputs, placed, position, settle, small_batches, stage
from propensity.llm.ranges import deal_ranges, range_totals, sum_within

#: relative weights of the sources in code point order, repeated as often as needed
WEIGHTS = (5, 2, 1)
LIMIT = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Words of a text, NULL as none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(key: Column) -> Column:
    """The hash-random key that orders the documents of a source."""
    return F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """Adds ``target`` to one row per source (``source``, ``source_size``).

    The total of all sizes is shared by weight; no target exceeds ``limit`` times its source's size, and what a source cannot
    take is shared again among the others. In the order of limit per weight the sources that end at their limit come
    first, so running sums find them in one step. The input is one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1
    weighted = sizes.withColumns(
        {
            "weight": F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn),
            "most": (F.col("source_size") * limit).cast("double"),
        }
    )
    filling = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    ahead = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = weighted.withColumns(
        {
            "left_over": F.sum("source_size").over(everything).cast("double")
            - F.coalesce(F.sum("most").over(before), F.lit(0.0)),
            "weight_left": F.sum("weight").over(ahead),
            "step": F.row_number().over(filling),
        }
    )
    full = F.col("left_over") * F.col("weight") / F.col("weight_left") >= F.col("most")
    shared = shared.withColumn("full", full)
    # the first source that is not full fixes the share of all from there on
    first = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rest = F.first(F.when(~F.col("full"), F.struct("left_over", "weight_left", "step")), ignorenulls=True).over(first)
    shared = shared.withColumn("rest", rest)
    is_full = F.col("rest").isNull() | (F.col("step") < F.col("rest.step"))
    share = F.col("rest.left_over") * F.col("weight") / F.col("rest.weight_left")
    return shared.select("source", "source_size", F.when(is_full, F.col("most")).otherwise(share).alias("target"))


def mix_plan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    limit: int = LIMIT,
) -> tuple[DataFrame, DataFrame]:
    """The words that the mix takes of each source, and the sized documents it was made from.

    Returns ``(plan, rows)``. ``plan`` has one row per source: ``source``, ``source_size``, ``target``, ``epochs`` (times that every
    document is taken), and the cut of the last, partial epoch: documents ordered before (``cut_key``, ``cut_id``, ``cut_size``) are taken once
    more, and of those at the cut ``cut_words`` words each. ``rows`` holds ``doc_id, source, size, key`` of each document, staged.

    Documents of a source are ordered by a hash of their id. Ranges of (source, hash) carry sums of sizes; the one
    range of each source that holds the cut is summed up row by row. So a source may be any part of
    the table, and only sources, ranges and one range per source are ever together. The whole depends on ids and
    sizes alone, not on the layout.
    """
    rows = inputs(df, doc_id=id_col, text=text_col, source=source_col)
    sized = rows.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(F.col("doc_id")).alias("key"))
    sized = stage(sized, "mix-rows")
    return settle(df.sparkSession, "mix-plan", lambda: _planned(sized, weights, limit)), sized


def _planned(sized: DataFrame, weights: tuple[float, ...], limit: int) -> DataFrame:
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stage(source_targets(sizes, weights, limit), "mix-targets")
    budget = F.round("target").cast("bigint")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    budgets = targets.withColumns({"epochs": whole, "part": budget - whole * F.col("source_size")})

    # NULL sources are a source too: joins below need a key that is never NULL
    named = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    order = ["named", "key", "doc_id", "size"]
    keyed = sized.withColumn("named", named).filter(F.col("size") > 0)
    ranged = deal_ranges(keyed.groupBy(*order).agg(F.count(F.lit(1)).alias("rows")), order, "mix-ranges")
    ranged = ranged.withColumn("words", F.col("size") * F.col("rows"))
    parts = budgets.select(named.alias("named"), "part")
    cut_ranges = (
        range_totals(ranged, "named", words="words")
        .join(parts, "named")
        .filter((F.col("words_before") <= F.col("part")) & (F.col("part") < F.col("words_before") + F.col("words")))
        .select("named", "range_id", (F.col("part") - F.col("words_before")).alias("open"))
    )
    inside = sum_within(
        ranged.join(stage(cut_ranges, "mix-cuts"), ["named", "range_id"]), "named", order[1:], "words"
    )
    cuts = inside.filter((F.col("within") <= F.col("open")) & (F.col("open") < F.col("within") + F.col("words"))).select(
        "named",
        F.col("key").alias("cut_key"),
        F.col("doc_id").alias("cut_id"),
        F.col("size").alias("cut_size"),
        F.floor((F.col("open") - F.col("within")) / F.col("rows")).cast("bigint").alias("cut_words"),
    )
    plan = budgets.withColumn("named", named).join(cuts, "named", "left")
    return plan.select("source", "source_size", "target", "epochs", "cut_key", "cut_id", "cut_size", "cut_words")


def _placed(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with the plan of their source and ``place``: 1 before the cut, 2 at the cut, 0 behind it.

    Rows of one key have one id, so only among those does the size matter: it is looked at last.
    """
    told = rows.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left")
    place = (
        F.when(F.col("cut_key").isNull() | (F.col("key") > F.col("cut_key")), F.lit(0))
        .when(F.col("key") < F.col("cut_key"), F.lit(1))
        .when(F.col("size") < F.col("cut_size"), F.lit(1))
        .when(F.col("size") == F.col("cut_size"), F.lit(2))
        .otherwise(F.lit(0))
    )
    return told.withColumn("place", place)


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    limit: int = LIMIT,
) -> DataFrame:
    """Words taken of each document so that the sources reach their targets.

    Returns one row per input row: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``. The sum of ``taken`` over a source is its
    target, rounded; no document is taken more than ``limit`` times.

    NULL and empty texts have size 0 and take nothing. The NULL source is the last one. Rows that repeat id and size
    share the words at the cut equally, rounded down. Sources of size 0 have the target 0. An empty table gives an empty result.
    """
    plan, rows = mix_plan(df, id_col, text_col, source_col, weights, limit)
    extra = F.when(F.col("place") == 1, F.col("size")).when(F.col("place") == 2, F.col("cut_words")).otherwise(F.lit(0))
    return _placed(rows, plan).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + extra).alias("taken"),
    )


def _cut_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import re

    word = re.compile(WORD)
    for batch in batches:
        texts = []
        for text, words in zip(batch["_text"], batch["_words"]):
            end = 0
            for i, match in enumerate(word.finditer(text)):
                if i == words:
                    break
                end = match.end()
            texts.append(text[:end])
        batch["_text"] = texts
        yield batch


def apply_mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS,
    limit: int = LIMIT,
) -> DataFrame:
    """The mix itself: ``df`` with every row as often as the mix takes it; all columns stay.

    The document at a source's cut is taken in part: its last copy ends with the last word that the budget pays for. Documents
    without words take no share, and are left out. Only the plan, one row per source, is joined with the texts.
    """
    plan, _ = mix_plan(df, id_col, text_col, source_col, weights, limit)
    rows = placed(df)
    columns = rows.columns
    at = {name: columns[position(df, old)] for name, old in (("doc_id", id_col), ("text", text_col), ("source", source_col))}
    working = rows.withColumns(
        {
            "doc_id": F.col(at["doc_id"]),
            "source": F.col(at["source"]),
            "size": word_count(F.col(at["text"])),
            "key": draw(F.col(at["doc_id"])),
        }
    )
    decided = _placed(working, plan)
    # the words of a text are counted at the cut only; whether it has any shows at its first one
    copies = F.col("epochs") + F.when(F.col("place") == 1, 1).otherwise(0)
    full = decided.filter((copies > 0) & F.col(at["text"]).rlike(WORD))
    full = full.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies))).select(*columns)
    cut = decided.filter((F.col("place") == 2) & (F.col("cut_words") > 0))
    cut = cut.select(*columns, F.col(at["text"]).alias("_text"), F.col("cut_words").alias("_words"))
    cut = small_batches(cut).mapInPandas(_cut_texts, cut.schema).select(
        *(F.col("_text").alias(c) if c == at["text"] else F.col(c) for c in columns)
    )
    return full.unionByName(cut).toDF(*df.columns)
