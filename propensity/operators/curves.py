"""Areas under many ROC curves at once: folds, models and grid points as keyed rows of one table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COUNTS = "curve int, score double, pos bigint, neg bigint"
RANGES = "part int, curve int, pos bigint, neg bigint, twice_won string"


def collapsed(curve: int, scores: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, ...]:
    """Columns of :data:`COUNTS` of one curve's rows: a row per distinct score."""
    distinct, place = np.unique(scores, return_inverse=True)
    pos = np.bincount(place, positive, len(distinct)).astype(np.int64)
    return np.full(len(distinct), curve, np.int32), distinct, pos, np.bincount(place, minlength=len(distinct)) - pos


def counts_batch(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """An Arrow batch of :data:`COUNTS` from pieces as :func:`collapsed` makes them."""
    columns = [np.concatenate(column) for column in zip(*parts)]
    kinds = [pa.int32(), pa.float64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["curve", "score", "pos", "neg"])


def _won(pos: np.ndarray, worth: np.ndarray) -> int:
    """Exact sum of products, whatever its size."""
    if int(pos.sum()) * int(worth.max(initial=0)) < 1 << 62:
        return int(pos @ worth)
    return sum(a * b for a, b in zip(pos.tolist(), worth.tolist()))


def _sums(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[tuple]:
    """``(part, curve, pos, neg, twice_won)`` of sorted counts; equal scores may be spread over rows and batches."""
    held: tuple[np.ndarray, ...] | None = None  # the last run of equal scores, which the next batch may go on with
    state: list | None = None  # curve, pos, neg, twice_won

    def add(curve, pos, neg):
        nonlocal state
        starts = np.flatnonzero(np.r_[True, curve[1:] != curve[:-1]])
        for start, end in zip(starts, [*starts[1:], len(curve)]):
            if state is None or state[0] != curve[start]:
                if state is not None:
                    yield (part, *state)
                state = [int(curve[start]), 0, 0, 0]
            p, n = pos[start:end], neg[start:end]
            state[3] += _won(p, 2 * (state[2] + n.cumsum() - n) + n)
            state[1] += int(p.sum())
            state[2] += int(n.sum())

    for batch in batches:
        if not batch.num_rows:
            continue
        given = [batch.column(name).to_numpy() for name in ("curve", "score", "pos", "neg")]
        curve, score, pos, neg = given if held is None else [np.concatenate(pair) for pair in zip(held, given)]
        starts = np.flatnonzero(np.r_[True, (curve[1:] != curve[:-1]) | (score[1:] != score[:-1])])
        run_pos, run_neg = np.add.reduceat(pos, starts), np.add.reduceat(neg, starts)
        held = (curve[-1:], score[-1:], run_pos[-1:], run_neg[-1:])
        if len(starts) > 1:
            yield from add(curve[starts[:-1]], run_pos[:-1], run_neg[:-1])
    if held is not None:
        yield from add(held[0], held[2], held[3])
    if state is not None:
        yield (part, *state)


def curve_areas(counts: DataFrame) -> DataFrame:
    """Exact area under ROC of every curve, ties counting half: ``(curve, positives, negatives, auc)``.

    ``counts`` has rows ``(curve, score, pos, neg)``; a score may occur in any number of rows. All curves are range-partitioned together by
    curve and score, so the number of tasks follows from the number of rows, not from that of curves, and a curve may span many tasks. A
    task sums up its ranges; one row per range and curve tells the next level what lies below. Counts are exact
    integers, so the areas do not depend on the partitioning. ``auc`` is NULL where a class is missing; scores that are NULL or NaN are refused.

    Callers collapse equal scores per batch (:func:`collapsed`), so that even a constant score is a row per batch.
    """
    checked = counts.withColumn(
        "score", F.when(F.col("score").isNull() | F.isnan("score"), F.raise_error("a score is missing")).otherwise(F.col("score") + 0.0)
    )

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rows = list(_sums(batches, TaskContext.get().partitionId()))
        columns = zip(*rows) if rows else [[]] * 5
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        made = [[str(v) for v in c] if k == pa.string() else list(c) for c, k in zip(columns, kinds)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds)], names=[f.split()[0] for f in RANGES.split(", ")])

    ordered = checked.select("curve", "score", "pos", "neg").repartitionByRange("curve", "score").sortWithinPartitions("curve", "score")
    ranges = ordered.mapInArrow(sums, RANGES)
    earlier = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(earlier), F.lit(0).cast("bigint"))
    won = F.col("twice_won").cast("decimal(38,0)") + (2 * F.col("pos").cast("decimal(18,0)") * F.col("below").cast("decimal(18,0)")).cast("decimal(38,0)")
    total = ranges.withColumn("below", below).groupBy("curve").agg(
        F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum(won).alias("twice_won")
    )
    pairs = F.col("positives").cast("double") * F.col("negatives").cast("double")
    return total.select("curve", "positives", "negatives", F.when(pairs > 0, F.col("twice_won").cast("double") / (2 * pairs)).alias("auc"))
