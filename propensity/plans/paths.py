"""Logistic regressions along a grid of penalties, all fitted in shared passes over the rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensity.operators.curves import COUNTS, collapsed, counts_batch, curve_areas

#: rows whose second-order terms are held at a time
SLICE = 2048
#: largest change of a standardized coefficient in a step at which a run has converged
TOLERANCE = 1e-8


class Penalty(NamedTuple):
    """As the learner has it: ``strength * (mixing * |b| + (1 - mixing) / 2 * b^2)`` over standardized coefficients."""

    strength: float
    mixing: float


class PathFit(NamedTuple):
    """Per penalty and iteration limit, in the given orders: intercept and coefficients, ``[penalty, limit, 1 + feature]``."""

    parameters: np.ndarray
    passes: int
    converged: np.ndarray


class _Standard(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray  # 0 for a constant feature, whose coefficient is 0
    weights: float


def _standard(rows: DataFrame, features: str, weight: str | None) -> _Standard:
    """Mean and standard deviation, as the learner takes them, and the sum of weights."""
    weighted = F.col(weight).cast("double") if weight else F.lit(1.0)
    total = rows.select(F.sum(weighted)).first()[0]
    if not total:
        raise ValueError("no row with a weight to fit on")
    found = rows.select(Summarizer.metrics("mean", "std").summary(F.col(features), weighted).alias("s")).first()["s"]
    return _Standard(found["mean"].toArray(), found["std"].toArray(), float(total))


def _arrays(rows: DataFrame, features: str, label: str, weight: str | None) -> DataFrame:
    weighted = F.col(weight).cast("double") if weight else F.lit(1.0)
    return rows.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"), weighted.alias("w"))


def _matrix(batch: pa.RecordBatch, column: int) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _derivatives(rows: DataFrame, runs: np.ndarray, standard: _Standard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, gradient and second derivatives of the mean weighted loss at each of ``runs`` (``[run, 1 + feature]``), from one pass.

    A task sums over its rows and returns a number per run and entry, so what is shuffled has the size of the models.
    """
    size = runs.shape[1]
    upper = np.triu_indices(size)
    width = 1 + size + len(upper[0])
    live = standard.scale > 0
    scale = np.where(live, standard.scale, 1.0)

    def derive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(runs), width))
        for batch in batches:
            x, y, w = _matrix(batch, 0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for start in range(0, len(y), SLICE):
                part = slice(start, start + SLICE)
                z = np.where(live, (x[part] - standard.mean) / scale, 0.0)
                z = np.hstack([np.ones((len(z), 1)), z])
                margin = z @ runs.T
                loss = np.logaddexp(0, margin) - y[part, None] * margin
                share = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
                weighted = w[part, None]
                total[:, 0] += (weighted * loss).sum(axis=0)
                total[:, 1 : 1 + size] += (weighted * (share - y[part, None])).T @ z
                total[:, 1 + size :] += (weighted * share * (1 - share)).T @ (z[:, upper[0]] * z[:, upper[1]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], names=["entry", "value"])

    summed = rows.mapInArrow(derive, "entry int, value double").groupBy("entry").agg(F.sum("value").alias("value")).toArrow()
    found = np.zeros(len(runs) * width)
    found[summed.column("entry").to_numpy()] = summed.column("value").to_numpy()
    found = found.reshape(len(runs), width) / standard.weights
    second = np.zeros((len(runs), size, size))
    second[:, upper[0], upper[1]] = found[:, 1 + size :]
    second[:, upper[1], upper[0]] = found[:, 1 + size :]
    return found[:, 0], found[:, 1 : 1 + size], second


def _steps(at: np.ndarray, gradient: np.ndarray, second: np.ndarray, ridge: np.ndarray, lasso: np.ndarray) -> np.ndarray:
    """Minimizer of each run's quadratic model plus penalties, by coordinate descent over all runs at once.

    Index 0, the intercept, is free of penalties. The numbers are those of the models, not of rows.
    """
    free = np.ones(at.shape[1])
    free[0] = 0.0
    found = at.copy()
    smooth = lasso == 0
    for i in np.flatnonzero(smooth):
        system = second[i] + np.diag(ridge[i] * free)
        change = np.linalg.lstsq(system, -(gradient[i] + ridge[i] * free * at[i]), rcond=1e-12)[0]
        found[i] = at[i] + change
    bent = np.flatnonzero(~smooth)
    if len(bent):
        value, slope, curve = found[bent], gradient[bent].copy(), second[bent]
        for _ in range(10_000):
            largest = 0.0
            for j in range(at.shape[1]):
                own = curve[:, j, j]
                pull = own * value[:, j] - slope[:, j]
                shrunk = np.sign(pull) * np.maximum(np.abs(pull) - lasso[bent] * free[j], 0)
                below = own + ridge[bent] * free[j]
                new = np.divide(shrunk, below, out=np.zeros_like(shrunk), where=below > 0)
                change = new - value[:, j]
                slope += curve[:, :, j] * change[:, None]
                value[:, j] = new
                largest = max(largest, np.abs(change).max())
            if largest < TOLERANCE / 100:
                break
        found[bent] = value
    return found


def _penalty(at: np.ndarray, ridge: np.ndarray, lasso: np.ndarray) -> np.ndarray:
    return lasso * np.abs(at[:, 1:]).sum(axis=1) + ridge / 2 * (at[:, 1:] ** 2).sum(axis=1)


def fit_paths(
    rows: DataFrame,
    penalties: list[Penalty],
    limits: list[int],
    features: str = "features",
    label: str = "label",
    weight: str | None = None,
) -> PathFit:
    """Weighted logistic regressions for all ``penalties``, with features standardized as the learner does it.

    Every pass over the rows yields loss, gradient and second derivatives at the current coefficients of all runs that are not done. From these each
    run takes a Newton step, by coordinate descent where the penalty has a corner, halved while it does not lower the penalized loss. A
    run needs some 5 to 10 passes whatever its penalty, and the runs share them; it ends when no standardized coefficient moves by more than
    ``TOLERANCE``. A limit holds the iterate after so many steps, the last one for all limits beyond the end.

    Rows need weights that are not negative and not all 0. A constant feature, and one that the penalty holds down, has the coefficient 0.
    """
    standard = _standard(rows, features, weight)
    arrays = _arrays(rows, features, label, weight)
    size = 1 + len(standard.mean)
    ridge = np.array([p.strength * (1 - p.mixing) for p in penalties])
    lasso = np.array([p.strength * p.mixing for p in penalties])
    at = np.zeros((len(penalties), size))
    trial, bound = at.copy(), np.full(len(penalties), np.inf)
    ends = np.full((len(penalties), len(limits), size), np.nan)
    done = np.zeros(len(penalties), bool)
    converged = np.zeros(len(penalties), bool)
    steps = np.zeros(len(penalties), int)
    passes = 0
    while not done.all():
        runs = np.flatnonzero(~done)
        loss, gradient, second = _derivatives(arrays, trial[runs], standard)
        passes += 1
        value = loss + _penalty(trial[runs], ridge[runs], lasso[runs])
        accepted = ~(value > bound[runs] + 1e-12 * np.abs(bound[runs]))
        back = runs[~accepted]
        trial[back] = (at[back] + trial[back]) / 2
        ok = runs[accepted]
        moved = np.abs(trial[ok] - at[ok]).max(axis=1)
        first = np.isinf(bound[ok])
        at[ok], bound[ok] = trial[ok], value[accepted]
        steps[ok] += ~first
        for i, limit in enumerate(limits):
            reached = ok[steps[ok] == limit]
            ends[reached, i] = at[reached]
        trial[ok] = _steps(at[ok], gradient[accepted], second[accepted], ridge[ok], lasso[ok])
        still = ~first & (moved < TOLERANCE)
        converged[ok[still]] = True
        done[ok[still]] = True
        stuck = back[np.abs(trial[back] - at[back]).max(axis=1) < TOLERANCE / 100] if len(back) else back
        converged[stuck] = done[stuck] = True
        done[steps >= max(limits)] = True
    ends = np.where(np.isnan(ends), at[:, None, :], ends)
    slope = np.divide(ends[:, :, 1:], standard.scale, out=np.zeros_like(ends[:, :, 1:]), where=standard.scale > 0)
    intercept = ends[:, :, :1] - (slope * standard.mean).sum(axis=2, keepdims=True)
    return PathFit(np.concatenate([intercept, slope], axis=2), passes, converged)


def linear_areas(rows: DataFrame, parameters: np.ndarray, features: str = "features", label: str = "label") -> np.ndarray:
    """Exact area under ROC of each of many linear models (``[model, 1 + feature]``), from one scan of the rows."""
    wanted, number = np.unique(parameters, axis=0, return_inverse=True)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                margins = _matrix(batch, 0) @ wanted[:, 1:].T + wanted[:, 0]
                positive = (batch.column(1).to_numpy() == 1).astype(np.float64)
                yield counts_batch([collapsed(i, margins[:, i], positive) for i in range(len(wanted))])

    counts = _arrays(rows, features, label, None).select("x", "y").mapInArrow(score, COUNTS)
    areas = {row["curve"]: row["auc"] for row in curve_areas(counts).collect()}  # a row per model
    if len(areas) < len(wanted) or None in areas.values():
        raise ValueError("a fold has rows of one class only")
    return np.array([areas[i] for i in number.ravel()])
