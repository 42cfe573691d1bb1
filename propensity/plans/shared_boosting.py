"""Boosting over binned rows in flat files: all fits over the same rows grow level by level in passes that they share."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propensity.operators.curves import COUNTS, collapsed, counts_batch
from propensity.plans.shared_trees import SUMS_BYTES, Bins, Routes, Rules, Tree, checked_rows, given_rows, grow, held_bytes, mean, packed, places, routes_of, together
from propensity.session import remove_path, scratch_path

#: rows of a block; rows that a task takes, at least and at most, as far as there are so many blocks
BLOCK_ROWS, LEAST_ROWS, MOST_ROWS = 1 << 16, 1 << 16, 1 << 21
#: weights, weighted values, their squares
STATS = 3
WRITTEN = "path string, start bigint, rows bigint, bad bigint, least double"


class Fit(NamedTuple):
    rules: Rules
    iterations: int
    step: float


class Piece(NamedTuple):
    """A block in a flat file: codes by group, labels and weights from the byte ``start`` on."""

    path: str
    start: int
    rows: int


class Scored(NamedTuple):
    """Trees of a fit and their weights, and the numbers of trees after which rows are scored."""

    trees: list[Tree]
    depth: int
    weights: list[float]
    sizes: list[int]


class Margins(NamedTuple):
    """Margins of some fits: a file per part, in it for each piece the numbers of one fit after the other."""

    folder: str
    fits: tuple[int, ...]
    names: dict[int, str]  # by part, of the attempt that was taken


def _opened(path: str):
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path)
    return pa.memory_map(inside) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(inside)


def _created(folder: str, name: str):
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    return store.open_output_stream(f"{base}/{name}", compression=None)


def _array(file, kind: str, start: int, count: int) -> np.ndarray:
    dtype = np.dtype(kind)
    file.seek(start)
    buffer = file.read_buffer(count * dtype.itemsize)
    if buffer.size != count * dtype.itemsize:
        raise ValueError("a file of staged rows is shorter than its list says")
    return np.frombuffer(buffer, dtype)


def stage_pieces(rows: DataFrame, bins: Bins, features: str, label: str, weight: Column) -> list[Piece]:
    """Write codes, labels and weights to flat files, a file per task, and list their blocks: a row per some ten thousand rows reaches the driver."""
    folder = scratch_path(rows.sparkSession, "boosting-rows")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, written, start = f"rows-{uuid.uuid4().hex}", None, [], 0
        for x, y, w, _ in packed(batches, BLOCK_ROWS):
            found = checked_rows(bins, x, y, w)
            out = out or _created(folder, name)
            values = [found.codes.tobytes(), found.w.tobytes(), found.y.tobytes()]
            for one in values:
                out.write(one)
            written.append({"path": f"{folder}/{name}", "start": start, "rows": len(y), "bad": found.bad, "least": found.least})
            start += sum(map(len, values))
        if out:
            out.close()
            yield pa.RecordBatch.from_pylist(written, pa.schema([("path", pa.string()), ("start", pa.int64()), ("rows", pa.int64()), ("bad", pa.int64()), ("least", pa.float64())]))

    listed = given_rows(rows, features, label, weight).mapInArrow(write, WRITTEN).collect()
    if bad := sum(row["bad"] for row in listed):
        raise ValueError(f"{bad} rows have a weight that is missing, negative or infinite")
    if all(row["least"] is None for row in listed):
        raise ValueError("no row with a weight to fit on")
    return [Piece(row["path"], row["start"], row["rows"]) for row in listed]


def dealt(pieces: list[Piece], cores: int) -> list[list[Piece]]:
    """Pieces in parts of like size, one per task: a few per core, more where a part would exceed ``MOST_ROWS``, fewer where there are few rows."""
    rows = sum(piece.rows for piece in pieces)
    count = max(1, min(len(pieces), max(math.ceil(rows / MOST_ROWS), min(2 * cores, math.ceil(rows / LEAST_ROWS)))))
    parts: list[list[Piece]] = [[] for _ in range(count)]
    sizes = [0] * count
    for piece in sorted(pieces, key=lambda piece: -piece.rows):
        least = sizes.index(min(sizes))
        parts[least].append(piece)
        sizes[least] += piece.rows
    return parts


def residual(y: np.ndarray, margin: np.ndarray | None) -> np.ndarray:
    """What the next tree is fitted to: the label as -1 or 1, then the negative gradient of the logistic loss."""
    signed = y * 2.0
    signed -= 1.0
    if margin is None:
        return signed
    by = signed * 2.0
    by *= margin
    with np.errstate(over="ignore"):
        np.exp(by, out=by)
    by += 1.0
    signed *= 4.0
    signed /= by
    return signed


def add_sums(sums: list[np.ndarray], sizes: list[int], x: np.ndarray, slot: np.ndarray | None, values: list[np.ndarray | None]) -> None:
    """Add values by node and code to the sums of every group of features; a missing value is not summed up, the last sum is that of rows."""
    for total, size, codes in zip(sums, sizes, x):
        index = codes.astype(np.intp)
        if slot is not None:
            index += slot * size
        for s, one in enumerate(values):
            if one is not None:
                total[s] += np.bincount(index, one, total.shape[1])
        if values[0] is not None:
            total[-1] += np.bincount(index, minlength=total.shape[1])


def _pass(bins: Bins, level: int, grown: dict[int, Routes], fits: tuple[int, ...], whole: bool, given: Margins | None, moved: tuple | None):
    """What a task does with its parts: ``(part, name of the margins written, sums of each tree)``.

    ``grown`` holds the trees whose open nodes are counted. With ``moved``, ``(folder, trees, steps)`` by fit, the trees grown last are added to the margins first.
    Weights and rows, which are the same at every root, are summed up only if the pass is ``whole``.
    """
    sizes, valid = bins.sizes, bins.valid()

    def run(parts: Iterator[tuple[int, list[Piece]]]) -> Iterator[tuple]:
        for part, pieces in parts:
            source = _opened(f"{given.folder}/{given.names[part]}") if given else None
            name = f"margins-{part}-{uuid.uuid4().hex}" if moved else ""
            out = _created(moved[0], name) if moved else None
            sums = {k: [np.zeros((STATS + 1, len(routes.features) * size)) for size in sizes] for k, routes in grown.items()}
            before, file, path = 0, None, None
            for piece in pieces:
                if piece.path != path:
                    file, path = _opened(piece.path), piece.path
                x = _array(file, "<u2", piece.start, piece.rows * len(sizes)).reshape(len(sizes), piece.rows)
                at = piece.start + x.nbytes
                w, y = _array(file, "<f8", at, piece.rows), _array(file, "u1", at + 8 * piece.rows, piece.rows)
                for k in fits:
                    margin = None
                    if given:
                        margin = _array(source, "<f8", 8 * (before * len(given.fits) + given.fits.index(k) * piece.rows), piece.rows)
                    if moved:
                        _, last, steps = moved
                        more = steps[k] * last[k].value.take(places(x, last[k], last[k].levels))
                        margin = more if margin is None else margin + more
                        out.write(margin.astype("<f8").tobytes())
                    if k not in grown:
                        continue
                    left, kept, own, slot = residual(y, margin), x, w, None
                    if level:
                        slot = grown[k].slot.take(places(x, grown[k], level))
                        if (slot < 0).any():
                            inside = np.flatnonzero(slot >= 0)
                            slot, kept, own, left = slot.take(inside), x.take(inside, axis=1), w.take(inside), left.take(inside)
                    value = own * left
                    add_sums(sums[k], sizes, kept, slot, [own if whole else None, value, value * left])
                before += piece.rows
            if out:
                out.close()
            found = {k: bins.by_feature(own, len(grown[k].features))[:, :, valid] for k, own in sums.items()}
            yield part, name, found

    return run


def _merged(found: Iterator[tuple]) -> tuple[list[tuple[int, str]], dict[int, np.ndarray]]:
    """Sums of parts, added in the order of parts."""
    names, totals = [], {}
    for part, name, sums in sorted(found, key=lambda one: one[0]):
        names += name if isinstance(name, list) else [(part, name)]
        for k, own in sums.items():
            totals[k] = totals[k] + own if k in totals else own
    return names, totals


def boost(spark: SparkSession, pieces: list[Piece], bins: Bins, fits: list[Fit]) -> list[list[Tree]]:
    """Trees of every fit, one after the other, each fitted to what the ones before leave.

    The trees of one number are grown in the same passes, one per level. The first pass of a tree adds the one before to the margins of the rows, which are
    a file per task and number. A pass has a few tasks per core, and tasks hold a block and the sums at a time, so neither grows with the rows.
    """
    context, every = spark.sparkContext, list(range(len(bins.arities)))
    parts = dealt(pieces, context.defaultParallelism)
    given = context.parallelize(list(enumerate(parts)), len(parts))
    valid, width = bins.valid(), max(bins.arities)
    grown: list[list[Tree]] = [[] for _ in fits]
    margins: Margins | None = None
    root: np.ndarray | None = None

    def sums_of(trees: dict[int, Tree], run) -> tuple[list[tuple[int, str]], dict[int, np.ndarray]]:
        found = given.mapPartitions(run)
        if len(parts) * sum(held_bytes(tree, bins, STATS) for tree in trees.values()) > SUMS_BYTES:
            count = math.isqrt(len(parts))
            grouped = found.map(lambda one: (one[0] % count, one)).groupByKey(count)
            found = grouped.map(lambda own: (own[0], *_merged(own[1])))
        names, totals = _merged(found.collect())
        filled = {}
        for k, own in totals.items():
            filled[k] = np.zeros((*own.shape[:2], len(every), width))
            filled[k][:, :, valid] = own
        return names, filled

    for number in range(max(fit.iterations for fit in fits)):
        active = tuple(k for k, fit in enumerate(fits) if fit.iterations > number)
        trees = {k: Tree(number, lambda: every) for k in active}
        for level in range(max(1, *(fits[k].rules.depth for k in active))):
            open_trees = {k: trees[k] for k in active if trees[k].open and level < max(1, fits[k].rules.depth)}
            for group in [list(open_trees.values())] if level == 0 else together(list(open_trees.values()), bins, STATS):
                own = {k: tree for k, tree in open_trees.items() if any(tree is one for one in group)}
                routes = {k: routes_of(tree, bins) for k, tree in own.items()}
                moved = None
                if level == 0 and number:
                    last = {k: routes_of(grown[k][-1], bins, mean, max(1, fits[k].rules.depth)) for k in active}
                    moved = (scratch_path(spark, "margins"), last, {k: fits[k].step if number > 1 else 1.0 for k in active})
                whole = level > 0 or number == 0
                names, found = sums_of(own, _pass(bins, level, routes, active if moved else tuple(own), whole, margins, moved))
                if moved:
                    if margins:
                        remove_path(spark, margins.folder)
                    margins = Margins(moved[0], active, dict(names))
                if level == 0:
                    root = root if number else next(iter(found.values()))
                for k, tree in own.items():
                    if not whole:
                        found[k][[0, -1]] = root[[0, -1]]
                    grow([tree], [found[k]], bins, fits[k].rules, level)
        for k, tree in trees.items():
            grown[k].append(tree)
    return grown


def scored(rows: DataFrame, bins: Bins, features: str, label: str, runs: list[Scored]) -> DataFrame:
    """Counts of scores (:data:`propensity.operators.curves.COUNTS`) of binned rows from one pass: a curve per run and size, in order.

    A larger ensemble holds each smaller one, so running sums of what the trees say are the scores of all sizes.
    """
    routes = [[routes_of(tree, bins, mean, max(1, run.depth)) for tree in run.trees[: max(run.sizes)]] for run in runs]
    weights, sizes = [run.weights for run in runs], [run.sizes for run in runs]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, y, _, _ in packed(batches, BLOCK_ROWS):
            x, positive, found = bins.codes(values), (y == 1).astype(np.float64), []
            for own, weight, wanted in zip(routes, weights, sizes):
                margin, by_size = np.zeros(len(y)), {}
                for number, tree in enumerate(own):
                    margin = margin + weight[number] * tree.value.take(places(x, tree, tree.levels))
                    if number + 1 in wanted:
                        by_size[number + 1] = margin
                found += [by_size[size] for size in wanted]
            yield counts_batch([collapsed(i, scores, positive) for i, scores in enumerate(found)])

    return given_rows(rows, features, label, F.lit(0.0)).mapInArrow(score, COUNTS)
