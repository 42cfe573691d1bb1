"""Centroid clustering over a vector-approximation file: few-bit cells decide, full vectors are fetched where they cannot."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from propensity.llm.common import inputs, settle, stage
from propensity.llm.flat_files import FlatFile, FlatWriter
from propensity.session import scratch_path

CLUSTERS, ROUNDS, COMPONENTS, SCALE, SEED = 8, 10, 64, 1024, "3"
#: bits of a cell, and vectors (those with the smallest seeded hashes) whose quantiles bound the cells
BITS, SAMPLE = 8, 4096
#: clusters at most, so that the interval tables of a task stay below 100 MB
MOST_CLUSTERS = 512
#: components beyond this many units are refused: squared distances stay below 2^63
LARGEST = 1 << 27
#: vectors in one step of a task, and unneeded vectors that are read over rather than skipped
STEP, GAP = 4096, 32

#: places of the counters among the component sums of a round
COUNT, FETCHED = -1, -2


class Clustering(NamedTuple):
    """``assigned`` has a row per vector; ``fetched`` tells how many full vectors each round read."""

    assigned: DataFrame
    centroids: list[list[int]]
    fetched: list[int]


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, components: int, scale: int) -> DataFrame:
    """``(vec_id, v)`` of the usable vectors: components as ``floor(scale * x)``."""
    rows = inputs(df, vec_id=id_col, vector=vector_col)
    unit = F.lit(float(scale))

    def fits(x):
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * unit) < LARGEST)

    usable = (F.size("vector") == components) & F.forall("vector", fits)
    return rows.filter(usable).select(
        "vec_id", F.transform("vector", lambda x: F.floor(x.cast("double") * unit).cast("int")).alias("v")
    )


def matrix(column: pa.Array, components: int) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, components).astype(np.int64)


def cell_edges(sample: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> np.ndarray:
    """Lower ends of the cells per component, and one past the highest value: quantiles of the sample between the exact extremes."""
    inner = np.floor(np.quantile(sample, np.arange(1, 1 << bits) / (1 << bits), axis=0)).astype(np.int64).T
    return np.hstack([low[:, None], np.clip(inner, low[:, None], high[:, None]), high[:, None] + 1])


def cells_of(vectors: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The cell of every component, a byte each."""
    return np.stack([np.searchsorted(e[1:-1], x, "right") for e, x in zip(edges, vectors.T)], axis=1).astype(np.uint8)


def interval_tables(edges: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``[component, cell, centroid]``: the least and the largest squared difference of a value in the cell from the centroid."""
    first, last = edges[:, :-1, None], edges[:, 1:, None] - 1
    at = centroids.T[:, None, :]
    nearest = np.maximum(np.maximum(first - at, at - last), 0)
    farthest = np.maximum(np.abs(first - at), np.abs(last - at))
    return nearest * nearest, farthest * farthest


class Cells(NamedTuple):
    """Tables for one set of centroids. Two differences of squares part a pair of centroids at a point ``x`` by a number that is linear in
    ``x``: so the ends of a cell bound it as well, and far more tightly than the distances themselves."""

    nearest: np.ndarray  # [component, cell, centroid], as farthest
    farthest: np.ndarray
    ends: np.ndarray  # [component, cell]: sum of both ends
    width: np.ndarray
    centroids: np.ndarray

    @classmethod
    def of(cls, edges: np.ndarray, centroids: np.ndarray) -> Cells:
        first, last = edges[:, :-1], edges[:, 1:] - 1
        return cls(*interval_tables(edges, centroids), first + last, last - first, centroids)

    def decide(self, cells: np.ndarray) -> np.ndarray:
        """The nearest centroid where the cells leave no doubt, ties included, else -1.

        First by distance intervals, one per centroid; where these overlap, by the intervals of the differences between the most
        likely centroid and every other.
        """
        low, high = (np.zeros((len(cells), len(self.centroids)), np.int64) for _ in range(2))
        for component in range(cells.shape[1]):
            low += self.nearest[component][cells[:, component]]
            high += self.farthest[component][cells[:, component]]
        number = np.arange(low.shape[1])
        best = high.argmin(axis=1)
        bound = high[np.arange(len(high)), best][:, None]
        sure = (low > bound) | ((low == bound) & (number > best[:, None])) | (number == best[:, None])
        found = np.where(sure.all(axis=1), best, -1)
        likely = (low + high).argmin(axis=1)
        component = np.arange(cells.shape[1])
        squares = (self.centroids**2).sum(axis=1)
        for centroid in np.unique(likely[found < 0]):
            rows = np.flatnonzero((found < 0) & (likely == centroid))
            apart = (self.centroids - self.centroids[centroid]).T
            own = cells[rows]
            ends, width = self.ends[component, own], self.width[component, own]
            most = ends @ apart + width @ np.abs(apart) - (squares - squares[centroid])
            nearer = (most < 0) | ((most == 0) & (number > centroid)) | (number == centroid)
            found[rows[nearer.all(axis=1)]] = centroid
        return found


def distances(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of vectors to centroids, in integers."""
    return np.stack([((vectors - centroid) ** 2).sum(axis=1) for centroid in centroids], axis=1)


class _Fetcher:
    """Full vectors by file and place; near ones are read in one go."""

    def __init__(self, components: int):
        self.components, self.files = components, {}

    def __call__(self, stems: list[str], slots: np.ndarray) -> np.ndarray:
        found = np.empty((len(slots), self.components), np.int64)
        names, of = np.unique(np.array(stems, object), return_inverse=True)
        for i, stem in enumerate(names):
            rows = np.flatnonzero(of == i)
            rows = rows[slots[rows].argsort()]
            for run in np.split(rows, np.flatnonzero(np.diff(slots[rows]) > GAP) + 1):
                first, count = int(slots[run[0]]), int(slots[run[-1]] - slots[run[0]] + 1)
                if stem not in self.files:
                    self.files[stem] = FlatFile(f"{stem}.vec")
                read = self.files[stem].array("<i4", first * self.components, count * self.components)
                found[run] = read.reshape(count, -1)[slots[run] - first]
        return found

    def close(self) -> None:
        for one in self.files.values():
            one.close()


def write_index(vectors: DataFrame, folder: str, edges: np.ndarray) -> DataFrame:
    """The vector-approximation file: ``(vec_id, stem, slot, cells)``, staged; full vectors go to flat files of 32-bit integers.

    A task writes one flat file; files of failed attempts have other names and are in no row.
    """
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, stem string, slot bigint, cells binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    components = len(edges)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, slot = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or FlatWriter(folder, "vectors", ("vec",))
            values = matrix(batch.column(1), components)
            out.append("vec", values.astype("<i4"))
            cells = [row.tobytes() for row in cells_of(values, edges)]
            stem, slots = f"{folder}/{out.stem}", np.arange(slot, slot + len(values))
            columns = [batch.column(0), pa.array([stem] * len(values)), pa.array(slots), pa.array(cells, pa.binary())]
            slot += len(values)
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        if out is not None:
            out.close()

    return stage(vectors.mapInArrow(write, schema), "vector-cells")


def _steps(batch: pa.RecordBatch, components: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for start in range(0, batch.num_rows, STEP):
        part = batch.slice(start, STEP)
        cells = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.uint8).reshape(-1, components)
        yield part, cells


def _fetch(fetch: _Fetcher, part: pa.RecordBatch, rows: np.ndarray) -> np.ndarray:
    taken = part.take(pa.array(rows))
    return fetch(taken.column("stem").to_pylist(), taken.column("slot").to_numpy())


def _round(index: DataFrame, edges: np.ndarray, old: np.ndarray | None, new: np.ndarray) -> dict[tuple[int, int], int]:
    """What the sums and counts of the clusters change by, from assignments to ``old`` centroids (None: no assignment yet) to ``new`` ones.

    A vector that the cells place in the same cluster both times is passed over. Only the others are fetched: those in doubt, and those
    that move. Nothing is carried from round to round but sums, so a repeated task does no harm.
    """
    components = len(edges)
    tables = [None if given is None else Cells.of(edges, given) for given in (old, new)]

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch, fetched = _Fetcher(components), 0
        sums = np.zeros((len(new), components + 1), np.int64)
        for batch in batches:
            for part, cells in _steps(batch, components):
                known = [np.full(len(cells), -1) if t is None else t.decide(cells) for t in tables]
                rows = np.flatnonzero((known[0] != known[1]) | (known[1] < 0))
                if not len(rows):
                    continue
                vectors = _fetch(fetch, part, rows)
                fetched += len(rows)
                counted = np.hstack([vectors, np.ones((len(rows), 1), np.int64)])
                for given, sign in ((old, -1), (new, 1)):
                    if given is not None:
                        np.add.at(sums, distances(vectors, given).argmin(axis=1), sign * counted)
        fetch.close()
        cluster, place = np.nonzero(sums)
        dim = np.where(place == components, COUNT, place)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*cluster, 0], pa.int32()), pa.array([*dim, FETCHED], pa.int32()), pa.array([*sums[cluster, place], fetched], pa.int64())],
            names=["cluster", "dim", "change"],
        )

    changes = index.select("stem", "slot", "cells").mapInArrow(change, "cluster int, dim int, change bigint")
    summed = changes.groupBy("cluster", "dim").agg(F.sum(F.col("change").cast("decimal(38,0)")).alias("change"))
    return {(row["cluster"], row["dim"]): int(row["change"]) for row in summed.collect()}


def _assign(index: DataFrame, edges: np.ndarray, centroids: np.ndarray) -> DataFrame:
    """``(vec_id, cluster, distance)``; the distance needs every full vector once, the cluster only those in doubt."""
    components, tables = len(edges), Cells.of(edges, centroids)
    kind = index.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance bigint"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetch = _Fetcher(components)
        for batch in batches:
            for part, cells in _steps(batch, components):
                cluster = tables.decide(cells)
                vectors = _fetch(fetch, part, np.arange(len(cells)))
                doubt = np.flatnonzero(cluster < 0)
                if len(doubt):
                    cluster[doubt] = distances(vectors[doubt], centroids).argmin(axis=1)
                distance = ((vectors - centroids[cluster]) ** 2).sum(axis=1)
                columns = [part.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        fetch.close()

    return index.mapInArrow(assign, schema)


def extremes(vectors: DataFrame, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of every component over all vectors; a task contributes a row per component."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                values = matrix(batch.column(0), components)
                low = values.min(axis=0) if low is None else np.minimum(low, values.min(axis=0))
                high = values.max(axis=0) if high is None else np.maximum(high, values.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(components)), pa.array(low), pa.array(high)], names=["dim", "low", "high"])

    found = vectors.select("v").mapInArrow(task, "dim bigint, low bigint, high bigint")
    rows = found.groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim").collect()
    return np.array([r["low"] for r in rows], np.int64), np.array([r["high"] for r in rows], np.int64)


def cluster_vectors(
    df: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
    scale: int = SCALE,
    seed: str = SEED,
    bits: int = BITS,
) -> Clustering:
    """Lloyd's algorithm on integer vectors ``floor(scale * x)``: ``rounds`` assignments and updates, then a last assignment.

    Each of the first rounds reads the few-bit cells of all vectors. Tables give, by component and cell, how far a value of the cell can
    be from each centroid; their sums are intervals of squared distances, and likewise of differences between two of them. Where
    these settle the nearest centroid (ties: the smaller number) and it is the one of the round before, nothing else is read; sums of clusters change only by the vectors that are fetched.
    Cells are bounded by quantiles of ``SAMPLE`` vectors and the exact extremes of all; all arithmetic is exact.

    Start: the vectors with the smallest sha256 of ``seed:vec_id``, NULL ids last, equal ids by their vectors. The columns of ``assigned``: ``vec_id``,
    ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``, ``centroid_sha256``.

    Left out are vectors that are NULL, of another length, or with a component that is NULL, not finite, or beyond ``LARGEST`` units, whose
    squared distances 64 bits cannot hold. Repeated rows and ids count as often as they occur. An empty table has no centroid and gives no row.
    """
    if not 1 <= clusters <= MOST_CLUSTERS or not 1 <= bits <= 8:
        raise ValueError(f"1 to {MOST_CLUSTERS} clusters and 1 to 8 bits, got {clusters} and {bits}")
    spark = df.sparkSession
    vectors = integer_vectors(df, id_col, vector_col, components, scale)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    chosen = vectors.orderBy(digest.asc_nulls_last(), "v").select("v").limit(SAMPLE).collect()
    sample = np.array([row["v"] for row in chosen], np.int64).reshape(-1, components)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not len(sample):
        return Clustering(spark.createDataFrame([], schema), [], [])

    centroids, fetched = sample[:clusters], []

    def build() -> DataFrame:
        nonlocal centroids
        edges = cell_edges(sample, *extremes(vectors, components), bits)
        index = write_index(vectors, scratch_path(spark, "vector-files"), edges)
        old, sums = None, np.zeros((len(centroids), components), object)
        counts = np.zeros(len(centroids), object)
        for _ in range(rounds):
            changes = _round(index, edges, old, centroids)
            fetched.append(changes.pop((0, FETCHED), 0))
            for (cluster, dim), change in changes.items():
                if dim == COUNT:
                    counts[cluster] += change
                else:
                    sums[cluster, dim] += change
            old = centroids
            centroids = np.array([s // n if n else c for s, n, c in zip(sums, counts, old)], np.int64)
            if (centroids == old).all():  # a fixed point: all further rounds repeat it
                break
        return _assign(index, edges, centroids)

    assigned = settle(spark, "clustered", build)
    totals = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    lines = [
        (i, totals[i], sum(totals.values()), hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest())
        for i, centroid in enumerate(centroids)
        if i in totals
    ]
    known = spark.createDataFrame(lines, "number int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    joined = assigned.join(F.broadcast(known), F.col("cluster") == F.col("number")).drop("number")  # a row per cluster
    return Clustering(joined, centroids.tolist(), fetched)
