"""Near-duplicate vectors: Euclidean p-stable hashing into several tables, then exact cosines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from propensity.llm.common import component_ids, inputs, settle, small_batches, stage, with_class_keys
from propensity.llm.components import connected_components

COSINE = 0.93
#: quantised projections in a key, their width, and tables. Two unit vectors of cosine 0.93 agree in one projection with
#: probability 0.85, so in no table in 1 of 6,000 cases; of cosine 0.96 in 1 of 50 million. Unrelated ones meet in 1 of 900 cases.
HASHES, WIDTH, TABLES = 16, 2.0, 112
#: vectors of a bucket in one block
BLOCK = 512
#: buckets up to this size are compared together
SMALL = 16


def mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def projections(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions and uniform offsets for vectors of a size, always the same."""
    random = np.random.default_rng(size)
    return random.standard_normal((size, TABLES * HASHES)), random.uniform(0, WIDTH, TABLES * HASHES)


def table_keys(units: np.ndarray, label: np.ndarray, drawn: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A key per unit vector and table, from the label, the table and the cells of its projections."""
    directions, offsets = drawn
    keys = np.empty((len(units), TABLES), np.uint64)
    for start in range(0, len(units), 256):  # bounds the memory of the projections
        part = units[start : start + 256]
        cells = np.floor((part @ directions + offsets) / WIDTH).astype(np.int64).view(np.uint64)
        cells = cells.reshape(len(part), TABLES, HASHES)
        own = mix(label[start : start + 256, None] + np.arange(1, TABLES + 1, dtype=np.uint64))
        for i in range(HASHES):
            own = mix(own + cells[:, :, i])
        keys[start : start + 256] = own
    return keys.view(np.int64)


def usable(vector) -> np.ndarray | None:
    """The vector in double precision, or None if it is missing, zero, or holds a missing or infinite component."""
    if vector is None or len(vector) == 0:
        return None
    values = np.array([np.nan if x is None else x for x in vector] if None in vector else vector, np.float64)
    return values if np.isfinite(values).all() and values.any() else None


def to_units(values: np.ndarray) -> np.ndarray:
    """Scaled to length 1; by the largest component first, so that no square overflows or vanishes."""
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def roots_of(linked: np.ndarray) -> np.ndarray:
    """Smallest index in the component of each row of a symmetric matrix of links."""
    names = np.arange(len(linked))
    while True:
        lowest = np.minimum(names, np.where(linked, names[None, :], len(names)).min(axis=1))
        lowest = lowest[lowest]
        if (lowest == names).all():
            return names
        names = lowest


class _Blocks:
    """Links within blocks of buckets; each pair is counted in the first table that both share only."""

    def __init__(self, cosine: float, kind: type):
        self.cosine, self.kind = cosine, kind
        self.drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def keys(self, units: np.ndarray, label: np.ndarray) -> np.ndarray:
        size = units.shape[1]
        if size not in self.drawn:
            self.drawn[size] = projections(size)
        return table_keys(units, label, self.drawn[size])

    def link(self, rows: pd.DataFrame) -> pd.DataFrame:
        """``rows`` holds whole units, sorted. Returns links per member of a unit, and the member its local component is named by."""
        out = []
        lengths = rows["data"].str.len().to_numpy()
        for length in np.unique(lengths):
            part = rows[lengths == length]
            values = np.frombuffer(b"".join(part["data"]), self.kind).reshape(len(part), -1).astype(np.float64)
            out += self._link_equal(part, to_units(values))
        return pd.DataFrame(
            {
                "rep": np.concatenate([x[0] for x in out]) if out else np.empty(0, np.int64),
                "links": np.concatenate([x[1] for x in out]) if out else np.empty(0, np.int64),
                "root": np.concatenate([x[2] for x in out]) if out else np.empty(0, np.int64),
            }
        )

    def _link_equal(self, rows: pd.DataFrame, units: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        key, first, second = (rows[c].to_numpy() for c in ("key", "first", "second"))
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        starts = np.flatnonzero(new)
        sizes = np.diff(np.concatenate((starts, [len(rows)])))
        group = np.repeat(np.arange(len(starts)), sizes)
        label = rows["label_hash"].to_numpy().view(np.uint64)
        rep, copies, block = (rows[c].to_numpy() for c in ("rep", "copies", "block"))
        out = []

        def counted(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Whether the table of this bucket is the first in which the pair meets."""
            involved, place = np.unique(np.concatenate((i, j)), return_inverse=True)
            keys = self.keys(units[involved], label[involved])
            result = np.empty(len(i), bool)
            for start in range(0, len(i), 4096):
                end = min(start + 4096, len(i))
                one, other = keys[place[start:end]], keys[place[len(i) + start : len(i) + end]]
                table = (one == other).argmax(axis=1)
                result[start:end] = one[np.arange(end - start), table] == key[i[start:end]]
            return result

        small = sizes[group] <= SMALL
        pairs = []
        for apart in range(1, SMALL):
            i = np.flatnonzero((group[:-apart] == group[apart:]) & small[:-apart]) if len(rows) > apart else np.empty(0, int)
            if not len(i):
                break
            j = i + apart
            near = (np.einsum("ij,ij->i", units[i], units[j]) >= self.cosine) & (label[i] == label[j])
            pairs.append(np.stack((i[near], j[near])))
        if pairs:
            i, j = np.concatenate(pairs, axis=1)
            own = counted(i, j) if len(i) else np.empty(0, bool)
            i, j = i[own], j[own]
            # a small bucket has few links: each is a root of its own
            out += [(rep[i], copies[j], rep[j]), (rep[j], copies[i], rep[i])]
        for start, size in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            own = slice(start, start + size)
            alike = (units[own] @ units[own].T >= self.cosine) & (label[own][:, None] == label[own][None, :])
            if first[start] != second[start]:
                alike &= block[own][:, None] != block[own][None, :]
            i, j = np.nonzero(np.triu(alike, 1))
            if not len(i):
                continue
            mine = counted(i + start, j + start)
            linked = np.zeros((size, size), bool)
            linked[i[mine], j[mine]] = True
            linked |= linked.T
            links = linked @ copies[own]
            kept = links > 0
            out.append((rep[own][kept], links[kept], rep[own][roots_of(linked)][kept]))
        return out


def _hash_task(kind: type):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest, xxh3_128_digest

        blocks = _Blocks(0.0, kind)
        for whole in batches:
            for start in range(0, len(whole), 512):
                batch = whole.iloc[start : start + 512]
                vectors = [usable(v) for v in batch["vector"]]
                keys: list = [None] * len(batch)
                data: list = [None] * len(batch)
                labels = np.array([xxh3_64_intdigest(x) if x is not None else 0 for x in batch["label"]], np.uint64)
                sizes = [0 if v is None or x is None else len(v) for v, x in zip(vectors, batch["label"])]
                for size in set(sizes) - {0}:
                    at = np.flatnonzero(np.array(sizes) == size)
                    values = np.stack([vectors[i] for i in at])
                    for i, value, found in zip(at, values.astype(kind), blocks.keys(to_units(values), labels[at])):
                        keys[i], data[i] = found, value.tobytes()
                digests = [None if d is None else xxh3_128_digest(d + label) for d, label in zip(data, labels.astype("<u8").view("V8").tolist())]
                yield pd.DataFrame(
                    {
                        "vec_id": batch["vec_id"].to_numpy(),
                        "label_hash": labels.view(np.int64),
                        "vector_key": digests,
                        "data": data,
                        "keys": keys,
                    }
                )

    return run


def _whole_units(blocks_of, columns: list[str]):
    """A ``mapInPandas`` function that hands on whole units of sorted rows, however batches cut them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = blocks_of()
        waiting = []
        for batch in batches:
            if not len(batch):
                continue
            last = batch[columns].iloc[-1]
            open_rows = (batch[columns] == last).all(axis=1).to_numpy()
            cut = len(batch) - int(open_rows[::-1].argmin()) if not open_rows.all() else 0
            if cut:
                yield blocks.link(pd.concat([*waiting, batch.iloc[:cut]], ignore_index=True))
                waiting = [batch.iloc[cut:]]
            elif waiting and not (waiting[-1][columns].iloc[-1] == last).all():
                yield blocks.link(pd.concat(waiting, ignore_index=True))
                waiting = [batch]
            else:
                waiting.append(batch)
        if waiting:
            yield blocks.link(pd.concat(waiting, ignore_index=True))

    return run


def near_duplicate_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
) -> DataFrame:
    """Links between vectors of equal label with a cosine of at least ``cosine``, and their components.

    Returns one row per input row: ``vec_id``, ``n_links`` (other vectors linked directly), ``component_id`` (smallest id reachable), ``kept``.

    Unit vectors are hashed into ``TABLES`` tables. Keys that occur once are counted away before any vector moves. Equal vectors are one class with
    a number of copies. A bucket is compared as a whole; a large one is cut into blocks, and each pair of blocks is compared by itself,
    so no task holds more than two blocks. Compared pairs stay in the task: it returns the number of links per vector and a forest
    of them. A pair that meets in several tables counts in the first. The tables lose a link of cosine 0.93 in 1 of 6,000 cases and
    practically none of cosine 0.95 or more; nothing below ``cosine`` is linked.

    Vectors that are NULL, empty, zero, or hold a NULL or non-finite component link with nothing, nor do those with a NULL label or
    a NULL id, or of different lengths. Rows that repeat an id are vectors of their own. A ``cosine`` below 0.93 is refused, as
    the tables would lose links. An empty table gives an empty result.
    """
    options = (id_col, vector_col, label_col, cosine)
    return settle(df.sparkSession, "near-vectors", lambda: _linked_vectors(df, *options))


def _linked_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str, cosine: float) -> DataFrame:
    if cosine < COSINE:
        raise ValueError(f"tables are made for a cosine of {COSINE} or more, and would lose links at {cosine}")
    rows = inputs(df, vec_id=id_col, vector=vector_col, label=label_col)
    single = isinstance(rows.schema["vector"].dataType, ArrayType) and isinstance(
        rows.schema["vector"].dataType.elementType, FloatType
    )
    kind = np.float32 if single else np.float64
    rows = rows.select(F.col("vec_id").cast("bigint"), "vector", F.col("label").cast("string"))
    known = rows.filter("vec_id is not null")
    hashed = small_batches(known).mapInPandas(
        _hash_task(kind),
        "vec_id bigint, label_hash bigint, vector_key binary, data binary, keys array<bigint>",
    )
    hashed = stage(hashed, "vector-hashes")
    linkable = hashed.filter("vector_key is not null")
    classes = linkable.groupBy("vector_key").agg(
        F.min("vec_id").alias("vec_id"),
        F.count(F.lit(1)).alias("copies"),
        F.first("label_hash").alias("label_hash"),
        F.first("data").alias("data"),
        F.first("keys").alias("keys"),
    )
    classes = with_class_keys(stage(classes, "vector-classes"), "vector_key")

    banded = classes.select("vector_key", F.explode("keys").alias("key"))
    shared = stage(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "vector-shared")
    members = banded.join(shared, "key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    members = members.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("vector_key"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = members.select(
        "key",
        F.least("block", "other").alias("first"),
        F.greatest("block", "other").alias("second"),
        "block",
        "vector_key",
    )
    full = stage(units, "vector-units").join(classes.drop("keys", "vec_id"), "vector_key").drop("vector_key")
    unit = ["key", "first", "second"]
    found = (
        small_batches(full)
        .repartition(*unit)
        .sortWithinPartitions(*unit, "rep")
        .mapInPandas(_whole_units(lambda: _Blocks(cosine, kind), unit), "rep bigint, links bigint, root bigint")
    )
    found = stage(found, "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")), "vector-parts")
    named = (
        classes.select("vector_key", "rep", "vec_id", "copies")
        .join(stage(links, "vector-sums"), "rep", "left")
        .join(component_ids(classes, parts, "vec_id", "vector-lowest"), "rep", "left")
        .select(
            "vector_key",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
    )
    linked = linkable.select("vec_id", "vector_key").join(stage(named, "vector-named"), "vector_key")
    none = F.lit(0).cast("bigint").alias("n_links")
    alone = hashed.filter("vector_key is null").select("vec_id", none, F.col("vec_id").alias("component_id"))
    nameless = rows.filter("vec_id is null").select("vec_id", none, F.col("vec_id").alias("component_id"))
    return (
        linked.select("vec_id", "n_links", "component_id")
        .unionByName(alone)
        .unionByName(nameless)
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
