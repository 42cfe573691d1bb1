"""Near-duplicate texts: fast similarity sketches, banding, and exact verification on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensity.llm.common import (
    as_bytes, component_ids, inputs, settle, small_batches, stage, text_hash, with_class_keys, without_rows,
)
from propensity.llm.components import connected_components

#: words in a shingle, and similarity (in percent) from which texts are linked
SHINGLE, PERCENT = 5, 80
#: bands and coordinates in a band; texts of similarity 0.8 share no band in 1 of 300,000 cases, of 0.85 in 1 of 50 million
BANDS, ROWS = 24, 4
SKETCH = BANDS * ROWS
#: sketch coordinates that two texts must share before their sets are compared: similar texts have fewer in under 1 of 10 million cases
AGREE = 50
#: members of a bucket in one block
BLOCK = 256
#: up to so many members of a block are compared one by one
FEW = 48
#: shingles of a block that are counted at a time
COUNTED = 1 << 19
ID_BUCKETS = 1 << 20
#: words whose hashes a task keeps at a time
WORDS_KEPT = 1 << 17

# ASCII capitals and their small letters.
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


class WordHashes(dict):
    """64-bit hash per word, kept while it is small."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        if len(self) > WORDS_KEPT:
            self.clear()
        value = self[word] = xxh64_intdigest(word)
        return value


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on all."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def seeds() -> np.ndarray:
    return mix(np.arange(1, 2 * SKETCH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_set(text: bytes, width: int, hashes: dict, table: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; of fewer than ``width`` words the whole sequence is the only one."""
    words = np.array(list(map(hashes.__getitem__, text.translate(table).split())), np.uint64)
    if not len(words):
        return words
    taken = min(width, len(words))
    count = len(words) - taken + 1
    folded = words[:count] + np.uint64(taken)
    for i in range(1, taken):
        folded = mix(folded) + words[i : i + count]
    return np.unique(mix(folded))


def sketch(shingles: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Fast similarity sketch of a set that is not empty.

    Round by round every element is thrown into a bin, with a value that rises with the round; a bin keeps its smallest value. It ends with the
    first round that leaves no bin empty. After as many rounds as there are bins, each round fills one bin with the
    smallest of all elements. So every coordinate is filled, and equal coordinates of two sketches are as
    frequent as elements are common, with bounds as for independent ones. Rounds are made several at a time: a round too
    many changes nothing.
    """
    bins = np.full(SKETCH, FULL)
    step = max(1, 1024 // len(shingles))
    low = np.uint64(0xFFFFFFFF)
    for first in range(0, SKETCH, step):
        rounds = np.arange(first, min(first + step, SKETCH))
        thrown = mix(shingles[None, :] ^ seed[rounds, None])
        place = ((thrown >> np.uint64(32)) * np.uint64(SKETCH)) >> np.uint64(32)
        value = (rounds.astype(np.uint64)[:, None] << np.uint64(32)) | (thrown & low)
        np.minimum.at(bins, place.ravel().astype(np.int64), value.ravel())
        if bins.max() != FULL:
            return bins
    for place in np.flatnonzero(bins == FULL):
        thrown = mix(shingles ^ seed[SKETCH + place]) & low
        bins[place] = np.uint64(SKETCH + place) << np.uint64(32) | thrown.min()
    return bins


def band_keys(bins: np.ndarray) -> np.ndarray:
    """One key per band, different for different bands."""
    parts = bins.reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        keys = mix(keys + parts[:, i])
    return keys.view(np.int64)


def short_sketch(bins: np.ndarray) -> bytes:
    """A byte per coordinate: enough to tell most different ones."""
    return (mix(bins) & np.uint64(0xFF)).astype(np.uint8).tobytes()


def is_similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Exact comparison of two sets: 100 * common >= percent * all."""
    small, large = sorted((len(one), len(other)))
    if 100 * small < percent * large:
        return False
    both = np.concatenate((one, other))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(one) + len(other) - common)


SKETCH_SCHEMA = "doc_id bigint, text_hash bigint, n_shingles bigint, set_key binary, bands array<bigint>, short binary"


def _sketch_task(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        hashes, table, seed = WordHashes(), bytes.maketrans(UPPER, LOWER), seeds()
        for batch in batches:
            counts, set_keys, bands, shorts = [], [], [], []
            for value in batch.column("text"):
                shingles = shingle_set(value.as_py(), width, hashes, table)
                counts.append(len(shingles))
                set_keys.append(xxh3_128_digest(shingles.tobytes()))
                bins = sketch(shingles, seed) if len(shingles) else None
                bands.append(None if bins is None else band_keys(bins))
                shorts.append(None if bins is None else short_sketch(bins))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(counts, pa.int64()),
                    pa.array(set_keys, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(shorts, pa.binary()),
                ],
                names=["doc_id", "text_hash", "n_shingles", "set_key", "bands", "short"],
            )

    return run


def _set_task(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = WordHashes(), bytes.maketrans(UPPER, LOWER)
        seen: set[int] = set()  # a class once, however often its row is repeated
        for batch in batches:
            new = {rep: i for i, rep in reversed(list(enumerate(batch.column("rep").to_pylist()))) if rep not in seen}
            seen.update(new)
            sets = [shingle_set(batch.column("text")[i].as_py(), width, hashes, table).tobytes() for i in new.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.int64()), pa.array(sets, pa.binary())], names=["rep", "shingles"])

    return run


def _verify_task(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, other = batch.column("shingles_a"), batch.column("shingles_b")
            linked = [
                is_similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent)
                for x, y in zip(one, other)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return run


def pairs_by_sketch(members: pd.DataFrame, percent: int) -> Iterator[tuple[int, int]]:
    """Pairs whose sketches agree enough to be similar, the most alike first."""
    short = np.stack([np.frombuffer(value, np.uint8) for value in members["short"]])
    count = members["n_shingles"].to_numpy()
    found = []
    for i in range(len(members)):
        agree = (short[i + 1 :] == short[i]).sum(axis=1)
        later = count[i + 1 :]
        near = (agree >= AGREE) & (100 * np.minimum(later, count[i]) >= percent * np.maximum(later, count[i]))
        other = np.flatnonzero(near)
        found.append(np.stack((agree[other], np.full(len(other), i), other + i + 1), axis=1))
    ordered = np.concatenate(found)
    for _, i, j in ordered[np.argsort(-ordered[:, 0], kind="stable")]:
        yield i, j


def pairs_by_counting(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Similar pairs, exactly: common shingles of all pairs at once, as products of incidence matrices.

    Shingles are taken in ranges of their hashes, so that only ``COUNTED`` of them or so are held at a time, however long the texts are.
    """
    size = np.array([len(one) for one in sets], np.float64)
    common = np.zeros((len(sets), len(sets)))
    ranges = int(size.sum()) // COUNTED + 1
    edges = [np.uint64((i << 64) // ranges) for i in range(1, ranges)]
    cuts = [[0, *np.searchsorted(one, edges).tolist(), len(one)] for one in sets]
    for part in range(ranges):
        held = [one[cut[part] : cut[part + 1]] for one, cut in zip(sets, cuts)]
        owner = np.repeat(np.arange(len(sets)), [len(one) for one in held])
        _, place, times = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        shared = times > 1
        kept = shared[place]
        column, owner = (np.cumsum(shared) - 1)[place][kept], owner[kept]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        for start in range(0, int(shared.sum()), 4096):
            low, high = np.searchsorted(column, (start, start + 4096))
            matrix = np.zeros((len(sets), 4096), np.float32)
            matrix[owner[low:high], column[low:high] - start] = 1
            common += matrix @ matrix.T
    linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
    yield from zip(*np.nonzero(np.triu(linked, 1)))


def link_block(members: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links that join different components of one or two blocks of a bucket.

    ``members`` has ``rep``, ``component``, ``n_shingles``, ``short``, ``shingles`` and ``side`` (the block, or -1 if there is one only). Few
    members are compared one by one where their sketches agree, many all at once; pairs within a component, or a block of two, are passed
    over. So links come as a forest, and no pair is left out that could join more.
    """
    sets = [np.frombuffer(value, np.uint64) for value in members["shingles"]]
    rep, component, side = (members[name].to_numpy() for name in ("rep", "component", "side"))
    parent: dict[int, int] = {}

    def root(node: int) -> int:
        while parent.setdefault(node, node) != node:
            parent[node] = parent[parent[node]]
            node = parent[node]
        return node

    few = len(members) <= FEW
    found = []
    for i, j in pairs_by_sketch(members, percent) if few else pairs_by_counting(sets, percent):
        if component[i] == component[j] or (side[i] >= 0 and side[i] == side[j]):
            continue
        one, other = root(int(component[i])), root(int(component[j]))
        if one != other and (not few or is_similar(sets[i], sets[j], percent)):
            parent[one] = other
            found.append((int(rep[i]), int(rep[j])))
    return found


def _with_sets(docs: DataFrame, classes: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """``(rep, shingles)`` of the classes in ``reps``, each from the row that stands for it.

    Hash buckets of those rows' ids and texts, a bounded number, are broadcast first: so other texts are hardly shuffled.
    """
    place = ["doc_id", "text_hash"]
    bucket = F.pmod(F.xxhash64(*place), F.lit(ID_BUCKETS)).cast("int").alias("bucket")
    chosen = stage(classes.select("rep", *place).join(reps, "rep"), "near-chosen")
    wanted = stage(chosen.select(bucket).distinct(), "near-buckets").coalesce(1)
    likely = docs.select("*", bucket).join(F.broadcast(wanted), "bucket", "left_semi").drop("bucket")
    texts = likely.join(chosen, place).select("rep", "text")
    sets = stage(small_batches(texts).mapInArrow(_set_task(width), "rep bigint, shingles binary"), "near-sets")
    if sets.count() > chosen.count():  # rows that repeat id and text, in more than one task
        sets = stage(sets.groupBy("rep").agg(F.first("shingles").alias("shingles")), "near-sets")
    return sets


def _links_with_hubs(members: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Links of bucket members with the two hubs of their bucket, one pair per member and hub."""
    pairs = members.select("rep", F.explode(F.array("hub", "other_hub")).alias("hub")).filter("rep != hub")
    pairs = pairs.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
    pairs = stage(pairs.distinct(), "near-pairs")
    ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "near-ids")
    sets = _with_sets(docs, classes, ids, width)
    both = pairs.join(sets.toDF("a", "shingles_a"), "a").join(sets.toDF("b", "shingles_b"), "b")
    both = small_batches(both.select("a", "b", "shingles_a", "shingles_b"))
    return both.mapInArrow(_verify_task(percent), "a bigint, b bigint")


def _links_in_blocks(
    members: DataFrame, classes: DataFrame, parts: DataFrame, docs: DataFrame, width: int, percent: int
) -> DataFrame:
    """Links within buckets whose members, apart from the hubs, are still in several components.

    Large buckets are cut into blocks, the members of the largest component into blocks of their own; each pair of blocks, but for those
    within that component, is compared by itself, so no task holds more than two blocks.
    """
    placed = members.filter("rep != hub and rep != other_hub").join(parts, members["rep"] == parts["node"], "left")
    placed = stage(placed.select("key", "rep", F.coalesce("component", "rep").alias("component")), "near-placed")
    # members of the largest component of a bucket need no comparison with each other
    counts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("members"))
    open_keys = counts.groupBy("key").agg(
        F.count(F.lit(1)).alias("parts"),
        F.max_by("component", "members").alias("main"),
        F.max("members").alias("main_members"),
        F.sum("members").alias("members"),
    )
    open_keys = stage(open_keys.filter("parts > 1"), "near-open")
    left = placed.join(open_keys, "key").withColumns(
        {
            "is_main": F.col("component") == F.col("main"),
            "few": F.ceil((F.col("members") - F.col("main_members")) / BLOCK).cast("int"),
            "many": F.ceil(F.col("main_members") / BLOCK).cast("int"),
        }
    )
    mixed = F.xxhash64("rep")
    own = F.when(F.col("is_main"), F.col("few") + F.pmod(mixed, F.col("many"))).otherwise(F.pmod(mixed, F.col("few")))
    last = F.when(F.col("is_main"), F.col("few")).otherwise(F.col("few") + F.col("many")) - 1
    left = left.withColumn("block", own.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    units = left.select(
        "key",
        F.least("block", "other").alias("first"),
        F.greatest("block", "other").alias("second"),
        "block",
        "rep",
        "component",
    )
    units = stage(units, "near-units")
    sets = _with_sets(docs, classes, stage(units.select("rep").distinct(), "near-ids"), width)
    known = classes.select("rep", "n_shingles", "short").join(sets, "rep")
    full = units.join(stage(known, "near-known"), "rep")

    def link(group: pd.DataFrame) -> pd.DataFrame:
        alone = group["first"].iloc[0] == group["second"].iloc[0]
        group = group.assign(side=-1 if alone else group["block"]).sort_values("rep", kind="stable")
        return pd.DataFrame(link_block(group, percent), columns=["a", "b"]).astype("int64")

    return small_batches(full).groupBy("key", "first", "second").applyInPandas(link, "a bigint, b bigint")


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = SHINGLE,
    percent: int = PERCENT,
) -> DataFrame:
    """Components of documents whose shingle sets have a Jaccard similarity of ``percent`` or more.

    Returns one row per input row: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id reachable through links), ``kept`` (``doc_id`` is that id).

    1. Tasks turn whole texts into shingle sets and those into sketches; texts stay where they are. Equal sets become one class.
    2. Classes that share a band form a bucket. Each member is paired with the two hubs of its bucket, and pairs are verified on full sets: twice as many
       pairs as members, not their square. Links give components.
    3. Only buckets whose members are still in several components are looked at again, block by block, until every pair of
       different components whose sketches agree enough has been compared.

    Words are what stands between ASCII white space, with A-Z in lower case. Of fewer words than a shingle has, the sequence is the only
    shingle; NULL and empty texts and those without a word have no shingle and link with nothing. A NULL id links
    with nothing, has a NULL component, and is kept. A ``percent`` below 80 is refused, as the bands would lose links. Rows that repeat an id are judged by their texts, each by itself. An empty table gives an empty result.
    """
    return _settled(df, id_col, text_col, shingle_words, percent).drop("text_hash")


def _settled(df: DataFrame, *options) -> DataFrame:
    return settle(df.sparkSession, "near-duplicates", lambda: _parted(df, *options))


def _parted(df: DataFrame, id_col: str, text_col: str, shingle_words: int, percent: int) -> DataFrame:
    if percent < PERCENT:
        raise ValueError(f"bands and agreement are made for {PERCENT} percent or more, and would lose links at {percent}")
    docs = inputs(df, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("bigint"), as_bytes(F.col("text")).alias("text"))
    docs = docs.select("doc_id", text_hash(F.col("text")).alias("text_hash"), "text")
    sketches = stage(small_batches(docs).mapInArrow(_sketch_task(shingle_words), SKETCH_SCHEMA), "near-sketches")
    linkable = sketches.filter("n_shingles > 0 and doc_id is not null")
    classes = linkable.groupBy("set_key").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands"),
        F.first("short").alias("short"),
    )
    classes = classes.select("set_key", "first.doc_id", "first.text_hash", "n_shingles", "bands", "short")
    classes = with_class_keys(stage(classes, "near-classes"), "set_key")

    banded = classes.select("rep", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min_by("rep", F.xxhash64("rep")).alias("hub"),
        F.max_by("rep", F.xxhash64("rep")).alias("other_hub"),
    )
    members = stage(banded.join(stage(buckets.filter("n > 1"), "near-shared"), "key"), "near-members")

    hub_links = stage(_links_with_hubs(members, classes, docs, shingle_words, percent), "near-hub-links")
    parts = connected_components(hub_links, "near-parts")
    wide = members.filter("n > 3")
    block_links = stage(_links_in_blocks(wide, classes, parts, docs, shingle_words, percent), "near-block-links")
    joined = parts.filter("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    components = connected_components(joined.union(block_links), "near-components")

    named = classes.select("set_key", "rep", "doc_id").join(component_ids(classes, components, "doc_id", "near-lowest"), "rep", "left")
    named = named.select("set_key", F.coalesce("component_id", "doc_id").alias("component_id"))
    named = stage(named, "near-named")
    found = linkable.select("doc_id", "text_hash", "n_shingles", "set_key").join(named, "set_key", "left")
    alone = sketches.filter("n_shingles = 0 or doc_id is null").select(
        "doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return (
        found.select("doc_id", "text_hash", "n_shingles", "component_id")
        .unionByName(alone)
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def drop_near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE, percent: int = PERCENT
) -> DataFrame:
    """``df`` with one document of each component, that of the smallest id; all columns stay.

    Of rows that repeat id and text one stays, also where the id is NULL. The rest is as in :func:`near_duplicates`: NULL and empty texts link with
    nothing, long texts count whole, an empty table stays empty.
    """
    found = _settled(df, id_col, text_col, shingle_words, percent)
    return without_rows(df, id_col, text_col, found.select(F.col("doc_id").alias("id"), "text_hash", "kept"), "near-gone")
