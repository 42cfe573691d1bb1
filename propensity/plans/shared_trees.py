"""Trees over binned rows, grown level by level in passes that all trees of a forest share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propensity.sources.tables import stage

#: rows of a block; largest number of codes of features that are counted together; bytes of sums that a pass brings to the driver
BLOCK_ROWS, GROUP_CODES, SUMS_BYTES = 1 << 14, 1 << 10, 1 << 24
#: a forest's rows are drawn this often at most, which packs two trees into a byte
MOST_DRAWN = 15
#: gains that differ by this part of the impurity are equal where sums are not exact
TIE = 1e-12
EPSILON = np.finfo(float).eps
BLOCKS = "rows bigint, bad bigint, least double, x binary, y binary, w binary, draws binary"


class Bins(NamedTuple):
    """Values per feature, and the features whose codes are one number: a group is counted at once and taken apart afterwards."""

    arities: tuple[int, ...]
    groups: tuple[tuple[int, ...], ...]

    @property
    def sizes(self) -> list[int]:
        return [int(np.prod([self.arities[f] for f in group])) for group in self.groups]

    def codes(self, values: np.ndarray) -> np.ndarray:
        """Codes ``[group, row]`` of bin numbers ``[row, feature]``."""
        if not ((values >= 0) & (values < np.array(self.arities)) & (values == np.floor(values))).all():
            raise ValueError("a bin number is out of its range")
        made = np.zeros((len(self.groups), len(values)), np.uint16)
        for g, group in enumerate(self.groups):
            code = np.zeros(len(values), np.int64)
            for f in group:
                code = code * self.arities[f] + values[:, f].astype(np.int64)
            made[g] = code
        return made

    def goes_right(self, feature: int, left: np.ndarray) -> tuple[int, np.ndarray]:
        """The group of a split's feature, and for each of its codes whether it goes right."""
        g = next(g for g, group in enumerate(self.groups) if feature in group)
        right = np.ones(self.arities[feature], np.uint8)
        right[left] = 0
        group = self.groups[g]
        shape = [self.arities[f] if f == feature else 1 for f in group]
        table = np.zeros(GROUP_CODES, np.uint8)
        whole = np.broadcast_to(right.reshape(shape), [self.arities[f] for f in group]).ravel()
        table[: len(whole)] = whole
        return g, table

    def valid(self) -> np.ndarray:
        """Which values ``[feature, value]`` there are."""
        return np.arange(max(self.arities)) < np.array(self.arities)[:, None]

    def by_feature(self, sums: list[np.ndarray], nodes: int) -> np.ndarray:
        """Sums ``[stat, node, feature, value]`` from those of groups, ``[stat, node * code]``."""
        found = np.zeros((len(sums[0]), nodes, len(self.arities), max(self.arities)))
        for group, total in zip(self.groups, sums):
            shaped = total.reshape(len(total), nodes, *(self.arities[f] for f in group))
            for i, f in enumerate(group):
                others = tuple(2 + j for j in range(len(group)) if j != i)
                found[:, :, f, : self.arities[f]] = shaped.sum(axis=others)
        return found


def bins_of(rows: DataFrame, features: str, most: int) -> Bins | None:
    """The bins of a feature vector by its attributes; ``None`` if a feature is a number, or has more than ``most`` values."""
    attributes = rows.schema[features].metadata.get("ml_attr", {})
    named = attributes.get("attrs", {})
    values = {one["idx"]: 2 for one in named.get("binary", [])}
    values |= {one["idx"]: len(one["vals"]) if "vals" in one else one.get("num_vals", 0) for one in named.get("nominal", [])}
    count = attributes.get("num_attrs", sum(map(len, named.values())))
    if not count or sorted(values) != list(range(count)) or not all(0 < own <= min(most, GROUP_CODES) for own in values.values()):
        return None
    arities = tuple(values[i] for i in range(count))
    groups: list[list[int]] = []
    for f in sorted(range(count), key=lambda f: -arities[f]):  # first fit, largest first
        room = (g for g in groups if np.prod([arities[i] for i in g]) * arities[f] <= GROUP_CODES)
        own = next(room, None)
        if own is None:
            groups.append([f])
        else:
            own.append(f)
    return Bins(arities, tuple(map(tuple, groups)))


class Rules(NamedTuple):
    """When a node is split."""

    depth: int
    exact: bool  # classes, whose sums are exact; else residuals
    least_rows: int
    least_gain: float
    least_share: float


def rules_of(learner, exact: bool) -> Rules:
    """The rules of a tree learner's parameters."""
    return Rules(learner.getMaxDepth(), exact, learner.getMinInstancesPerNode(), learner.getMinInfoGain(), learner.getMinWeightFractionPerNode())


def fits(learner, bins: Bins | None, taken: int, exact: bool) -> bool:
    """Whether all open nodes of a level of a tree are met in one pass, within the memory that the learner is given."""
    if bins is None or not taken or learner.getMaxDepth() > 16:
        return False
    values = taken * max(bins.arities) * (3 if exact else 4) * 8
    return values << max(0, learner.getMaxDepth() - 1) <= learner.getMaxMemoryInMB() << 20


class Node(NamedTuple):
    """Statistics: sums of weights and of weighted values (and of their squares), and rows."""

    stats: np.ndarray
    rows: int


class Tree:
    """A growing tree by heap numbers: the root is 1, the children of n are 2n and 2n + 1."""

    def __init__(self, number: int, subset: Callable[[], list[int]]):
        self.number, self.subset = number, subset
        self.nodes: dict[int, Node] = {}
        self.splits: dict[int, tuple[int, np.ndarray, float]] = {}  # feature, values that go left, gain
        self.invalid: set[int] = set()
        self.open = [1]
        self.features = [subset()]


class Routes(NamedTuple):
    """What a task needs of a tree."""

    number: int
    group: np.ndarray  # by heap number
    start: np.ndarray  # by heap number: where the codes of its split begin in ``table``
    table: np.ndarray  # by split and code: 1 goes right
    next: np.ndarray  # by twice the heap number, and one more to the right: a leaf is its own next
    slot: np.ndarray  # by heap number: place among the open nodes, or -1
    features: np.ndarray  # by open node
    value: np.ndarray  # by heap number
    levels: int


def routes_of(tree: Tree, bins: Bins, value: Callable[[Node], float] | None = None, levels: int = 0) -> Routes:
    size = 2 * max([1, *tree.nodes, *tree.open]) + 2
    group, start, slot = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, -1)
    after = np.repeat(np.arange(size), 2)
    tables = [np.zeros(GROUP_CODES, np.uint8)]  # of leaves
    for heap, (feature, left, _) in tree.splits.items():
        group[heap], table = bins.goes_right(feature, left)
        start[heap] = len(tables) * GROUP_CODES
        after[2 * heap : 2 * heap + 2] = 2 * heap, 2 * heap + 1
        tables.append(table)
    slot[tree.open] = np.arange(len(tree.open))
    values = np.zeros(size)
    if value:
        for heap, node in tree.nodes.items():
            values[heap] = value(node)
    return Routes(tree.number, group, start, np.concatenate(tables), after, slot, np.array(tree.features), values, levels)


def places(x: np.ndarray, routes: Routes, levels: int) -> np.ndarray:
    """Heap number of the node at which each row is after so many levels."""
    rows = x.shape[1]
    if not levels:
        return np.ones(rows, np.int64)
    start = routes.start[1]
    at = routes.next.take(routes.table[start : start + GROUP_CODES].take(x[routes.group[1]]) + 2)
    if levels > 1:
        flat, own, every = x.reshape(-1), routes.group * rows, np.arange(rows)
        for _ in range(levels - 1):
            code = flat.take(own.take(at) + every)
            at = routes.next.take(2 * at + routes.table.take(routes.start.take(at) + code))
    return at


class Block(NamedTuple):
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    draws: np.ndarray | None


def _blocks(batch: pa.RecordBatch, bins: Bins) -> Iterator[Block]:
    names = [name for name in ("x", "y", "w", "draws") if name in batch.schema.names]
    for values in zip(*(batch.column(name) for name in names)):
        own = {name: value.as_buffer() for name, value in zip(names, values)}
        y = np.frombuffer(own["y"], np.uint8)
        yield Block(
            np.frombuffer(own["x"], "<u2").reshape(len(bins.groups), len(y)),
            y,
            np.frombuffer(own["w"], "<f8"),
            np.frombuffer(own["draws"], np.uint8).reshape(-1, len(y)) if own.get("draws") else None,
        )


class Checked(NamedTuple):
    codes: np.ndarray
    y: np.ndarray
    w: np.ndarray
    bad: int  # rows with a weight that is missing, negative or infinite
    least: float | None


def given_rows(rows: DataFrame, features: str, label: str, weight: Column, key: Column | None = None) -> DataFrame:
    """What is staged of the rows, as plain columns."""
    columns = [vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("y"), weight.cast("double").alias("w")]
    return rows.select(*columns, (F.lit(0) if key is None else key).cast("bigint").alias("h"))


def packed(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of :func:`given_rows` in blocks of half ``most`` rows at least, but for the last, and less than one and a half times ``most``."""
    held, count = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            part = batch.slice(start, most)
            x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            held.append((x, *(part.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))))
            count += part.num_rows
            if count >= most // 2:
                yield tuple(np.concatenate(column) for column in zip(*held))
                held, count = [], 0
    if count:
        yield tuple(np.concatenate(column) for column in zip(*held))


def checked_rows(bins: Bins, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Checked:
    """A block's codes, labels and weights as they are staged."""
    if not ((y == 0) | (y == 1)).all():
        raise ValueError("labels are 0 and 1")
    usable = w[w > 0]
    bad = int((~(w >= 0) | np.isinf(w)).sum())
    return Checked(bins.codes(x), y.astype(np.uint8), w.astype("<f8"), bad, float(usable.min()) if len(usable) else None)


def stage_blocks(rows: DataFrame, bins: Bins, features: str, label: str, weight: Column, draws: Callable | None = None, key: Column | None = None) -> DataFrame:
    """Write what the passes read: a row of the table holds a block of codes, labels and weights, and how often each tree draws each row.

    Blocks have a bounded size, so a split of the table is as large in memory as it is on disk.
    """
    kinds = [pa.int64(), pa.int64(), pa.float64()] + [pa.binary()] * 4
    schema = pa.schema(list(zip([field.split()[0] for field in BLOCKS.split(", ")], kinds)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y, w, h in packed(batches, BLOCK_ROWS):
            found = checked_rows(bins, x, y, w)
            made = {
                "rows": len(y), "bad": found.bad, "least": found.least, "x": found.codes.tobytes(), "y": found.y.tobytes(), "w": found.w.tobytes(),
                "draws": draws(h).tobytes() if draws else None,
            }
            yield pa.RecordBatch.from_pylist([made], schema=schema)

    # read many times, and codes of bins hardly shrink
    return stage(given_rows(rows, features, label, weight, key).mapInArrow(pack, BLOCKS), "tree-blocks", compression="uncompressed")


def held_bytes(tree: Tree, bins: Bins, stats: int) -> int:
    """Bytes of the sums of a tree's open nodes."""
    return 8 * (stats + 1) * len(tree.open) * len(tree.features[0]) * max(bins.arities)


def _level(
    blocks: DataFrame, tasks: int, trees: list[Tree], bins: Bins, level: int, values: Callable[[Block, int], tuple[np.ndarray, ...]], stats: int
) -> list[np.ndarray]:
    """Sums ``[stat, node, feature, value]`` of the open nodes of each tree, rows last, over the features that the node may split by.

    One pass; a task sums over its blocks, and tasks by tree over those, or the driver where all ``tasks`` bring ``SUMS_BYTES`` at most.
    """
    routes = [routes_of(tree, bins) for tree in trees]
    sizes = bins.sizes

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: list[np.ndarray | None] = [None] * len(routes)
        for batch in batches:
            own = list(_blocks(batch, bins))
            for i, tree in enumerate(routes):
                nodes = len(tree.features)
                sums = [np.zeros((stats + 1, nodes * size)) for size in sizes]
                for block in own:
                    kept, *weights = values(block, tree.number)
                    x = block.x if kept is None else block.x[:, kept]
                    slot = tree.slot[places(x, tree, level)]
                    if level and (slot < 0).any():
                        inside = slot >= 0
                        slot, x, weights = slot[inside], x[:, inside], [one[inside] for one in weights]
                    for g, size in enumerate(sizes):
                        index = slot * size + x[g]
                        for s, one in enumerate(weights):
                            sums[g][s] += np.bincount(index, one, nodes * size)
                        sums[g][stats] += np.bincount(index, minlength=nodes * size)
                found = np.take_along_axis(bins.by_feature(sums, nodes), tree.features[None, :, :, None], axis=2)
                totals[i] = found if totals[i] is None else totals[i] + found
        rows = [(i, total.tobytes()) for i, total in enumerate(totals) if total is not None]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["tree", "sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = np.frombuffer(sums.as_buffer())
                totals[i] = own + totals[i] if i in totals else own
        if totals:
            made = [pa.array(list(totals), pa.int32()), pa.array([total.tobytes() for total in totals.values()], pa.binary())]
            yield pa.RecordBatch.from_arrays(made, names=["tree", "sums"])

    schema = "tree int, sums binary"
    parts = blocks.mapInArrow(add, schema)
    if tasks * sum(held_bytes(tree, bins, stats) for tree in trees) > SUMS_BYTES:
        parts = parts.repartition(min(len(trees), blocks.sparkSession.sparkContext.defaultParallelism), "tree").mapInArrow(merge, schema)
    found: dict[int, np.ndarray] = {}
    for row in parts.collect():
        own = np.frombuffer(bytes(row["sums"]))
        found[row["tree"]] = own + found[row["tree"]] if row["tree"] in found else own
    if len(found) < len(trees):
        raise ValueError("a tree has no row to fit on")
    width = max(bins.arities)
    return [found[i].reshape(stats + 1, *routes[i].features.shape, width) for i in range(len(trees))]


def impurity(stats: np.ndarray, exact: bool) -> np.ndarray:
    """Gini index of weights and weights of class 1, or variance from sums of weights, values and squares; 0 without weight."""
    with np.errstate(divide="ignore", invalid="ignore"):
        if exact:
            share, other = stats[1] / stats[0], (stats[0] - stats[1]) / stats[0]
            found = 1.0 - other * other - share * share
        else:
            found = (stats[2] - stats[1] * stats[1] / stats[0]) / stats[0]
    return np.where(stats[0] == 0, 0.0, found)


def _best(sums: np.ndarray, features: np.ndarray, bins: Bins, rules: Rules, node: Node | None, least_weight: float) -> tuple | None:
    """The best split of a node, ``(feature, values left, gain, left, right)``, and the node.

    As the learner does it: values of a feature are ordered by the weight of class 1, or by their mean, and cut once.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        order_by = sums[1] if rules.exact else sums[1] / sums[0]
    order_by = np.where(sums[0] == 0, np.finfo(float).max, order_by)
    value = np.arange(sums.shape[2])
    arity = np.array(bins.arities)[features][:, None]
    order = np.argsort(np.where(value < arity, order_by, np.inf), axis=1, kind="stable")
    left = np.take_along_axis(sums, order[None], axis=2).cumsum(axis=2)
    total = left[:, :, -1:]
    right = total - left
    if node is None:
        node = Node(total[:-1, 0, 0], int(total[-1, 0, 0]))
    whole = float(impurity(node.stats, rules.exact))
    both = left[0] + right[0]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = whole - left[0] / both * impurity(left, rules.exact) - right[0] / both * impurity(right, rules.exact)
    allowed = (value[None] < arity - 1) & (left[-1] >= rules.least_rows) & (right[-1] >= rules.least_rows)
    allowed &= (left[0] >= least_weight) & (right[0] >= least_weight) & (gain >= rules.least_gain)
    if not allowed.any():
        return node, None
    gain = np.where(allowed, gain, -np.inf)
    top = gain.max() - (0 if rules.exact else TIE * whole)
    f, cut = np.unravel_index(np.argmax(gain >= top), gain.shape)  # the first of equals
    children = [Node(side[:-1, f, cut].copy(), int(side[-1, f, cut])) for side in (left, right)]
    return node, (int(features[f]), np.sort(order[f, : cut + 1]), float(gain[f, cut]), *children)


def grow(trees: list[Tree], found: list[np.ndarray], bins: Bins, rules: Rules, level: int) -> None:
    """Split the open nodes by their sums, and open their children."""
    for tree, sums in zip(trees, found):
        waiting: list[int] = []
        for place, heap in enumerate(tree.open):
            root_weight = tree.nodes[1].stats[0] if 1 in tree.nodes else sums[0, 0, 0].sum()
            node, split = _best(sums[:, place], np.array(tree.features[place]), bins, rules, tree.nodes.get(heap), rules.least_share * root_weight)
            tree.nodes[heap] = node
            if split is None:
                tree.invalid.add(heap)
            elif split[2] > 0 and level < rules.depth:
                tree.splits[heap] = split[:3]
                for child, side in zip((2 * heap, 2 * heap + 1), split[3:]):
                    tree.nodes[child] = side
                    if level + 1 < rules.depth and abs(float(impurity(side.stats, rules.exact))) >= EPSILON:
                        waiting.append(child)
        tree.open = waiting[::-1]  # the last one first, as the learner does
        tree.features = [tree.subset() for _ in tree.open]


def together(trees: list[Tree], bins: Bins, stats: int) -> Iterator[list[Tree]]:
    """Trees whose sums are held at a time."""
    group, size = [], 0
    for tree in trees:
        own = held_bytes(tree, bins, stats)
        if group and size + own > SUMS_BYTES:
            yield group
            group, size = [], 0
        group, size = [*group, tree], size + own
    if group:
        yield group


def grow_forest(blocks: DataFrame, bins: Bins, rules: Rules, subsets: list[Callable[[], list[int]]], least: float, steps: int, drawn: bool) -> list[Tree]:
    """Trees of all numbers, a pass over the blocks per level. Weights are multiples of ``least / steps``, so that sums are exact in any order."""
    trees = [Tree(number, subset) for number, subset in enumerate(subsets)]
    read = blocks.select("x", "y", "w", *(["draws"] if drawn else []))
    tasks = read.rdd.getNumPartitions()

    def values(block: Block, number: int) -> tuple[np.ndarray, ...]:
        weight = np.floor(block.w / least * steps + 0.5) / steps
        if drawn:
            weight = weight * (block.draws[number // 2] >> 4 * (number % 2) & MOST_DRAWN)
        kept = np.flatnonzero(weight > 0)
        return kept, weight[kept], (weight * block.y)[kept]

    for level in range(max(1, rules.depth)):
        for group in together([tree for tree in trees if tree.open], bins, 2):
            grow(group, _level(read, tasks, group, bins, level, values, 2), bins, rules, level)
    return trees


def mean(node: Node) -> float:
    return float(node.stats[1] / node.stats[0]) if node.stats[0] else 0.0


class Seeds:
    """Features of nodes in the order in which the learner draws them: a reservoir of ``take`` of ``features`` from a generator per node."""

    def __init__(self, spark: SparkSession, seed: int, features: int, take: int):
        self.hash = getattr(getattr(spark.sparkContext._jvm.org.apache.spark.util.random, "XORShiftRandom$"), "MODULE$").hashSeed
        self.state, self.features, self.take = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1), features, take

    def _signed(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        number = self.state >> 16
        return number - (1 << 32) if number >> 31 else number

    def __call__(self) -> list[int]:
        chosen = list(range(self.take))
        if self.take == self.features:
            return chosen
        number = (self._signed() << 32) + self._signed() & ((1 << 64) - 1)
        state = self.hash(number - (1 << 64) if number >> 63 else number) & ((1 << 64) - 1)

        def bits(count: int) -> int:
            nonlocal state
            state ^= state << 21 & ((1 << 64) - 1)
            state ^= state >> 35
            state ^= state << 4 & ((1 << 64) - 1)
            return state & ((1 << count) - 1)

        for seen in range(self.take + 1, self.features + 1):
            place = int(((bits(26) << 27) + bits(27)) / (1 << 53) * seen)
            if place < self.take:
                chosen[place] = seen - 1
        return chosen


def java_trees(spark: SparkSession, trees: list[Tree], bins: Bins, rules: Rules):
    """Spark's own trees of grown ones; a node whose leaves all predict the same is a leaf, as the learner has it."""
    gateway, jvm = spark.sparkContext._gateway, spark.sparkContext._jvm
    ml, kinds, copied = jvm.org.apache.spark.ml, jvm.org.apache.spark.mllib.tree.impurity, jvm.java.util.Arrays.copyOfRange
    inner, leaf, categorical = ml.tree.InternalNode, ml.tree.LeafNode, ml.tree.CategoricalSplit
    calculator = kinds.GiniCalculator if rules.exact else kinds.VarianceCalculator
    kind = ml.classification.DecisionTreeClassificationModel if rules.exact else ml.regression.DecisionTreeRegressionModel
    made = gateway.new_array(kind, len(trees))
    for i, tree in enumerate(trees):
        numbers: list[float] = []
        spans: dict = {}
        for heap, node in tree.nodes.items():
            own = [node.stats[0] - node.stats[1], node.stats[1]] if rules.exact else node.stats.tolist()
            spans[heap] = (len(numbers), len(numbers) + len(own))
            numbers += own
        for heap, split in tree.splits.items():
            spans[-heap] = (len(numbers), len(numbers) + len(split[1]))
            numbers += split[1].tolist()
        flat = gateway.new_array(jvm.double, len(numbers))
        jvm.java.nio.ByteBuffer.wrap(np.array(numbers, ">f8").tobytes()).asDoubleBuffer().get(flat)

        def prediction(heap: int) -> float:
            node = tree.nodes[heap]
            return float(node.stats[1] > node.stats[0] - node.stats[1]) if rules.exact else mean(node)

        def is_leaf(heap: int) -> bool:
            if heap not in tree.splits:
                return True
            left, right = 2 * heap, 2 * heap + 1
            return is_leaf(left) and is_leaf(right) and leaf_says(left) == leaf_says(right)

        def leaf_says(heap: int) -> float:
            """What a leaf predicts; one that was joined says what its children said."""
            return leaf_says(2 * heap) if heap in tree.splits else prediction(heap)

        def build(heap: int):
            node = tree.nodes[heap]
            stats = calculator(copied(flat, *spans[heap]), node.rows)
            whole = float(impurity(node.stats, rules.exact))
            if is_leaf(heap):
                return leaf(leaf_says(heap), -1.0 if heap in tree.invalid else whole, stats)
            feature, _, gain = tree.splits[heap]
            split = categorical(feature, copied(flat, *spans[-heap]), bins.arities[feature])
            return inner(prediction(heap), whole, gain, build(2 * heap), build(2 * heap + 1), split, stats)

        uid = f"{'dtc' if rules.exact else 'dtr'}_{uuid.uuid4().hex[:12]}"
        made[i] = kind(uid, build(1), len(bins.arities), 2) if rules.exact else kind(uid, build(1), len(bins.arities))
    return made
