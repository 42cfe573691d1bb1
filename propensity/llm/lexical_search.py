"""Ranked lexical search: bit-sliced Bloom signatures bound every score from above, texts settle what the bounds leave open."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from propensity.llm.common import as_bytes, inputs, settle, small_batches, stage, text_hash

TOP = 10
#: a signature holds a key for each of these numbers that a term's occurrences reach
LEVELS = (1, 2, 3, 5, 9, 17, 33, 65)
#: bits per key, and the share of bits that are set in the fullest signature of a block: a term that is missing seems present in 1 of 625 cases
PROBES, DENSITY = 4, 0.2
#: documents in a block, and bits of a block unless one document alone needs more
BLOCK, BLOCK_BITS = 1024, 1 << 25
#: documents or keys that a task gathers before it cuts them into blocks of similar length
GATHER, GATHER_KEYS = 8192, 1 << 22
#: documents with the highest bounds that are scored first, per item: they set the bar for all others
SEEDS = 32
#: terms of the items that are searched for at a time: a task holds a byte per term and document of a block
QUERY_TERMS = 1 << 15
#: hash buckets of documents to be scored, which sift the texts before they are joined
BUCKETS = 1 << 20

# Fixed value: bytes of no term; A-Z become a-z. Of UTF-8, all bytes of a character beyond ASCII are above 0x7F, so terms can be cut in bytes.
_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(b if b in _KEPT else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def terms_of(data: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats."""
    return data.translate(_TABLE).split()


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer over an array."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def level_keys(terms: list[bytes]) -> np.ndarray:
    """``[level, term]``: the key of each term at each level. Terms that share a key seem present together, no more."""
    base = np.fromiter(map(zlib.crc32, terms), np.uint64, len(terms))
    return mix(base[None, :] | (np.arange(1, len(LEVELS) + 1, dtype=np.uint64)[:, None] << np.uint64(32)))


def bit_places(keys: np.ndarray, width: int) -> np.ndarray:
    """The ``PROBES`` bits of each key in a signature of ``width`` bits, in a new last axis."""
    steps = np.arange(PROBES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mix(keys[..., None] + steps) % np.uint64(width)).astype(np.int64)


def document_keys(terms: list[bytes]) -> np.ndarray:
    """All keys of a document."""
    counts = Counter(terms)
    found = np.fromiter(counts.values(), np.int64, len(counts))
    return level_keys(list(counts))[np.array(LEVELS)[:, None] <= found]


def signature_width(keys: int) -> int:
    """Bits in which ``keys`` keys fill ``DENSITY``."""
    return max(64, math.ceil(keys * PROBES / -math.log1p(-DENSITY)))


def block_sizes(key_counts: list[int]) -> Iterator[tuple[int, int, int]]:
    """``(start, end, width)`` over rising numbers of keys: a block ends where the next document has twice the keys of its first, or where it is full."""
    start = 0
    while start < len(key_counts):
        end = start + 1
        while (
            end < len(key_counts)
            and end - start < BLOCK
            and key_counts[end] <= 2 * key_counts[start] + 64
            and signature_width(key_counts[end]) * (end - start + 1) <= BLOCK_BITS
        ):
            end += 1
        yield start, end, signature_width(key_counts[end - 1])
        start = end


def slice_block(keys: list[np.ndarray], width: int) -> bytes:
    """Signatures of some documents by bit: for each of ``width`` bits a bitmap of the documents that have it."""
    bits = np.zeros((width, -(-len(keys) // 8) * 8), bool)
    column = np.repeat(np.arange(len(keys)), [len(k) * PROBES for k in keys])
    bits[bit_places(np.concatenate(keys), width).ravel(), column] = True
    return np.packbits(bits, axis=1).tobytes()


def build_index(rows: DataFrame) -> DataFrame:
    """Blocks of signatures, staged, of ``(id, text_hash, text)``; documents without a term are in none.

    Each task cuts its own documents into blocks of similar length, so nothing is shuffled. A row has the ids, text hashes and numbers of
    terms of its documents, the width of the signatures, and the bit slices.
    """
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"ids array<{kind}>, hashes array<bigint>, lengths array<bigint>, width bigint, slices binary"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def cut(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda doc: len(doc[3]))
        for start, end, width in block_sizes([len(doc[3]) for doc in held]):
            ids, hashes, lengths, keys = zip(*held[start:end])
            row = {"ids": ids, "hashes": hashes, "lengths": lengths, "width": width, "slices": slice_block(keys, width)}
            yield pa.RecordBatch.from_pylist([row], schema=arrow)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys = [], 0
        for batch in batches:
            for id, hashed, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                terms = terms_of(text.as_py())
                if not terms:
                    continue
                held.append((id, hashed, len(terms), document_keys(terms)))
                keys += len(held[-1][3])
                if len(held) >= GATHER or keys >= GATHER_KEYS:
                    yield from cut(held)
                    held, keys = [], 0
        yield from cut(held)

    return stage(small_batches(rows).mapInArrow(build, schema), "signatures")


class Items:
    """Some items of the query set: their ids, distinct terms, and, once counted, the weights of terms."""

    def __init__(self, items: list[tuple]):
        self.ids = [id for id, _ in items]
        self.terms = sorted({term for _, terms in items for term in terms})
        place = {term: i for i, term in enumerate(self.terms)}
        self.places = [np.array(sorted(place[term] for term in set(terms)), np.int64) for _, terms in items]
        self.weights = np.zeros(len(self.terms), np.int64)
        self.documents = self.length = 0

    def weigh(self, documents: int, length: int, holding: dict[int, int]) -> None:
        """Set weights from the number of documents, of all their terms, and of documents that hold each term."""
        self.documents, self.length = documents, length
        for i in range(len(self.terms)):
            self.weights[i] = math.floor(1000 * math.log((2 * documents + 2) / (2 * holding.get(i, 0) + 1)))

    def norm(self, terms: int) -> int:
        """What the number of terms of a document adds below the line."""
        return 100 - 90 + (90 * terms * self.documents) // self.length

    def upper_bounds(self, lengths: list[int], width: int, slices: bytes) -> np.ndarray:
        """``[item, document]``: for the documents of a block, a score that none exceeds."""
        count = len(lengths)
        sliced = np.frombuffer(slices, np.uint8).reshape(width, -1)
        places = bit_places(level_keys(self.terms), width)
        level = np.zeros((len(self.terms), count), np.int8)
        alive, before = np.arange(len(self.terms)), None
        for places_of_level in places:
            hits = np.bitwise_and.reduce(sliced[places_of_level[alive]], axis=1)
            if before is not None:
                hits &= before
            some = hits.any(axis=1)
            alive, before = alive[some], hits[some]
            if not len(alive):
                break
            level[alive] += np.unpackbits(before, axis=1, count=count).view(np.int8)
        terms = np.array(lengths, np.int64)
        norms = 8 * np.array([self.norm(n) for n in lengths], np.int64)
        most = [np.zeros(count, np.int64)]  # by level: the most that occurrences below the next level, or any, give
        for following in (*LEVELS[1:], None):
            occur = terms if following is None else np.minimum(following - 1, terms)
            most.append((1_000_000_000 * occur) // (1000 * occur + norms))
        gain = np.stack(most)
        documents = np.arange(count)
        return np.stack([self.weights[at] @ gain[level[at], documents] for at in self.places]) if self.places else np.zeros((0, count), np.int64)

    def scores(self, terms: list[bytes], numbers: list[int]) -> list[int]:
        """Exact scores of a document for some of the items."""
        counts, norm = Counter(terms), 8 * self.norm(len(terms)) if terms else 0
        gain = {}
        found = []
        for number in numbers:
            total = 0
            for i in self.places[number].tolist():
                if i not in gain:
                    occur = counts.get(self.terms[i], 0)
                    gain[i] = int(self.weights[i]) * ((1_000_000_000 * occur) // (1000 * occur + norm)) if occur else 0
                total += gain[i]
            found.append(total)
        return found


def item_blocks(items: DataFrame) -> Iterator[Items]:
    """The query set in blocks of bounded size; items without a term have no result and are left out."""
    held, terms = [], 0
    for row in items.toLocalIterator():
        found = terms_of(bytes(row["text"]))
        if not found:
            continue
        held.append((row["id"], sorted(set(found))))
        terms += len(held[-1][1])
        if terms >= QUERY_TERMS:
            yield Items(held)
            held, terms = [], 0
    if held:
        yield Items(held)


def holding_counts(rows: DataFrame, terms: list[bytes]) -> dict[int, int]:
    """How many documents hold each term (by its place in ``terms``); one row per task and term is shuffled."""
    place = {term: i for i, term in enumerate(terms)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for batch in batches:
            for text in batch.column(0):
                found.update(place.keys() & set(terms_of(text.as_py())))
        places = [place[term] for term in found]
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    counted = small_batches(rows.select("text")).mapInArrow(count, "term bigint, n bigint")
    return {row["term"]: row["n"] for row in counted.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def bounded(index: DataFrame, pick: Callable[[np.ndarray], list[np.ndarray]], items: Items, keep: int | None = None) -> DataFrame:
    """``(number, id, text_hash, bound)`` of the documents that ``pick`` takes, as places per item, from the bounds of a block.

    With ``keep`` a task returns only so many of the highest bounds per item.
    """
    kind = index.schema["ids"].dataType.elementType.simpleString()
    schema = f"number int, id {kind}, text_hash bigint, bound bigint"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def rows_of(found: dict[int, list[tuple]]) -> pa.RecordBatch:
        flat = [(number, *row) for number, rows in found.items() for row in rows]
        columns = zip(*flat) if flat else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), field.type) for c, field in zip(columns, arrow)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                bounds = items.upper_bounds(row["lengths"], row["width"], row["slices"])
                for number, places in enumerate(pick(bounds)):
                    if len(places):
                        own = found.setdefault(number, [])
                        own += [(row["ids"][i], row["hashes"][i], int(bounds[number, i])) for i in places.tolist()]
                        if keep:
                            own.sort(key=lambda r: -r[2])
                            del own[keep:]
                if not keep:
                    yield rows_of(found)
                    found = {}
        if keep:
            yield rows_of(found)

    return small_batches(index).mapInArrow(run, schema)


def exact_scores(rows: DataFrame, wanted: DataFrame, items: Items, item_kind: str) -> DataFrame:
    """``(number, item_id, id, text_hash, score)`` of the wanted ``(number, id, text_hash)``, from whole texts.

    Texts are sifted by hash buckets first (at most ``BUCKETS`` numbers are broadcast), so only those of wanted documents, and of few others,
    reach the join. Rows that repeat id and text are scored each.
    """
    numbers = wanted.groupBy("id", "text_hash").agg(F.collect_set("number").alias("numbers")).withColumnsRenamed({"id": "w_id", "text_hash": "w_hash"})

    def bucket(column: str) -> Column:
        return F.pmod(column, F.lit(BUCKETS))

    buckets = wanted.select(bucket("text_hash").alias("bucket")).distinct()
    sifted = rows.join(F.broadcast(buckets), bucket("text_hash") == F.col("bucket"), "left_semi")
    matches = reduce(lambda a, b: a & b, [F.col("id").eqNullSafe(F.col("w_id")), F.col("text_hash") == F.col("w_hash")])
    joined = sifted.join(numbers, matches).select("id", "text_hash", "numbers", "text")
    schema = f"number int, item_id {item_kind}, id {rows.schema['id'].dataType.simpleString()}, text_hash bigint, score bigint"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                scores = items.scores(terms_of(row["text"]), row["numbers"])
                found += [(n, items.ids[n], row["id"], row["text_hash"], s) for n, s in zip(row["numbers"], scores) if s > 0]
            columns = zip(*found) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), field.type) for c, field in zip(columns, arrow)], schema=arrow)

    return small_batches(joined).mapInArrow(score, schema)


def best(scored: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows per item with ``rank``; a task hands on no more than that of an item."""
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "text_hash")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The ``top`` highest-scoring documents of each item: ``item_id, rank, doc_id, score``; equal scores by ascending id, NULL last.

    1. Every document is in a block of Bloom signatures stored by bit. A key stands for a term that occurs at least so often
       (``LEVELS``), so the slices of a term's keys, and-ed, tell for a whole block how often the term occurs at most.
    2. Weights are summed over these slices to an upper bound per item and document. The ``SEEDS`` documents with the highest bounds are
       scored from their texts; the ``top``-th best of those scores is the item's bar.
    3. All documents whose bound reaches the bar are scored from their texts. A bound is never below the score, so no other document can be
       among the best; nothing is capped.

    Counts of documents and terms that weights and scores need are exact and cover all documents. The query set is
    searched in blocks of ``QUERY_TERMS`` terms, each against all signatures.

    Terms are cut in UTF-8 bytes, whole texts; NULL and empty texts have no term, are not counted and never found. Items without a term, or whose
    terms no document has, have no row. Rows that repeat an item id are searched each; rows that repeat id and text of a document are
    documents each. Empty tables give no row.
    """
    spark = docs.sparkSession
    rows = inputs(docs, id=id_col, text=text_col).select("id", text_hash(F.col("text")).alias("text_hash"), as_bytes(F.col("text")).alias("text"))
    queries = inputs(items, id=item_col, text=item_text_col).select("id", as_bytes(F.col("text")).alias("text"))
    item_kind = queries.schema["id"].dataType.simpleString()

    def best_of(index: DataFrame, total: Row, block: Items) -> DataFrame:
        block.weigh(total["documents"], total["length"], holding_counts(rows, block.terms))

        def highest(bounds: np.ndarray) -> list[np.ndarray]:
            taken = np.argpartition(bounds, -SEEDS, axis=1)[:, -SEEDS:] if bounds.shape[1] > SEEDS else np.tile(np.arange(bounds.shape[1]), (len(bounds), 1))
            return [places[own[places] > 0] for own, places in zip(bounds, taken)]

        order = Window.partitionBy("number").orderBy(F.col("bound").desc(), "id", "text_hash")
        seeds = bounded(index, highest, block, SEEDS).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SEEDS)
        seeds = stage(seeds.select("number", "id", "text_hash"), "search-seeds")
        bars = np.ones(len(block.ids), np.int64)
        found = best(exact_scores(rows, seeds, block, item_kind), top).filter(F.col("rank") == top)
        for row in found.select("number", "score").collect():  # one row per item of the block
            bars[row["number"]] = row["score"]
        open_ones = bounded(index, lambda bounds: [np.flatnonzero(own >= bar) for own, bar in zip(bounds, bars)], block)
        open_ones = stage(open_ones.select("number", "id", "text_hash").distinct(), "search-open")
        return stage(best(exact_scores(rows, open_ones, block, item_kind), top), "search-best")

    def build() -> DataFrame:
        index = build_index(rows)
        total = index.select(F.size("lengths").alias("n"), F.aggregate("lengths", F.lit(0).cast("bigint"), lambda a, b: a + b).alias("length"))
        total = total.agg(F.sum("n").alias("documents"), F.sum("length").alias("length")).first()
        found = [best_of(index, total, block) for block in item_blocks(queries)] if total["documents"] else []
        schema = f"item_id {item_kind}, rank int, doc_id {rows.schema['id'].dataType.simpleString()}, score bigint"
        found = [one.select("item_id", "rank", F.col("id").alias("doc_id"), "score") for one in found]
        return reduce(DataFrame.union, found, spark.createDataFrame([], schema))

    return settle(spark, "ranked", build)
