"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propensity.llm.common import as_bytes, inputs, placed, position, row_share, small_batches, stage

#: labelled rows that the model is fitted on, at most (in expectation)
MAX_ROWS = 16_000
#: hash space of the features
BITS = 24
STEM = 4
#: words whose hashes a task keeps at a time
WORDS_KEPT = 1 << 17

ALPHA, BETA, L1, L2 = 2.0, 1.0, 3.0, 1.0
EPOCHS = 6


class _WordHashes(dict):
    """64 bits per word: hash of the word above, hash of its stem below. Emptied when it has grown large."""

    def __missing__(self, word: str) -> int:
        from zlib import crc32

        if len(self) > WORDS_KEPT:
            self.clear()
        value = crc32(word.encode("utf-8", "replace")) << 32 | crc32(b"^" + word[:STEM].encode("utf-8", "replace"))
        self[word] = value
        return value


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def features(text: str, hashes: dict, word) -> np.ndarray:
    """Distinct hashed features of a text: words, stems, pairs of neighbours, pairs with one word between."""
    packed = np.array(list(map(hashes.__getitem__, word.findall(text.lower()))), np.uint64)
    if not len(packed):
        return np.empty(0, np.uint32)
    words, stems = packed >> np.uint64(32), packed & np.uint64(0xFFFFFFFF)
    shifted = words << np.uint64(31)
    parts = [
        _mix(words),
        _mix(stems + np.uint64(1 << 33)),
        _mix(shifted[:-1] + words[1:] + np.uint64(1)),
        _mix(shifted[:-2] + words[2:] + np.uint64(2)),
    ]
    return np.unique((np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.uint32))


def _tools():
    import re

    return _WordHashes(), re.compile(r"[^\W_]+")


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[float, np.ndarray, np.ndarray]:
    """``(bias, indexes, weights)`` after ``epochs`` passes in the given order.

    Every coordinate has its own rate, alpha / (beta + root of its squared gradients so far), and a weight only once its
    gradients outweigh L1. The bias has no penalty.
    """
    z, n = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32)
    bias_z = bias_n = 0.0
    for _ in range(epochs):
        for at, label in zip(rows, labels):
            own_z, own_n = z[at], n[at]
            root = np.sqrt(own_n)
            weights = np.where(
                np.abs(own_z) <= L1, 0, (np.sign(own_z) * L1 - own_z) / ((BETA + root) / ALPHA + L2)
            )
            bias = -bias_z * ALPHA / (BETA + bias_n**0.5)
            slope = 1 / (1 + np.exp(-np.clip(bias + weights.sum(), -35, 35))) - label
            n[at] = own_n + slope * slope
            z[at] = own_z + slope - (np.sqrt(own_n + slope * slope) - root) / ALPHA * weights
            grown = (bias_n + slope * slope) ** 0.5
            bias_z += slope - (grown - bias_n**0.5) / ALPHA * bias
            bias_n += slope * slope
    kept = np.flatnonzero(np.abs(z) > L1)
    weights = (np.sign(z[kept]) * L1 - z[kept]) / ((BETA + np.sqrt(n[kept])) / ALPHA + L2)
    return float(-bias_z * ALPHA / (BETA + bias_n**0.5)), kept.astype(np.int64), weights.astype(np.float64)


@dataclass
class ToxicityModel:
    """A bias and the few weights that are not zero."""

    bias: float
    indexes: np.ndarray
    weights: np.ndarray

    def score(self, text: Column) -> Column:
        """Probability of the label 1 for a text column; NULL counts as the empty text, which scores by the bias alone."""
        bias, indexes, weights = self.bias, self.indexes, self.weights

        def weigh(found: np.ndarray) -> float:
            if not len(found):
                return 0.0
            place = np.minimum(np.searchsorted(found, indexes), len(found) - 1)
            return float(weights[found[place] == indexes].sum())

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            hashes, word = _tools()
            for batch in batches:
                sums = [bias + weigh(features(bytes(v).decode("utf-8", "replace"), hashes, word)) for v in batch]
                yield pd.Series(1 / (1 + np.exp(-np.clip(np.array(sums, float), -35, 35))))

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "double")(as_bytes(text))


def fit_toxicity(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_rows: int = MAX_ROWS,
) -> ToxicityModel:
    """A model from a sample of about ``max_rows`` labelled documents at most, drawn by a hash of the id.

    The sampled labels, bounded like the sample, are broadcast to the documents. Tasks turn texts into hashed features;
    one task passes over these in the order of the hash, so the model does not depend on the layout.
    Only weights that are not zero reach the driver. Rows with NULL id or label are left out; of several labels of one id the
    largest counts. Without any label the model scores 0.5 less a bit, and rejects nothing.
    """
    spark = df.sparkSession
    known = inputs(labels, doc_id=id_col, label=label_col).filter("doc_id is not null and label is not null")
    known = known.groupBy("doc_id").agg((F.max("label") > 0).cast("int").alias("label"))
    count = known.count()
    if not count:
        return ToxicityModel(-1e-6, np.empty(0, np.int64), np.empty(0))
    sample = known.filter(row_share(F.col("doc_id"), min(1.0, max_rows / count), "toxicity"))
    rows = inputs(df, doc_id=id_col, text=text_col).join(F.broadcast(sample), "doc_id")
    rows = rows.select(F.xxhash64("doc_id").alias("turn"), "label", as_bytes(F.col("text")).alias("text"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, word = _tools()
        for batch in batches:
            batch["text"] = [features(bytes(v).decode("utf-8", "replace"), hashes, word).tobytes() for v in batch["text"]]
            yield batch

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[tuple[int, int, bytes]] = []
        for batch in batches:
            kept += zip(batch["turn"].tolist(), batch["label"].tolist(), map(bytes, batch["text"]))
        if kept:
            kept.sort()
            found = [np.frombuffer(value, np.uint32) for _, _, value in kept]
            bias, indexes, weights = ftrl(found, np.array([label for _, label, _ in kept], float))
            yield pd.DataFrame({"index": [-1, *indexes], "weight": [bias, *weights]})

    staged = stage(small_batches(rows).mapInPandas(hashed, rows.schema), "toxicity-features")
    fitted = small_batches(staged).coalesce(1).mapInPandas(train, "index bigint, weight double").toPandas().sort_values("index")
    if fitted.empty:
        return ToxicityModel(-1e-6, np.empty(0, np.int64), np.empty(0))
    return ToxicityModel(
        float(fitted["weight"].iloc[0]), fitted["index"].to_numpy()[1:], fitted["weight"].to_numpy()[1:]
    )


def score_toxicity(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, predicted)`` per row, from the whole text. Rows are independent: no shuffle.

    NULL and empty texts score by the bias alone; very long texts count whole; rows that repeat id or text, and NULL ids, are scored each. An
    empty table gives an empty result.
    """
    rows = small_batches(inputs(df, doc_id=id_col, text=text_col)).select("doc_id", model.score(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``df`` without the rows that the model predicts as toxic; all columns stay.

    NULL and empty texts go only if the bias alone says so. Rows are judged each, whatever their id; an empty table stays empty.
    """
    rows = small_batches(placed(df))
    return rows.filter(model.score(rows[f"_c{position(df, text_col)}"]) < 0.5).toDF(*df.columns)
