"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from propensity.llm.common import as_bytes, inputs, small_batches

#: n-grams in a profile, of a language as of a document
PROFILE = 300
#: documents per language that a profile is learned from, at most (in expectation)
ROWS_PER_LANGUAGE = 2_000
#: more languages than this are refused
MAX_LANGUAGES = 10_000
UNKNOWN = "und"

SPACE = 32
STEP = 1 << 20


def letter_bits() -> bytes:
    """One bit per code point: whether it is a letter."""
    return np.packbits(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)).tobytes()


def letter_table(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=0x110000).astype(bool)


def gram_counts(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 1- to 3-grams of a text, packed into integers of 21 bits per character, and their counts.

    Case is folded to lower; runs of anything but letters become one space, and so do both ends. N-grams lie within a word and
    its two spaces. Keys are counted in steps, so that a very long text needs no more than its characters in memory.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    codes = np.where(letters[codes], codes, SPACE)
    codes = np.concatenate(([SPACE], codes, [SPACE])).astype(np.int64)
    gap = codes == SPACE
    codes = codes[~gap | np.concatenate(([True], ~gap[:-1]))]
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for start in range(0, len(codes), STEP):
        one = codes[start : start + STEP + 2]
        own = min(STEP, len(one))
        single = one[:own]
        found = [single[single != SPACE]]
        two = (one[:-1] << 21 | one[1:])[:own]
        found.append(two)
        three = one[:-2] << 42 | one[1:-1] << 21 | one[2:]
        found.append(three[one[1:-1] != SPACE][:own])
        step_keys, step_counts = np.unique(np.concatenate(found), return_counts=True)
        if not len(keys):
            keys, counts = step_keys, step_counts
        else:
            both = np.concatenate((keys, step_keys))
            keys, place = np.unique(both, return_inverse=True)
            counts = np.bincount(place, np.concatenate((counts, step_counts))).astype(np.int64)
    return keys, counts


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent keys, most frequent first, ties by key."""
    return keys[np.lexsort((keys, -counts))[:size]]


@dataclass
class LanguageProfiles:
    """Ranked n-grams per language; ``predict`` compares documents with them."""

    languages: list[str]
    grams: list[np.ndarray]
    size: int = PROFILE

    def __post_init__(self):
        self.union = np.unique(np.concatenate(self.grams)) if self.grams else np.empty(0, np.int64)
        self.ranks = np.full((len(self.union) + 1, len(self.languages)), -1, np.int64)
        for i, grams in enumerate(self.grams):
            self.ranks[np.searchsorted(self.union, grams), i] = np.arange(len(grams))

    def nearest(self, text: str, letters: np.ndarray) -> tuple[str, float]:
        """Language of the smallest out-of-place distance, and 1 minus that distance as a share of the largest possible one."""
        keys, counts = gram_counts(text, letters)
        if not len(self.languages) or not (keys < 1 << 21).any():
            return UNKNOWN, 0.0
        top = ranked(keys, counts, self.size)
        place = np.minimum(np.searchsorted(self.union, top), len(self.union) - 1)
        place = np.where(self.union[place] == top, place, len(self.union))
        ranks = self.ranks[place]
        apart = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top))[:, None])).sum(axis=0)
        best = int(apart.argmin())
        return self.languages[best], float(1 - apart[best] / (self.size * len(top)))

    def predict(self, text: Column) -> Column:
        """Struct ``(lang, score)`` of a text column; ``und`` with score 0 for NULL and for texts without a letter."""
        profiles, bits = self, letter_bits()

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            letters = letter_table(bits)
            for batch in batches:
                found = [profiles.nearest(bytes(value).decode("utf-8", "replace"), letters) for value in batch]
                yield pd.DataFrame(found, columns=["lang", "score"])

        run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
        return F.pandas_udf(run, "lang string, score double")(as_bytes(text))


def fit_profiles(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    rows_per_language: int = ROWS_PER_LANGUAGE,
    size: int = PROFILE,
) -> LanguageProfiles:
    """Profiles of the languages in ``df``, each from a sample of about ``rows_per_language`` of its rows at most.

    The sample is drawn by a hash of the id, so it does not depend on the layout. Tasks count n-grams of their rows; counts are
    added up by key, and the top of each language, ``size`` rows, goes to the driver. Rows with NULL text or language are left out.
    """
    rows = inputs(df, id=id_col, text=text_col, lang=lang_col).filter("text is not null and lang is not null")
    counted = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    if len(counted) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counted:
        return LanguageProfiles([], [], size)
    steps = 1 << 30
    shares = [(row["lang"], int(min(1.0, rows_per_language / row["n"]) * steps)) for row in counted]
    shares = df.sparkSession.createDataFrame(shares, "lang string, share bigint")
    mixed = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("language")), F.lit(steps))
    sample = rows.join(F.broadcast(shares), "lang").filter(mixed < F.col("share"))
    bits = letter_bits()

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = letter_table(bits)
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                found = [gram_counts(bytes(text).decode("utf-8", "replace"), letters) for text in texts]
                keys, place = np.unique(np.concatenate([keys for keys, _ in found]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([counts for _, counts in found])).astype(np.int64)
                yield pd.DataFrame({"lang": lang, "gram": keys, "n": counts})

    sample = small_batches(sample.select("lang", as_bytes(F.col("text")).alias("text")))
    grams = sample.mapInPandas(count, "lang string, gram bigint, n bigint")
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = (
        grams.groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= size)
        .collect()
    )
    languages = sorted({row["lang"] for row in top})
    ordered = sorted(top, key=lambda row: row["place"])
    return LanguageProfiles(
        languages, [np.array([r["gram"] for r in ordered if r["lang"] == lang], np.int64) for lang in languages], size
    )


def identify_languages(
    df: DataFrame, profiles: LanguageProfiles, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, lang_pred, score)`` per row, from the whole text. Rows are independent: no shuffle.

    Ties go to the language that sorts first. NULL and empty texts, and those without a letter, are ``und`` with score 0; very long texts count
    whole, in steps; rows that repeat id or text are judged each. Without profiles every row is ``und``; an empty table gives an empty result.
    """
    rows = inputs(df, doc_id=id_col, text=text_col)
    found = small_batches(rows).select("doc_id", profiles.predict(F.col("text")).alias("found"))
    return found.select("doc_id", F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
