from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from propensity.llm import langid
from propensity.llm.common import key_remainder
from propensity.llm.langid import LanguageProfiles, fit_profiles, gram_counts, identify_languages, letter_bits, letter_table

SCHEMA = "doc_id bigint, text string, lang string"
SAMPLES = {
    "en": "the quick brown fox jumps over the lazy dog and then it runs away with that thing",
    "de": "der schnelle braune fuchs springt über den faulen hund und läuft dann schnell davon",
    "fr": "le rapide renard brun saute par-dessus le chien paresseux et puis il s'en va très vite",
}


@pytest.fixture(scope="module")
def letters():
    return letter_table(letter_bits())


def plain_counts(text):
    """Counts by slicing strings."""
    text = "".join(c if c.isalpha() else " " for c in text.lower())
    text = " " + " ".join(text.split(" ")) + " "
    while "  " in text:
        text = text.replace("  ", " ")
    found = Counter()
    for n in (1, 2, 3):
        for i in range(len(text) - n + 1):
            gram = text[i : i + n]
            if gram != " " and not (n == 3 and gram[1] == " ") and not (n == 2 and gram == "  "):
                found[gram] += 1
    return found


def unpacked(key):
    return "".join(chr(c) for c in (key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF) if c)


@pytest.mark.parametrize("text", ["Hello, World!", "  a  b1c\n", "ÜBER straße", "日本語 text 🎉 x", "İstanbul", "x" * 100, *SAMPLES.values()])
def test_counts_equal_plain_slicing(letters, text):
    keys, counts = gram_counts(text, letters)
    assert {unpacked(int(k)): int(n) for k, n in zip(keys, counts)} == plain_counts(text)


@pytest.mark.parametrize("step", [3, 7, 50])
def test_counting_in_steps_changes_nothing(letters, monkeypatch, step):
    text = " ".join(SAMPLES.values()) * 3
    whole = gram_counts(text, letters)
    monkeypatch.setattr(langid, "STEP", step)
    for one, other in zip(whole, gram_counts(text, letters)):
        assert np.array_equal(one, other)


def test_distance_equals_plain_definition(letters):
    def profile(text):
        found = plain_counts(text)
        return sorted(found, key=lambda g: (-found[g], sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))))[:40]

    def packed(gram):
        return sum(ord(c) << 21 * (len(gram) - 1 - i) for i, c in enumerate(gram))

    names = sorted(SAMPLES)
    model = LanguageProfiles(names, [np.array([packed(g) for g in profile(SAMPLES[n])]) for n in names], 40)
    for text in ("the dog runs", "den hund und", "il va vite", "zzz qqq", "thing"):
        mine = profile(text)
        apart = {}
        for name in names:
            theirs = profile(SAMPLES[name])
            apart[name] = sum(abs(i - theirs.index(g)) if g in theirs else 40 for i, g in enumerate(mine))
        best = min(names, key=lambda n: (apart[n], n))
        lang, score = model.nearest(text, letters)
        assert lang == best and score == pytest.approx(1 - apart[best] / (40 * len(mine)))


def test_nulls_letters_and_clashes(clashing):
    rows = [(i, text, lang) for i, (lang, text) in enumerate(SAMPLES.items())]
    rows += [(10, None, "en"), (11, "", "de"), (12, "123 !? 🎉", "fr"), (13, "the dog", None), (None, "der hund", None), (0, SAMPLES["en"], "en")]
    table = clashing(rows, SCHEMA)
    found = {r.doc_id: r for r in identify_languages(table, fit_profiles(table)).collect()}
    assert [found[i].lang_pred for i in range(3)] == list(SAMPLES) and found[13].lang_pred == "en" and found[None].lang_pred == "de"
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (10, 11, 12))


def test_nothing_to_learn_and_empty_table(spark):
    table = spark.createDataFrame([(1, "some text", None)], SCHEMA)
    assert identify_languages(table, fit_profiles(table)).first().lang_pred == "und"
    assert identify_languages(table.limit(0), fit_profiles(table.limit(0))).count() == 0


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    table = spark.createDataFrame([(i, "abc", str(i)) for i in range(3)], SCHEMA)
    with pytest.raises(ValueError):
        fit_profiles(table)


def test_held_out_accuracy(spark, tables):
    from propensity.llm.queries import op1_language_id

    truth = spark.read.parquet(f"{tables.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "lang")
    found = op1_language_id(spark, tables.replace("0.001", "0.01")).join(truth, "doc_id")
    assert found.filter(F.col("held_out") != (key_remainder(F.col("doc_id"), 3) == 1)).count() == 0
    right = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97
    assert found.filter("score < 0 or score > 1").count() == 0


def test_query_equals_brute_force(spark, tables):
    """Profiles and distances by slicing strings, for every document."""
    from zlib import crc32

    from propensity.llm.queries import op1_language_id

    def packed(gram):
        key = 0
        for character in gram:
            key = key << 21 | ord(character)
        return key

    def top(counts):
        return sorted(counts, key=lambda gram: (-counts[gram], packed(gram)))[: langid.PROFILE]

    documents = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", "lang").collect()
    counted = {doc_id: plain_counts(text or "") for doc_id, text, _ in documents}
    sums = {}
    for doc_id, text, lang in documents:
        if crc32(str(doc_id).encode()) % 3 != 1 and text is not None and lang is not None:
            sums.setdefault(lang, Counter()).update(counted[doc_id])
    profiles = {lang: {gram: rank for rank, gram in enumerate(top(sums[lang]))} for lang in sorted(sums)}
    expected = {}
    for doc_id, text, _ in documents:
        grams = top(counted[doc_id])
        if not any(c.isalpha() for c in text or ""):
            expected[doc_id] = ("und", 0.0)
            continue
        apart = {
            lang: sum(abs(ranks[g] - i) if g in ranks else langid.PROFILE for i, g in enumerate(grams)) for lang, ranks in profiles.items()
        }
        best = min(apart, key=lambda lang: (apart[lang], lang))
        expected[doc_id] = (best, 1 - apart[best] / (langid.PROFILE * len(grams)))
    found = op1_language_id(spark, tables).collect()
    assert len(found) == len(documents)
    for r in found:
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1)
        assert (r.lang_pred, r.score) == (expected[r.doc_id][0], pytest.approx(expected[r.doc_id][1], abs=1e-12))


def test_very_long_and_repeated_rows(clashing, letters):
    text = "ein sehr langer text " * 60_000
    profiles = LanguageProfiles(["de"], [langid.ranked(*gram_counts(SAMPLES["de"], letters), langid.PROFILE)])
    found = identify_languages(clashing([(1, text, None), (1, text, None), (2, text[:4000], None)], SCHEMA), profiles).collect()
    assert [(r.doc_id, r.lang_pred) for r in sorted(found)] == [(1, "de"), (1, "de"), (2, "de")] and found[0].score == found[1].score
