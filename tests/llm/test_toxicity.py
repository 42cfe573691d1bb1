import random
import re
from math import exp, sqrt

import numpy as np
from pyspark.sql import functions as F

from propensity.llm import toxicity
from propensity.llm.toxicity import drop_toxic, features, fit_toxicity, ftrl, score_toxicity

DOCS, LABELS = "doc_id bigint, text string, source string", "doc_id bigint, toxic int"


def labelled(count=400):
    source = random.Random(5)
    rows, labels = [], []
    for i in range(count):
        text = [f"plain{source.randrange(60)}" for _ in range(source.randrange(5, 40))]
        bad = i % 5 == 0
        if bad:
            text.insert(source.randrange(len(text)), "rotten" if i % 2 else "vileness")
        rows.append((i, " ".join(text), "s"))
        labels.append((i, int(bad)))
    return rows, labels


def plain_ftrl(rows, labels, epochs):
    """The textbook update, one coordinate at a time."""
    z, n, bias = {}, {}, [0.0, 0.0]
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2

    def weight(i):
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - (l1 if zi > 0 else -l1)) / ((b + sqrt(n[i])) / a + l2)

    for _ in range(epochs):
        for row, label in zip(rows, labels):
            own = {i: weight(i) for i in row.tolist()}
            own_bias = -bias[0] * a / (b + sqrt(bias[1]))
            slope = 1 / (1 + exp(-(own_bias + sum(own.values())))) - label
            for i, w in own.items():
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + slope - (sqrt(old + slope**2) - sqrt(old)) / a * w
                n[i] = old + slope**2
            bias[0] += slope - (sqrt(bias[1] + slope**2) - sqrt(bias[1])) / a * own_bias
            bias[1] += slope**2
    return {i: weight(i) for i in z if weight(i)}


def test_updates_equal_the_textbook():
    rows, labels = labelled(120)
    found = [features(text, toxicity._WordHashes(), re.compile(r"[^\W_]+")) for _, text, _ in rows]
    truth = np.array([label for _, label in labels], float)
    _, indexes, weights = ftrl(found, truth, 3)
    expected = plain_ftrl(found, truth, 3)
    assert sorted(expected) == indexes.tolist()
    assert np.allclose(weights, [expected[i] for i in sorted(expected)], rtol=1e-3, atol=1e-3)
    assert 0 < len(indexes) < 500


def test_learns_and_treats_missing_texts(clashing):
    rows, labels = labelled()
    docs = clashing(rows + [(1000, None, "s"), (1001, "", None), (None, "vileness", "s"), (1002, "clean " * 200_000, "s"), (3, "rotten twin of id 3", "s")], DOCS)
    known = clashing(labels + [(1000, 0), (2000, 1), (None, 1), (5, None), (5, 1)], LABELS)
    model = fit_toxicity(docs, known)
    found = score_toxicity(docs, model).collect()
    assert len(found) == len(rows) + 5
    by_id = {r.doc_id: r for r in found if r.doc_id != 3}
    assert all(by_id[i].predicted == label for i, label in labels if i != 3)
    assert by_id[None].predicted == 1 and by_id[1000].score == by_id[1001].score < 0.5 and by_id[1002].predicted == 0
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(1 - r.predicted for r in found)


def test_layout_does_not_matter(spark):
    rows, labels = labelled(150)
    one = fit_toxicity(spark.createDataFrame(rows, DOCS).coalesce(1), spark.createDataFrame(labels, LABELS))
    other = fit_toxicity(spark.createDataFrame(rows[::-1], DOCS).repartition(6), spark.createDataFrame(labels, LABELS))
    assert one.bias == other.bias and np.array_equal(one.weights, other.weights)


def test_no_labels_and_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "text", "s")], DOCS), spark.createDataFrame([], LABELS)
    model = fit_toxicity(docs, none)
    assert score_toxicity(docs, model).first().predicted == 0
    unknown = fit_toxicity(docs, spark.createDataFrame([(5, 1)], LABELS))
    assert score_toxicity(docs.limit(0), unknown).count() == 0


def test_held_out_quality(spark, tables):
    from propensity.llm.queries import op6_toxicity

    folder = tables.replace("0.001", "0.1")
    found = op6_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out")
    clean = found.filter("toxic = 0").agg(F.avg("predicted")).first()[0]
    caught = found.filter("toxic = 1").agg(F.avg("predicted")).first()[0]
    assert clean < 0.01 and caught > 0.7


def plain_features(text):
    """Words, stems, neighbours and pairs around a word, hashed one by one."""
    from zlib import crc32

    full = (1 << 64) - 1

    def mixed(value):
        value &= full
        value = (value ^ value >> 30) * 0xBF58476D1CE4E5B9 & full
        value = (value ^ value >> 27) * 0x94D049BB133111EB & full
        return (value ^ value >> 31) >> 64 - toxicity.BITS

    words = re.findall(r"[^\W_]+", text.lower())
    hashes = [crc32(word.encode()) for word in words]
    found = {mixed(h) for h in hashes} | {mixed(crc32(b"^" + word[: toxicity.STEM].encode()) + (1 << 33)) for word in words}
    found |= {mixed((a << 31) + b + 1) for a, b in zip(hashes, hashes[1:])}
    return np.array(sorted(found | {mixed((a << 31) + b + 2) for a, b in zip(hashes, hashes[2:])}), np.uint32)


def test_query_equals_brute_force(spark, tables):
    """Features one by one and the textbook update over the labelled rows, for every document."""
    import struct
    from zlib import crc32

    from xxhash import xxh64_intdigest

    from propensity.llm.queries import op6_toxicity

    documents = {r.doc_id: plain_features(r.text or "") for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    labels = {
        r.doc_id: int(r.toxic > 0)
        for r in spark.read.parquet(f"{tables}/labels.parquet").collect()
        if r.toxic is not None and crc32(str(r.doc_id).encode()) % 5 != 0 and r.doc_id in documents
    }

    def turn(doc_id):
        mixed = xxh64_intdigest(struct.pack("<q", doc_id), 42)
        return mixed - (1 << 64) if mixed >> 63 else mixed

    order = sorted(labels, key=turn)
    rows, truth = [documents[doc_id] for doc_id in order], np.array([labels[doc_id] for doc_id in order], float)
    weights = plain_ftrl(rows, truth, toxicity.EPOCHS)
    bias = ftrl(rows, truth)[0]  # the bias has no plain version of its own; the updates are compared above
    found = op6_toxicity(spark, tables).collect()
    assert len(found) == len(documents)
    for r in found:
        score = 1 / (1 + exp(-(bias + sum(weights.get(i, 0.0) for i in documents[r.doc_id].tolist()))))
        assert r.held_out == (crc32(str(r.doc_id).encode()) % 5 == 0)
        assert abs(r.score - score) < 2e-3 and r.predicted == int(r.score >= 0.5)
