import math
import random
import re
from collections import Counter

import numpy as np

from propensity.llm import lexical_search
from propensity.llm.lexical_search import (
    LEVELS, Items, bit_places, block_sizes, build_index, document_keys, level_keys, search, signature_width, slice_block, terms_of,
)

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items, top=10):
    counted = [(doc, Counter(plain_terms(text))) for doc, text in docs]
    counted = [(doc, c, sum(c.values())) for doc, c in counted if c]
    documents, length = len(counted), sum(n for _, _, n in counted)
    holding = Counter(term for _, c, _ in counted for term in c)
    found = []
    for item, text in items:
        scored = []
        for doc, c, n in counted:
            m = 100 - 90 + (90 * n * documents) // length
            score = sum(
                math.floor(1000 * math.log((2 * documents + 2) / (2 * holding[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in set(plain_terms(text)) if c[t]
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        scored.sort(key=lambda s: s[:3])
        found += [(item, rank, s[3], -s[0]) for rank, s in enumerate(scored[:top], 1)]
    return sorted(found, key=repr)


def rows_of(found):
    return sorted(map(tuple, found.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def some_docs(count, seed=3):
    source = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shares = [1 / (i + 1) for i in range(400)]
    return [(i, " ".join(source.choices(vocabulary, shares, k=source.choice([3, 20, 60, 400])))) for i in range(count)]


def some_items(docs, seed=4):
    source = random.Random(seed)
    return [(i, " ".join(source.sample(source.choice(docs)[1].split(), 3) + [f"w{source.randrange(400)}", "unknown"])) for i in range(25)]


def test_equals_brute_force(spark):
    docs = some_docs(900)
    items = some_items(docs)
    found = search(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(items, ITEMS))
    assert rows_of(found) == brute_force(docs, items)


def test_full_signatures_and_few_seeds_change_nothing(spark, monkeypatch):
    docs = some_docs(400)
    items = some_items(docs)
    for name, value in {"DENSITY": 0.9, "PROBES": 1, "SEEDS": 10, "BLOCK": 24, "GATHER": 100, "QUERY_TERMS": 30}.items():
        monkeypatch.setattr(lexical_search, name, value)
    found = search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    assert rows_of(found) == brute_force(docs, items)


def test_odd_rows_and_clashing_columns(clashing):
    docs = [
        (1, None), (2, ""), (3, " ,.-\n"), (4, "Wort wort WORT"), (5, "wort"), (5, "wort"), (5, "other wort"), (None, "wort und mehr"), (7, "ÄPFEL äpfel İ"),
        (8, "x " * 30_000 + "wort"), (9, "日本語 wort9"), (10, "tie"), (11, "tie"), (12, "tie"), (13, "one\x00two\x7fthree"), (14, "wort und mehr"),
    ]
    items = [(1, "WORT"), (1, "tie"), (2, None), (3, "..."), (4, "nowhere"), (None, "Äpfel 日本語 two"), (5, "wort wort tie x")]
    found = search(clashing(docs, DOCS), clashing(items, ITEMS))
    assert rows_of(found) == brute_force(docs, items)


def test_many_ties_are_settled_by_id(spark):
    docs = [(1000 - i, "the very same copy") for i in range(300)] + some_docs(50)
    items = [(0, "copy"), (1, "same w1")]
    assert rows_of(search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))) == brute_force(docs, items)


def test_empty_tables(spark):
    some, none = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "a")], ITEMS)
    assert search(none, items).count() == 0
    assert search(some, spark.createDataFrame([], ITEMS)).count() == 0
    assert search(spark.createDataFrame([(1, None)], DOCS), items).count() == 0


def test_terms_are_those_of_the_rule():
    source = random.Random(9)
    for _ in range(300):
        text = "".join(source.choice("aZ09/:@[`{\x7f\x80é日🎉 \n\x00  ") for _ in range(40))
        assert [t.decode() for t in terms_of(text.encode())] == plain_terms(text)


def test_a_bound_is_never_below_the_score():
    docs = [(i, text.encode()) for i, text in some_docs(200, seed=8)]
    keys = [document_keys(terms_of(text)) for _, text in docs]
    items = Items([(i, sorted(set(terms_of(text.encode())))) for i, text in some_items(some_docs(200, seed=8))])
    lengths = [len(terms_of(text)) for _, text in docs]
    items.weigh(len(docs), sum(lengths), {i: 1 + i % 150 for i in range(len(items.terms))})
    width = signature_width(max(map(len, keys)))
    bounds = items.upper_bounds(lengths, width, slice_block(keys, width))
    exact = np.array([items.scores(terms_of(text), range(len(items.ids))) for _, text in docs]).T
    assert (exact <= bounds).all()
    assert (bounds > 0).sum() < 1.05 * (exact > 0).sum()


def test_slices_hold_every_key_and_few_others():
    terms = [[b"t%d" % (j * j % 97 + i) for j in range(60)] for i in range(20)]
    keys = [document_keys(t) for t in terms]
    width = signature_width(max(map(len, keys)))
    sliced = np.frombuffer(slice_block(keys, width), np.uint8).reshape(width, -1)
    wrong = 0
    for name in range(150):
        hits = np.unpackbits(np.bitwise_and.reduce(sliced[bit_places(level_keys([b"t%d" % name])[0], width)[0]], axis=0), count=20)
        held = np.array([b"t%d" % name in t for t in terms])
        assert hits[held].all()
        wrong += hits[~held].sum()
    assert wrong < 30
    assert len(document_keys([b"a"] * 70)) == len(LEVELS) and np.unpackbits(sliced).mean() < 0.25


def test_blocks_are_of_like_lengths_and_cover_all():
    counts = sorted(random.Random(2).choices([1, 10, 300, 5000, 3_000_000], k=5000))
    blocks = list(block_sizes(counts))
    assert [start for start, _, _ in blocks] == [0, *(end for _, end, _ in blocks[:-1])] and blocks[-1][1] == len(counts)
    for start, end, width in blocks:
        assert end - start == 1 or (width * (end - start) <= lexical_search.BLOCK_BITS and counts[end - 1] <= 2 * counts[start] + 64)


def test_nothing_is_shuffled_for_the_index(spark, tables):
    rows = spark.read.parquet(f"{tables}/documents.parquet").selectExpr("doc_id as id", "xxhash64(text) as text_hash", "cast(text as binary) as text")
    index = build_index(rows)
    assert index.selectExpr("sum(size(ids)) as n").first().n == rows.filter("octet_length(text) > 0").count()
