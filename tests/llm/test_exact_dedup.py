import hashlib
from collections import defaultdict

from propensity.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

SCHEMA = "doc_id bigint, text string, lang string"


def test_groups_of_all_kinds(clashing):
    long = "x" * 1_500_000
    rows = [
        (1, "same", None), (2, "same", "en"), (7, "same", "en"), (3, "other", "en"), (4, None, None), (5, "", "en"), (6, long, "en"),
        (8, long, "de"), (9, long[:-1] + "y", "de"), (10, "émoji 🎉", "fr"), (11, "émoji 🎉", "fr"), (12, "x" * 1_500_001, "en"),
        (None, "same", "en"), (None, "lonely", "en"), (13, "twice", "en"), (13, "twice", "en"),
    ]
    result = exact_duplicates(clashing(rows, SCHEMA), digest_all=True).collect()
    groups = defaultdict(list)
    for doc_id, text, _ in rows:
        groups[text or ""].append(doc_id)
    expected = []
    for doc_id, text, _ in rows:
        own = groups[text or ""]
        keep = max((i for i in own if i is not None), default=None)
        expected.append((doc_id, keep, len(own), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, result), key=repr) == sorted(expected, key=repr)


def test_digests_only_where_needed(spark):
    rows = [(1, "aa", ""), (2, "bb", ""), (3, "bb", ""), (4, "single length", "")]
    found = {r.doc_id: r.text_sha256 for r in exact_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[4] is None and found[1] is None and found[2] == found[3] == hashlib.sha256(b"bb").hexdigest()


def test_shared_buckets_lose_nothing(spark):
    rows = [(i, f"{'p' * 300}{i % 7}", "") for i in range(50)]
    found = exact_duplicates(spark.createDataFrame(rows, SCHEMA), length_classes=2, prefix_buckets=1)
    assert {(r.doc_id, r.group_size) for r in found.collect()} == {(i, len(range(i % 7, 50, 7))) for i in range(50)}


def test_drop_keeps_columns_and_unrelated_rows(clashing):
    rows = [(1, "same", "en"), (2, "same", "de"), (1, "own text of a repeated id", "en"), (None, "same", "fr"), (None, None, None)]
    table = clashing(rows, SCHEMA)
    kept = drop_exact_duplicates(table)
    assert kept.columns == table.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect() if r.text) == [
        (0, "same"), (1, "own text of a repeated id"), (2, "same"),
    ]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_duplicates(empty).count() == 0 and drop_exact_duplicates(empty).count() == 0


def test_rows_that_repeat_id_and_text_leave_one(spark):
    rows = [(13, "twice", "en")] * 50 + [(None, "n", "en")] * 50 + [(None, "twice", "en"), (13, "other", "en"), (14, None, None), (14, "", "x")]
    table = spark.createDataFrame(rows, SCHEMA).repartition(6)
    kept = sorted(((r.doc_id, r.text or "") for r in drop_exact_duplicates(table).collect()), key=repr)
    assert kept == sorted([(13, "twice"), (None, "n"), (None, "twice"), (13, "other"), (14, "")], key=repr)


def test_settled_texts_are_not_hashed_whole(spark, monkeypatch):
    from propensity.llm import exact_dedup

    staged = {}
    stage = exact_dedup.stage
    monkeypatch.setattr(exact_dedup, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    rows = [(1, "alone"), (2, "one pair"), (3, "one pair"), (4, "same siz"), (5, None)]
    groups = exact_dedup._grouped(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text")
    assert {r.doc_id for r in staged["dedup-digests"].filter("digest is not null or text_hash is not null").collect()} == {2, 3}
    assert groups.filter("kept").count() == 4
