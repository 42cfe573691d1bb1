import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from propensity.llm.token_files import (
    CHUNK_TOKENS, END_ID, TOKENIZER_FILE, Encoder, id_width, read_token_files, token_file_round_trip, with_bases, write_token_files,
)
from propensity.session import scratch_path

SCHEMA = "doc_id bigint, text string"
LIBRARY = Tokenizer.from_file(public_tokenizers.path(TOKENIZER_FILE))
TEXTS = ["two words", "", None, "É é ΣΑΣ don't", "<|endoftext|> x", "long " * 30_000, "a" * 3000, "\x00   tab\t", "日本語 🎉"]


@pytest.fixture
def many_parts(spark):
    """Small partitions stay apart, as they are at full size."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, "true")


def packed(encode, texts):
    return encode(pa.array(texts, pa.string())).to_pylist()


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, END_ID]


def expected(rows):
    """Documents in ascending order with the start of each; ids that repeat are in any order, so lengths must agree."""
    start, found = 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        found.append((doc, start, ids_of(text)))
        start += len(found[-1][2])
    return found


def unpacked(rows):
    return sorted(((r.doc_id, r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in rows), key=lambda r: r[1])


def test_round_trip_in_order_of_ids(clashing):
    rows = [(50 - i, text) for i, text in enumerate(TEXTS)]
    assert unpacked(token_file_round_trip(clashing(rows, SCHEMA)).collect()) == expected(rows)


def test_null_and_repeated_ids(spark):
    rows = [(None, "none"), (3, "same words"), (3, "same words"), (None, "none"), (1, "one"), (3, "other and more words"), (-7, "first")]
    found = unpacked(token_file_round_trip(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect())
    assert [doc for doc, _, _ in found] == [None, None, -7, 1, 3, 3, 3]
    assert sorted((doc is None, doc or 0, ids) for doc, _, ids in found) == sorted((d is None, d or 0, ids_of(t)) for d, t in rows)
    ends = [start + len(ids) for _, start, ids in found]
    assert [start for _, start, _ in found] == [0, *ends[:-1]]


def test_one_id_is_dealt_to_many_parts(spark, many_parts):
    rows = spark.range(4000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "'the very same text' as text")
    files = write_token_files(rows, scratch_path(spark, "tokens-test"))
    most = files.groupBy("part").agg({"docs": "sum"}).collect()
    assert len(most) > 4 and max(r[1] for r in most) < 1200
    found = unpacked(read_token_files(spark, files).collect())
    assert [d for d, _, _ in found] == sorted([7] * 1334 + [i for i in range(4000) if i % 3])


def test_parts_have_bases_and_files_are_as_described(spark, many_parts):
    rows = [(i, "word " * (i % 50)) for i in range(300)]
    folder = scratch_path(spark, "tokens-test")
    files = with_bases(write_token_files(spark.createDataFrame(rows, SCHEMA), folder)).orderBy("part", "first_doc").collect()
    assert len({f.part for f in files}) > 1 and id_width() == 2
    stream, docs = [], []
    for f in files:
        stem = f.stem.removeprefix("file:")
        ids, offsets = np.fromfile(f"{stem}.tok", "<u2"), np.fromfile(f"{stem}.off", "<i8")
        assert f.base == len(stream) and len(ids) == f.tokens == offsets[-1] and len(offsets) == f.docs + 1
        stream += ids.tolist()
        docs += np.fromfile(f"{stem}.doc", "<i8").tolist()
    assert docs == list(range(300)) and stream == sum((ids_of(text) for _, text in rows), [])


def test_entries_cut_long_parts_between_documents(spark, monkeypatch):
    from propensity.llm import token_files

    monkeypatch.setattr(token_files, "CHUNK_TOKENS", 50)
    rows = [(i, "word " * (i % 70)) for i in range(60)]
    files = write_token_files(spark.createDataFrame(rows, SCHEMA), scratch_path(spark, "tokens-test"))
    assert files.count() > 25 and files.filter("docs > 1 and tokens > 50").isEmpty() and CHUNK_TOKENS > 50
    assert unpacked(read_token_files(spark, files).collect()) == expected(rows)


@pytest.mark.parametrize("text", [
    "word " * 40_000, "no-break" * 30_000, ("a" * 70_000 + "\n") * 2, "ΟΔΟΣ " * 30_000, "x́ ́y" * 20_000, " " * 200_000, "it's  we'll\t\n" * 12_000,
])
def test_long_texts_are_cut_without_a_trace(text):
    assert np.frombuffer(packed(Encoder(None, 2), [text])[0], "<u2").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@given(st.lists(st.text(st.sampled_from("ab Σσ'sé\u0301\u0308\u1100\u1161 \n\t\x85\u2028\u00a0\x1cİ10!.,AB<|endoftext|>日🎉"), max_size=60), max_size=4))
@settings(max_examples=300, deadline=None)
def test_words_are_encoded_as_in_their_text(texts):
    found = packed(Encoder(None, 2), texts)
    assert [np.frombuffer(ids, "<u2").tolist() for ids in found] == [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_cache_is_bounded(monkeypatch):
    from propensity.llm import token_files

    monkeypatch.setattr(token_files, "CACHED", 10)
    encode = Encoder(None, 4)
    for start in range(0, 300, 3):
        texts = [f"w{i} again x{i}" for i in range(start, start + 3)] + ["y" * 100]
        assert [np.frombuffer(ids, "<u4").tolist() for ids in packed(encode, texts)] == [LIBRARY.encode(t).ids for t in texts]
        assert len(encode.known) < 30 and "y" * 100 not in encode.known


def test_ill_formed_text(spark):
    table = spark.range(1).selectExpr("id as doc_id", "cast(X'61FF62' as string) as text")
    assert unpacked(token_file_round_trip(table).collect()) == [(0, 0, ids_of("a�b"))]


def test_empty_table(spark):
    assert token_file_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_over_the_whole_table(spark, tables):
    from propensity.llm.queries import op13_token_files

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    found = [tuple(r) for r in op13_token_files(spark, tables).orderBy("doc_id").collect()]
    assert found == [(doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for doc, start, ids in expected(rows)]
