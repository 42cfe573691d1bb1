import hashlib

import numpy as np
import pytest

from propensity.llm.bpe import decode, encode, encode_and_decode, encode_text, encoding, safe_pieces

SCHEMA = "doc_id bigint, text string"
TEXTS = [
    None, "", " ", "\n\n \t", "Hello world's end, it'll do 'tis", "<|endoftext|> is text", "émoji 🎉🎉 日本語 テスト", "a" * 5000,
    "x  y   z    " * 9, "  wide\u0085spaces ", "1234567890" * 50, "'s't're" * 10, "\x00\x01 control", "é combining",
]


def test_ids_are_those_of_the_library(clashing):
    enc = encoding()
    rows = list(enumerate(TEXTS))
    for r in encode_and_decode(clashing(rows, SCHEMA)).collect():
        text = TEXTS[r.id] or ""
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == enc.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()


@pytest.mark.parametrize("text", [
    "word " * 40_000, "no-break" * 30_000, ("a" * 70_000 + " ") * 3, "x" + " " * 9000 + "y " * 40_000, " " * 70_000, "\n" * 9000 + " tail" * 20_000,
    "é ü ß\n" * 20_000, "don't  we'll\n\n\n x" * 8_000, "q" * 66_000 + "\t" * 5000 + " end",
])
def test_long_texts_are_cut_at_safe_boundaries(text):
    enc = encoding()
    assert encode_text(enc, text) == enc.encode_ordinary(text)
    assert "".join(piece for piece, _ in safe_pieces(text)) == text


def test_run_of_space_beyond_the_pattern_engine():
    enc = encoding()
    text = "start" + "\n" * 3_000_000 + "end"
    assert enc.decode(encode_text(enc, text)) == text


def test_decode_alone_and_ids_of_any_size(spark):
    packed = spark.createDataFrame([(1, np.array([31373, 995], "<u4").tobytes()), (2, None), (3, b"")], "id int, ids binary")
    assert {r.id: bytes(r.decoded) for r in decode(packed).collect()} == {1: b"hello world", 2: b"", 3: b""}


def test_ill_formed_text_and_repeated_rows(spark):
    table = spark.createDataFrame([(1,), (1,), (None,)], "doc_id bigint").selectExpr("doc_id", "cast(X'61FF62' as string) as text")
    found = encode(table).collect()
    assert len(found) == 3 and len({bytes(r.ids) for r in found}) == 1


def test_empty_table(spark):
    assert encode_and_decode(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_digests(spark, tables):
    from propensity.llm.queries import op2_byte_bpe

    enc = encoding()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    found = op2_byte_bpe(spark, tables).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
