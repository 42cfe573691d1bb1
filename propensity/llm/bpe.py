"""Byte-level BPE with the tiktoken library and a local rank file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from propensity.llm.common import as_bytes, inputs, pieces, small_batches

RANK_FILE = "byte_bpe_50k.tiktoken"
#: texts beyond this many characters are cut at safe boundaries before they are encoded
LONG_TEXT = 1 << 16
#: runs of white space from this length on are encoded as the single matches that they are
LONG_SPACE = 1 << 12


def encoding(rank_path: str | None = None):
    """The tiktoken encoding of a rank file, loaded once per Python worker and kept in the library's own registry."""
    import base64

    import public_tokenizers
    from tiktoken import Encoding
    from tiktoken.registry import ENCODINGS

    rank_path = rank_path or public_tokenizers.path(RANK_FILE)
    if rank_path not in ENCODINGS:
        with open(rank_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        ENCODINGS[rank_path] = Encoding(
            rank_path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return ENCODINGS[rank_path]


def safe_pieces(text: str, size: int = LONG_TEXT, space: int = LONG_SPACE) -> Iterator[tuple[str, bool]]:
    """``(piece, is_one_match)``: pieces of a long text whose ids, joined, are those of the text.

    No match of the pattern has white space after a character that is none, and none looks back; so a cut before
    white space that follows other text is safe. Of a long run of white space all but the last character are one match, or all if the
    text ends there; these matches are cut out, since the pattern engine recurses over them.
    """
    import regex

    run = regex.compile(r"\s{%d,}" % space)
    boundary = regex.compile(r"(?<=\S)\s")

    def cut(start: int, end: int) -> Iterator[tuple[str, bool]]:
        while end - start > size:
            found = boundary.search(text, start + size, end)
            if not found:
                break
            yield text[start : found.start()], False
            start = found.start()
        if start < end:
            yield text[start:end], False

    start = 0
    for found in run.finditer(text):
        yield from cut(start, found.start())
        end = found.end() if found.end() == len(text) else found.end() - 1
        yield text[found.start() : end], True
        start = end
    yield from cut(start, len(text))


def encode_text(enc, text: str) -> list[int]:
    """Ids of a text, ordinary text only: strings of special tokens are text like any other."""
    if len(text) <= LONG_TEXT:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece, one_match in safe_pieces(text):
        ids += enc._encode_single_piece(piece) if one_match else enc.encode_ordinary(piece)
    return ids


def _task(functions: list, schema: pa.Schema, rank_path: str | None):
    """A ``mapInArrow`` function that keeps the first column and makes the others one from the other, in pieces of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        enc = encoding(rank_path)
        for batch in batches:
            for part in pieces(pc.binary_length(batch.column(1)).to_pylist()):
                given = batch.slice(part.start, part.stop - part.start)
                columns = [given.column(0), given.column(1)]
                for function in functions:
                    columns.append(pa.array([function(enc, value.as_py()) for value in columns[-1]], pa.binary()))
                yield pa.RecordBatch.from_arrays([columns[0], *columns[2:]], schema=schema)

    return run


def _encode_bytes(enc, data: bytes) -> bytes:
    import numpy as np

    return np.asarray(encode_text(enc, data.decode("utf-8", "replace")), "<u4").tobytes()


def _decode_ids(enc, packed: bytes) -> bytes:
    import numpy as np

    return enc.decode_bytes(np.frombuffer(packed, "<u4").tolist())


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_path: str | None = None) -> DataFrame:
    """``(id, ids)`` per row: the token ids as packed little-endian unsigned 32-bit integers, as training files hold them.

    Each match of the pattern is encoded by itself, without special tokens. NULL and empty texts have no ids; bytes that are not
    UTF-8 are read as the replacement character. Texts of any length are encoded whole. Rows are independent: no shuffle.
    ``rank_path`` names another rank file, present on every worker.
    """
    return _map(df, id_col, text_col, {"ids": _encode_bytes}, rank_path)


def decode(df: DataFrame, id_col: str = "id", ids_col: str = "ids", rank_path: str | None = None) -> DataFrame:
    """``(id, decoded)`` per row: the raw bytes of packed ids. NULL ids give no bytes; an id outside the rank file is an error."""
    return _map(df, id_col, ids_col, {"decoded": _decode_ids}, rank_path)


def encode_and_decode(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_path: str | None = None
) -> DataFrame:
    """``(id, ids, decoded)``: :func:`encode`, and :func:`decode` of its ids, by one Python worker per task."""
    return _map(df, id_col, text_col, {"ids": _encode_bytes, "decoded": _decode_ids}, rank_path)


def _map(df: DataFrame, id_col: str, value_col: str, functions: dict, rank_path: str | None) -> DataFrame:
    rows = inputs(df, id=id_col, value=value_col).select("id", as_bytes(F.col("value")).alias("value"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = ", ".join([f"id {kind}", *(f"{name} binary" for name in functions)])
    task = _task(list(functions.values()), to_arrow_schema(StructType.fromDDL(schema)), rank_path)
    return small_batches(rows).mapInArrow(task, schema)
