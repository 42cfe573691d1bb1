"""Token ids as training files: flat unsigned integers, 64-bit document offsets, memory-mapped when read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from propensity.llm.common import as_bytes, inputs, pieces, small_batches, stage
from propensity.llm.flat_files import FlatFile, FlatWriter
from propensity.session import scratch_path

TOKENIZER_FILE = "word_bpe_49k.json"
END_ID = 2
#: bytes of text that are encoded at a time; words that a task remembers; characters of a word that is not remembered
BATCH_BYTES, CACHED, LONG_WORD = 1 << 22, 1 << 19, 64
#: a word of one id, which no other character gives
MARK = "0"
#: tokens in an entry of the list of files, which is what one reading task takes at a time
CHUNK_TOKENS = 1 << 22

LIST_SCHEMA = (
    "part int, stem string, width int, first_doc bigint, docs bigint, null_docs bigint, first_token bigint, tokens bigint"
)
TOKEN_SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids binary"

_loaded: dict = {}


def tokenizer(path: str | None = None):
    """The tokenizer of a file, loaded once per Python worker; its own threads are off, as tasks share the cores already."""
    import os

    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    path = path or public_tokenizers.path(TOKENIZER_FILE)
    if path not in _loaded:
        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def id_width(path: str | None = None, end_id: int = END_ID) -> int:
    """Bytes of an id in the files: 2 where all ids fit, else 4."""
    return 2 if max(tokenizer(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4


class Encoder:
    """Packed ids of whole texts, without the special tokens that a model adds.

    The tokenizer drops white space, and neither normalization nor lower case looks across a space or a line end. So a text is cut there, and
    each cut is encoded by the library and remembered for the task, up to ``CACHED`` of them: most words come again. New words go to the
    library many at a time with a ``MARK`` between them, whose id parts the result again; those that hold it go by themselves.
    """

    def __init__(self, path: str | None, width: int):
        self.path, self.kind, self.known = path, f"<u{width}", {}
        one, mark, two, joined = (tokenizer(path).encode(t, add_special_tokens=False).ids for t in ("a", MARK, "b", f"a {MARK} b"))
        if joined != one + mark + two or len(mark) != 1:
            raise ValueError("the tokenizer does not drop white space between words, or splits a digit")
        self.mark_id = mark[0]

    def _learn(self, words: list[str]) -> None:
        import numpy as np

        library = tokenizer(self.path)
        apart = [word for word in words if MARK in word]
        for word, found in zip(apart, library.encode_batch_fast(apart, add_special_tokens=False)):
            self.known[word] = np.array(found.ids, self.kind).tobytes()
        rest = [word for word in words if MARK not in word]
        lines = [rest[start : start + 64] for start in range(0, len(rest), 64)]
        for line, found in zip(lines, library.encode_batch_fast([f" {MARK} ".join(line) for line in lines], add_special_tokens=False)):
            ids = np.array(found.ids, self.kind)
            marks = np.flatnonzero(ids == self.mark_id) * ids.itemsize
            packed, starts = ids.tobytes(), [0, *(marks + ids.itemsize).tolist()]
            for word, start, end in zip(line, starts, [*marks.tolist(), len(packed)]):
                self.known[word] = packed[start:end]

    def __call__(self, texts: pa.Array) -> pa.Array:
        """Packed ids of an Arrow array of texts.

        Capitals of ASCII, and whether a comma or full stop that ends a word stands apart, make no difference to the ids; without them more words are the
        same. Texts that might name a special token are left as they are.
        """
        import pyarrow.compute as pc

        if len(self.known) > CACHED:
            self.known = {}
        plain = pc.replace_substring_regex(pc.ascii_lower(texts), r"([0-9a-z])([,.])(\s|$)", r"\1 \2\3")
        alike = pc.if_else(pc.match_substring(texts, "<|"), texts, plain)
        cut = pc.split_pattern(pc.replace_substring(alike, "\n", " "), " ")
        words = cut.flatten().dictionary_encode()
        distinct = words.dictionary.to_pylist()
        missing = [word for word in distinct if word not in self.known]
        self._learn(missing)
        packed = pa.array([self.known[word] for word in distinct], pa.binary()).take(words.indices)
        for word in missing:
            if len(word) > LONG_WORD:
                del self.known[word]
        return pc.binary_join(pa.ListArray.from_arrays(cut.offsets, packed), b"")


def as_texts(column: pa.Array) -> pa.Array:
    """Bytes as text; what is no UTF-8 becomes the replacement character."""
    try:
        return column.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([value.decode("utf-8", "replace") for value in column.to_pylist()], pa.string())


def write_token_files(
    df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID
) -> DataFrame:
    """Encode every whole text, end it with ``end_id``, and write the ids below ``folder`` in ascending order of ``id_col``.

    Rows are range-partitioned by id, sorted, and encoded where they are written, so texts move once and are encoded once. A task
    writes three flat files, little-endian: ``.tok`` has the ids one after the other (unsigned, 2 bytes where the
    vocabulary fits, else 4), ``.off`` a 64-bit offset per document and one more, ``.doc`` the 64-bit document ids. The
    result is the staged list of what was written, in entries of some ``CHUNK_TOKENS`` tokens; files of failed attempts are not in it.

    NULL and empty texts have the end id only; bytes that are no UTF-8 read as the replacement character; strings of special tokens in a
    text are what the library makes of them. NULL ids come first. Rows that repeat an id follow a hash of their text; equal rows are
    interchangeable, and a range may begin among them, so no id is too frequent for a task. An empty table gives an empty list.
    """
    rows = inputs(df, id=id_col, text=text_col).select(F.col("id").cast("bigint"), as_bytes(F.col("text")).alias("text"))
    order = ["id", "text_hash", "row"]
    rows = rows.withColumns({"text_hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    width = id_width(path, end_id)
    list_schema = to_arrow_schema(StructType.fromDDL(LIST_SCHEMA))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc
        from pyspark import TaskContext

        encode, end = Encoder(path, width), np.array([end_id], f"<u{width}").tobytes()
        out, entries, entry, written = None, [], None, [0, 0]
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).to_pylist()
            for part in pieces(sizes, BATCH_BYTES):
                given = batch.slice(part.start, part.stop - part.start)
                encoded = [ids + end for ids in encode(as_texts(given.column(1))).to_pylist()]
                if out is None:
                    out = FlatWriter(folder, "tokens", ("tok", "off", "doc"))
                    out.append("off", np.zeros(1, "<i8"))
                lengths = np.array([len(ids) for ids in encoded], np.int64) // width
                out.append("tok", b"".join(encoded))
                out.append("off", (written[1] + lengths.cumsum()).astype("<i8"))
                out.append("doc", np.array([id or 0 for id in given.column(0).to_pylist()], "<i8"))
                for id, length in zip(given.column(0), lengths.tolist()):
                    if entry is None or entry["tokens"] + length > CHUNK_TOKENS:
                        entry = {"first_doc": written[0], "docs": 0, "null_docs": 0, "first_token": written[1], "tokens": 0}
                        entries.append(entry)
                    entry["docs"] += 1
                    entry["null_docs"] += not id.is_valid
                    entry["tokens"] += length
                    written = [written[0] + 1, written[1] + length]
        if out is not None:
            out.close()
            own = {"part": TaskContext.get().partitionId(), "stem": f"{folder}/{out.stem}", "width": width}
            yield pa.RecordBatch.from_pylist([own | entry for entry in entries], schema=list_schema)

    return stage(small_batches(rows).mapInArrow(write, LIST_SCHEMA), "token-files")


def with_bases(files: DataFrame) -> DataFrame:
    """The list of files with ``base``: tokens before each entry's part. Prefix sums over one row per written partition."""
    parts = files.groupBy("part").agg(F.sum("tokens").alias("in_part"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0).cast("bigint")).alias("base"))
    return files.join(bases, "part")


def read_token_files(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The documents of listed files: ``doc_id``, ``start`` (tokens of all documents before it), ``n_tokens``, and ``ids``
    as packed little-endian unsigned 32-bit integers.

    Each entry of the list is read from memory maps by one task. Offsets within a file count from its own beginning; the base of
    its partition makes them global, so no file had to wait for the ones before it.
    """
    entries = with_bases(files)
    count = files.count()
    entries = entries.repartition(int(max(1, min(count, 20_000))), "part", "first_doc")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for entry in batch.to_pylist():
                maps = {kind: FlatFile(f"{entry['stem']}.{kind}") for kind in ("tok", "off", "doc")}
                first, docs = entry["first_doc"], entry["docs"]
                offsets = maps["off"].array("<i8", first, docs + 1)
                doc_ids = maps["doc"].array("<i8", first, docs)
                lengths = np.diff(offsets)
                for part in pieces((lengths * 4).tolist()):
                    ends = offsets[part.start : part.stop + 1]
                    tokens = maps["tok"].array(f"<u{entry['width']}", int(ends[0]), int(ends[-1] - ends[0])).astype("<u4")
                    ids = [tokens[a:b].tobytes() for a, b in zip(ends[:-1] - ends[0], ends[1:] - ends[0])]
                    missing = np.arange(part.start, part.stop) < entry["null_docs"]
                    columns = [
                        pa.array(doc_ids[part], pa.int64(), mask=missing),
                        pa.array(entry["base"] + ends[:-1], pa.int64()),
                        pa.array(lengths[part], pa.int64()),
                        pa.array(ids, pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids"])
                for one in maps.values():
                    one.close()

    return small_batches(entries).mapInArrow(read, TOKEN_SCHEMA)


def token_file_round_trip(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` to token files in the shared folder, and the documents read back from there."""
    spark = df.sparkSession
    return read_token_files(spark, write_token_files(df, scratch_path(spark, "tokens"), **options))
