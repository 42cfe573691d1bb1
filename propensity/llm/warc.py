"""WARC archives: a writer with one gzip member per record, and a reader that splits archives anywhere."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propensity.llm.common import as_bytes, inputs, small_batches, stage
from propensity.session import scratch_path

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 18
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
# Fixed value: the profile that the WARC standard names for such revisits.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = (
    "path string, offset bigint, record_id string, record_type string, url string, "
    "payload_bytes bigint, payload_digest string, refers_to string, payload binary"
)


def with_revisits(df: DataFrame, page_id: str, html: str, url: str | None, min_bytes: int) -> DataFrame:
    """``page_id, url, payload, refers_to``: for repeated payloads of at least ``min_bytes`` the page that has them in full.

    Digests of repeated payloads are staged, so the join with the pages broadcasts them where they are few, and can split
    the pages of one very frequent payload where they are not.
    """
    wanted = {"page_id": page_id, "html": html} | ({"url": url} if url else {})
    pages = inputs(df, **wanted)
    pages = pages.select(
        "page_id", (F.col("url") if url else F.lit(None).cast("string")).alias("url"), as_bytes(F.col("html")).alias("payload")
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    repeated = (
        pages.filter(F.octet_length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id"))
        .filter("n > 1 and first_id is not null")
        .select("digest", "first_id")
    )
    joined = pages.join(stage(repeated, "warc-repeated"), "digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", F.when(again, F.col("first_id")).alias("refers_to"))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC record: a response with the payload, or a revisit that names the page that holds it."""
    revisit = refers_to is not None
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _is_null(value) -> bool:
    return value is None or value != value


def write_archives(
    df: DataFrame,
    folder: str,
    page_id: str = "page_id",
    html: str = "html",
    url: str | None = "url",
    min_bytes: int = 0,
    file_bytes: int = 256 << 20,
) -> DataFrame:
    """Write a record per row below ``folder`` (which all executors share); returns the staged list ``(path, size, records)``.

    Each task writes its own files, one gzip member per record, a new file after ``file_bytes``. An attempt's files have names of
    their own, and only the list that successful attempts return counts; so repeated tasks do no harm.

    NULL html is an empty payload. A NULL page is a response unless an equal payload has an id; rows that repeat
    id and payload are alike. An empty table gives an empty list.
    """
    rows = with_revisits(df, page_id, html, url, min_bytes)
    rows = rows.withColumns({name: F.col(name).cast("string") for name in ("page_id", "refers_to")})

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, size, records, made = None, "", 0, 0, []
        for batch in batches:
            for page, target, payload, refers in zip(batch["page_id"], batch["url"], batch["payload"], batch["refers_to"]):
                if out is None:
                    name, size, records = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                member = _member(
                    record_bytes(*(None if _is_null(x) else x for x in (page, target)), payload, None if _is_null(refers) else refers)
                )
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= file_bytes:
                    out.close()
                    out = None
                    made.append((f"{folder}/{name}", size, records))
        if out is not None:
            out.close()
            made.append((f"{folder}/{name}", size, records))
        if made:
            yield pd.DataFrame(made, columns=["path", "size", "records"])

    return stage(small_batches(rows).mapInPandas(write, "path string, size bigint, records bigint"), "warc-files")


def scan_members(handle, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """``(offset, record)`` of the gzip members that start in ``[start, end)`` and hold a WARC record.

    The range is searched for the gzip magic. A candidate counts if it inflates to something that begins like a WARC record;
    other bytes that look like magic are passed over. After a record the next one is expected right behind it. A record that
    starts inside is read to its end, however far that lies behind the range.
    """
    handle.seek(start)
    data = handle.read(min(end + len(MAGIC) - 1, size) - start)
    place = 0
    while True:
        place = data.find(MAGIC, place)
        if place < 0 or start + place >= end:
            return
        inflate = zlib.decompressobj(31)
        parts, head, feed, outside = [], b"", place, start + len(data)
        valid = None
        try:
            while not inflate.eof:
                if feed < len(data):
                    chunk = data[feed : feed + CHUNK]
                    feed += len(chunk)
                else:
                    handle.seek(outside)
                    chunk = handle.read(CHUNK)
                    outside += len(chunk)
                    if not chunk:
                        break
                part = inflate.decompress(chunk)
                parts.append(part)
                if valid is None:
                    head += part[:8]
                    if len(head) >= 7:
                        valid = head.startswith(b"WARC/1.")
                        if not valid:
                            break
        except zlib.error:
            if valid:
                raise ValueError(f"damaged record at byte {start + place}") from None
            valid = False
        if not valid:
            place += 1
            continue
        if not inflate.eof:
            raise ValueError(f"record at byte {start + place} has no end")
        yield start + place, b"".join(parts)
        used = (feed if feed < len(data) or outside == start + len(data) else outside - start) - len(inflate.unused_data)
        place = used


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of a record."""
    end = record.index(b"\r\n\r\n")
    lines = record[:end].decode("utf-8", "replace").split("\r\n")[1:]
    fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
    length = int(fields.get("content-length", 0))
    block = record[end + 4 : end + 4 + length]
    if len(block) != length:
        raise ValueError("a record is shorter than its Content-Length")
    return fields, block


def _page(field: str | None) -> str | None:
    inside = (field or "").removeprefix("<urn:page:").removesuffix(">")
    return inside or None


def read_archives(
    spark: SparkSession, files: DataFrame, split_bytes: int = 16 << 20, with_payload: bool = True
) -> DataFrame:
    """The records of archives listed as ``(path, size)``, in the columns of ``RECORD_SCHEMA``.

    Every archive is cut into ranges of ``split_bytes``, whatever its records; a task scans ranges and owns the records
    that start inside, so archives of any size are read in parallel, each record once. A response's digest is computed from the
    payload and must equal the one it carries; of a revisit, length and digest are those of the payload it stands for, and the
    payload is NULL. ``with_payload=False`` leaves payloads out of the result.
    """
    splits = files.select(
        "path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(split_bytes).cast("bigint"))).alias("start")
    ).filter("size > 0")
    # one number from the driver: with it a task has few ranges (one, up to 20,000 ranges), however few bytes their rows have
    count = files.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0]
    splits = splits.repartition(int(max(1, min(count or 1, 20_000))))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        names = [part.split()[0] for part in RECORD_SCHEMA.split(", ")]
        for batch in batches:
            for path, size, start in zip(batch["path"], batch["size"], batch["start"]):
                store, inside = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(inside) as handle:
                    for offset, record in scan_members(handle, int(start), int(min(start + split_bytes, size)), int(size)):
                        fields, block = parse_record(record)
                        kind = fields["warc-type"]
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        if payload is not None and digest_of(payload) != digest:
                            raise ValueError(f"{path}: payload at byte {offset} differs from its digest")
                        length = len(payload) if payload is not None else int(fields.get("x-payload-length", 0))
                        rows.append(
                            (path, offset, _page(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), length, digest,
                             _page(fields.get("warc-refers-to")), payload if with_payload else None)
                        )
                        held += length if with_payload else 0
                        if held > 32 << 20 or len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return splits.mapInPandas(read, RECORD_SCHEMA)


def archive_round_trip(df: DataFrame, min_bytes: int = 0, with_payload: bool = True, **columns: str) -> DataFrame:
    """Write ``df`` to archives in the shared folder, and the records read back from there."""
    spark = df.sparkSession
    files = write_archives(df, scratch_path(spark, "warc"), min_bytes=min_bytes, **columns)
    return read_archives(spark, files, with_payload=with_payload)
