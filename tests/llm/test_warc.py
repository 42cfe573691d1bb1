import gzip
import io

import pytest

from propensity.llm.warc import (
    MAGIC, archive_round_trip, digest_of, parse_record, read_archives, record_bytes, scan_members, write_archives,
)
from propensity.session import scratch_path

SCHEMA = "page_id bigint, url string, html string"


def rows_of():
    return [
        (1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (5, None, "<p>one</p>"), (3, "http://b\r\nX: y", None), (4, "u", ""),
        (6, "u", "é🎉" * 200_000), (None, "n", "<p>one</p>"), (None, "n", "alone"), (7, "u", "HTTP/1.1 200 OK\r\n\r\nWARC/1.1\r\n\r\n"), (8, "r", "rep"), (8, "r", "rep"),
    ]


def test_round_trip_with_revisits(clashing):
    found = archive_round_trip(clashing(rows_of(), SCHEMA)).collect()
    first = {}
    for page, _, html in rows_of():
        first.setdefault(html or "", []).append(page)
    expected = []
    for page, _, html in rows_of():
        own = min((p for p in first[html or ""] if p is not None), default=None)
        again = own is not None and page != own and len(first[html or ""]) > 1
        data = (html or "").encode()
        expected.append(
            (None if page is None else str(page), "revisit" if again else "response", len(data), digest_of(data),
             str(own) if again else None, None if again else data)
        )
    got = [
        (r.record_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, None if r.payload is None else bytes(r.payload))
        for r in found
    ]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_small_payloads_are_all_responses(spark):
    found = archive_round_trip(spark.createDataFrame(rows_of(), SCHEMA), min_bytes=5).collect()
    kinds = sorted((r.record_id or "", r.record_type) for r in found)
    assert ("3", "response") in kinds and ("4", "response") in kinds and ("2", "revisit") in kinds


@pytest.mark.parametrize("split", [1, 37, 1000, 1 << 20])
def test_splits_of_any_size_give_each_record_once(spark, split):
    table = spark.createDataFrame([(i, "u", f"page {i} " * (i % 40)) for i in range(60)], SCHEMA)
    files = write_archives(table, scratch_path(spark, "warc-test"), file_bytes=1500)
    assert files.count() > 2
    if split == 1:
        files = files.limit(1)
    found = read_archives(spark, files, split_bytes=split).collect()
    assert len(found) == len({r.record_id for r in found}) == files.selectExpr("sum(records) as n").first().n


def member(number, payload=b"x"):
    return gzip.compress(record_bytes(number, None, payload, None))


def test_false_magic_is_passed_over():
    junk = MAGIC + b"junk" + gzip.compress(b"no record") + MAGIC
    data = junk + member(1) + member(2)
    for end in range(1, len(data) + 1):
        found = list(scan_members(io.BytesIO(data), 0, end, len(data)))
        assert len(found) == (len(junk) < end) + (len(junk) + len(member(1)) < end)
    assert parse_record(found[1][1])[0]["warc-record-id"] == "<urn:page:2>"


def test_damage_in_a_record_is_an_error():
    whole = member(1, bytes(range(256)) * 5000)
    with pytest.raises(ValueError, match="no end"):
        list(scan_members(io.BytesIO(whole[:-9]), 0, len(whole) - 9, len(whole) - 9))


def test_archives_are_plain_warc(spark):
    table = spark.createDataFrame([(1, "http://a/", "<p>é</p>")], SCHEMA)
    path = write_archives(table, scratch_path(spark, "warc-test")).first().path.removeprefix("file:")
    with gzip.open(path) as lines:
        fields, block = parse_record(lines.read())
    assert fields["warc-type"] == "response" and fields["warc-target-uri"] == "http://a/" and block.endswith("<p>é</p>".encode())


def test_empty_table(spark):
    assert archive_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0
