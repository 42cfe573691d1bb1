from pathlib import Path
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from propensity.llm.common import TEXT_SETTINGS, inputs, key_remainder, pieces, row_share, settle, small_batches, stage
from propensity.session import shared_folder


def test_inputs_are_picked_by_place(spark):
    df = spark.range(1).selectExpr("1 as `a.b`", "2 as text", "3 as TEXT2", "4 as `_0`").toDF("a.b", "text", "Text2", "text")
    assert inputs(df, x="text", y="TEXT2", z="a.b").first() == (2, 3, 1)
    with pytest.raises(ValueError):
        inputs(df, x="missing")


def test_pieces_cover_all_rows_within_the_limit():
    sizes = [5, 1, 9, 30, 0, 2, 2, 8]
    found = list(pieces(sizes, 10))
    assert [i for part in found for i in range(part.start, part.stop)] == list(range(8))
    assert all(sum(sizes[part]) <= 10 or part.stop - part.start == 1 for part in found)
    assert not list(pieces([]))


def test_settled_tables_leave_nothing_else(spark):
    def files():
        return {p.name for p in Path(shared_folder(spark).removeprefix("file:")).iterdir()}

    before = files()
    settled = settle(spark, "kept", lambda: stage(spark.range(5), "inner").filter("id > 1"))
    assert settled.count() == 3
    assert {name.rsplit("-", 1)[0] for name in files() - before} == {"kept"}


def test_keys_and_shares(spark):
    df = spark.createDataFrame([(i,) for i in [*range(2000), None]], "k bigint")
    found = df.select("k", key_remainder(F.col("k"), 5).alias("r"), row_share(F.col("k"), 0.25, "s").alias("s")).collect()
    assert all(r.r == crc32(("" if r.k is None else str(r.k)).encode()) % 5 for r in found)
    assert 400 < sum(bool(r.s) for r in found) < 600
    assert df.filter(row_share(F.col("k"), 1.0, "s")).count() == 2001


def test_batch_settings(spark):
    small_batches(spark.range(1))
    assert {name: spark.conf.get(name) for name in TEXT_SETTINGS} == TEXT_SETTINGS
