import random

import pytest

WORDS = "anchor basil cedar delta ember falcon garnet harbor island jasper kernel lantern marble nectar orchid".split()


@pytest.fixture
def words():
    """``words(n, seed)``: a text of ``n`` words, the same for the same seed."""

    def make(count, seed):
        source = random.Random(seed)
        return " ".join(source.choice(WORDS) + str(source.randrange(1000)) for _ in range(count))

    return make


@pytest.fixture
def clashing(spark):
    """``clashing(rows, schema)``: a table with more columns, whose names are those that operators use inside."""

    def make(rows, schema):
        table = spark.createDataFrame(rows, schema)
        for name in ("size", "key", "n", "digest", "open", "rep", "target", "_c0", "id", "shard"):
            if name not in table.columns:
                table = table.selectExpr("*", f"'clash' as `{name}`")
        return table

    return make
