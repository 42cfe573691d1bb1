"""Helpers that the training-data operators share: picking input columns, staged tables, bounded samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from propensity.session import remove_path, scratch, scratch_path

#: settings for tables of texts: bytes in a batch for Python workers, rows in a batch of the parquet reader
TEXT_SETTINGS = {
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}

# ASCII white space, as the word rule of all operators has it.
WORD = r"[^\x20\x09-\x0D]+"


def position(df: DataFrame, name: str) -> int:
    """Place of a column: the first of exactly that name, else the only one that differs in case."""
    if name in df.columns:
        return df.columns.index(name)
    alike = [i for i, column in enumerate(df.columns) if column.lower() == name.lower()]
    if len(alike) != 1:
        raise ValueError(f"no column {name!r} among {df.columns}")
    return alike[0]


def inputs(df: DataFrame, **wanted: str) -> DataFrame:
    """The wanted columns under new names (``new=old``), picked by place.

    Other columns are pruned, whatever their names; so they may repeat or clash with names used inside an operator.
    """
    placed = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return placed.select(*(F.col(f"_{position(df, old)}").alias(new) for new, old in wanted.items()))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and scan it.

    That cuts the lineage in a way that outlives executors, fixes whatever depended on the layout, and gives the
    optimizer the true size, so that it broadcasts only what is small.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``build``, staged; the tables that were staged on the way are removed."""
    path = scratch_path(spark, name)
    with scratch(spark):
        df = build()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(staged: DataFrame) -> None:
    """Remove the files of a staged table that no later step reads."""
    for folder in {path.rsplit("/", 1)[0] for path in staged.inputFiles()}:
        remove_path(staged.sparkSession, folder)


def row_share(key: Column, share: float, seed: str) -> Column:
    """True for about ``share`` of the keys, always the same ones."""
    steps = 1 << 30
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(steps)) < F.lit(int(round(share * steps)))


def key_remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key's text modulo ``divisor``; NULL counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(divisor))


def as_bytes(column: Column) -> Column:
    """UTF-8 bytes of a text, NULL as none: what the Python operators read, so that ill-formed text cannot break them."""
    return F.coalesce(column.cast("binary"), F.lit("").cast("binary"))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, for a Python operator: batches of texts are small, on the way to Python workers as in the reader.

    Batch sizes are settings of the session, read when a job is planned, so they are set there; those that were given to the
    session's context stay. By Spark's defaults a task would hold several copies of 64 MB, and 4096 texts at a time, however long.
    """
    spark = df.sparkSession
    given = spark.sparkContext.getConf()
    for name, value in TEXT_SETTINGS.items():
        if not given.contains(name):
            spark.conf.set(name, value)
    return df


def pieces(sizes: list[int], limit: int = 4 << 20) -> Iterator[slice]:
    """Slices of rows whose ``sizes`` add up to ``limit`` at most, unless one row alone is larger."""
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if start < len(sizes):
        yield slice(start, len(sizes))


def placed(df: DataFrame) -> DataFrame:
    """``df`` with columns named by their place, so that names that clash do no harm; ``toDF(*df.columns)`` takes it back."""
    return df.toDF(*(f"_c{i}" for i in range(len(df.columns))))


def text_hash(column: Column) -> Column:
    """Tells the rows apart that repeat an id."""
    return F.xxhash64(as_bytes(column))


def with_class_keys(classes: DataFrame, key: str) -> DataFrame:
    """``classes`` with ``rep``: a 64-bit hash of ``key`` that no other class has. An id cannot name a class, since rows may repeat ids.

    ``classes`` is a staged table with one row per ``key``. Should two keys share a hash (2^32 classes: in 2 of 5 cases), another seed is taken.
    """
    for seed in range(100):
        keyed = classes.withColumn("rep", F.xxhash64(F.lit(seed), key))
        if keyed.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            return keyed
    raise ValueError(f"no 64-bit hash tells the values of {key!r} apart")


def component_ids(classes: DataFrame, components: DataFrame, id_col: str, name: str) -> DataFrame:
    """``(rep, component_id)`` of the classes in ``components``: the smallest id of a component's classes.

    The smallest ids are staged, so that the join with them can split a component with very many classes.
    """
    placed = components.join(classes.select("rep", id_col), components["node"] == F.col("rep"))
    lowest = stage(placed.groupBy("component").agg(F.min(id_col).alias("component_id")), name)
    return components.join(lowest, "component").select(F.col("node").alias("rep"), "component_id")


def without_rows(df: DataFrame, id_col: str, text_col: str, listed: DataFrame, name: str) -> DataFrame:
    """``df`` without what ``listed`` drops: rows ``(id, text_hash, kept)``, one for each row of ``df`` that may go or is repeated.

    A row goes if its id and text hash are listed as not kept; of kept rows that repeat both, NULL ids included, any one stays. All columns
    stay. Only pairs that matter are staged: where they are few they are broadcast, and rows stay where they are. Repeated rows, and no others, are
    gathered to drop all but one of each; every task first does so with its own.
    """
    marks = listed.groupBy("id", "text_hash").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    marks = stage(marks.filter("not kept or n > 1").select("id", "text_hash", "kept"), name)
    rows = placed(df)
    key, text = (rows[f"_c{position(df, column)}"] for column in (id_col, text_col))
    same = key.eqNullSafe(marks["id"]) & (text_hash(text) == marks["text_hash"])
    others = rows.join(marks, same, "left_anti")
    if not marks.filter("kept").isEmpty():
        repeated = rows.join(marks.filter("kept"), same).dropDuplicates(["id", "text_hash"])
        others = others.union(repeated.select(*rows.columns))
    return others.toDF(*df.columns)
