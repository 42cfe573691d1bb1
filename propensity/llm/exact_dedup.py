"""Exact duplicates by progressive refinement: length, then hash of the beginning, then hash of the whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensity.llm.common import inputs, settle, stage, text_hash, without_rows


def exact_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = 256,
    length_classes: int = 1 << 20,
    prefix_buckets: int = 1 << 20,
    digest_all: bool = False,
) -> DataFrame:
    """Groups of equal texts; of each group the row with the largest id stays.

    Returns one row per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` (lowercase hex).
    Built from DataFrame functions only.

    Three passes narrow the rows down. Lengths that occur once settle their rows; of the others, those with a
    beginning of their own are settled; the whole text is hashed only for what is left. What one pass tells the
    next is broadcast, and has a proven bound: at most ``length_classes`` + 1 lengths (longer texts share a class) and
    ``prefix_buckets`` buckets of (length, prefix hash). Sharing a class or bucket only means that a text
    is hashed which need not have been. Texts are never shuffled, only ids and digests. Counts are combined before
    the shuffle, and the table of groups is staged, so that the join with it can split the rows of a large group.

    NULL text counts as empty. A NULL id stays only in a group without any other id. Rows that repeat id and
    text are members of their group, and stay or go together. Where the digest was not needed ``text_sha256``
    is NULL, unless ``digest_all`` asks for all. An empty table gives an empty result.
    """
    options = (id_col, text_col, prefix_chars, length_classes, prefix_buckets, digest_all)
    return settle(df.sparkSession, "exact-duplicates", lambda: _grouped(df, *options)).drop("text_hash")


def _grouped(
    df: DataFrame,
    id_col: str,
    text_col: str,
    prefix_chars: int = 256,
    length_classes: int = 1 << 20,
    prefix_buckets: int = 1 << 20,
    digest_all: bool = False,
) -> DataFrame:
    rows = inputs(df, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("length", F.octet_length("text"))
    rows = rows.withColumn("length_class", F.least("length", F.lit(length_classes)))
    counted = F.count(F.lit(1)).alias("n")

    shared_lengths = rows.groupBy("length_class").agg(counted).filter("n > 1").select("length_class")
    shared_lengths = F.broadcast(stage(shared_lengths, "dedup-lengths").coalesce(1))

    def bucket():
        return F.pmod(F.xxhash64("length", "prefix"), F.lit(prefix_buckets)).cast("int").alias("bucket")

    prefixed = rows.withColumn("prefix", F.xxhash64(F.substring("text", 1, prefix_chars)))
    shared_prefixes = (
        prefixed.join(shared_lengths, "length_class", "left_semi")
        .groupBy("length", "prefix")
        .agg(counted)
        .filter("n > 1")
        .select(bucket())
        .distinct()
    )
    shared_prefixes = stage(shared_prefixes, "dedup-prefixes").coalesce(1).withColumn("open", F.lit(True))

    flagged = prefixed.withColumn("bucket", bucket()).join(F.broadcast(shared_prefixes), "bucket", "left")
    is_open = F.coalesce("open", F.lit(False))
    hashed = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    thin = stage(
        flagged.select(
            "doc_id",
            F.when(is_open, text_hash(F.col("text"))).alias("text_hash"),  # settled rows equal no other
            is_open.alias("open"),
            (hashed if digest_all else F.when(is_open, hashed)).alias("digest"),
        ),
        "dedup-digests",
    )

    open_rows = thin.filter("open")
    groups = open_rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), counted).filter("n > 1")
    groups = stage(groups, "dedup-groups")
    in_group = F.col("n").isNotNull()
    found = open_rows.join(groups, "digest", "left").select(
        "doc_id",
        F.when(in_group, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("bigint")).alias("group_size"),
        "digest",
        "text_hash",
    )
    alone = thin.filter("not open").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "digest", "text_hash"
    )
    return found.unionByName(alone).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "text_hash",
    )


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group of :func:`exact_duplicates`; all columns stay.

    Of rows that repeat id and text one stays, also where the id is NULL; otherwise rows with a NULL id stay. NULL and empty texts are one
    group, long texts count whole, an empty table stays empty. Only texts that two passes could not settle are hashed.
    """
    groups = settle(df.sparkSession, "exact-duplicates", lambda: _grouped(df, id_col, text_col))
    listed = groups.filter("text_hash is not null").select(
        F.col("doc_id").alias("id"), "text_hash", (F.col("kept") | F.col("doc_id").isNull()).alias("kept")
    )
    return without_rows(df, id_col, text_col, listed, "dedup-gone")
