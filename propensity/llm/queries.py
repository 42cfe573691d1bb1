"""The operators as named queries over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propensity.llm.bpe import encode_and_decode
from propensity.llm.centroids import cluster_vectors
from propensity.llm.common import key_remainder, read_table
from propensity.llm.embedding_dedup import near_duplicate_vectors
from propensity.llm.exact_dedup import exact_duplicates
from propensity.llm.langid import fit_profiles, identify_languages
from propensity.llm.lexical_search import search
from propensity.llm.mixing import mix_sources
from propensity.llm.near_dedup import near_duplicates
from propensity.llm.pii import KINDS, find_personal_data, train_field
from propensity.llm.sharding import assign_shards
from propensity.llm.token_files import token_file_round_trip
from propensity.llm.toxicity import fit_toxicity, score_toxicity
from propensity.llm.warc import archive_round_trip


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    held_out = key_remainder(F.col("doc_id"), 3) == 1
    profiles = fit_profiles(documents.filter(~held_out))
    found = identify_languages(documents, profiles)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    both = encode_and_decode(read_table(spark, folder, "documents"))
    return both.select(
        F.col("id").alias("doc_id"),
        F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(read_table(spark, folder, "documents")).drop("source")


def op4_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    found = find_personal_data(documents, train_field(documents))
    base = F.filter("spans", lambda span: span["base"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind):
        return F.size(F.filter(base, lambda span: span["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(counted, KINDS),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op5_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read_table(spark, folder, "documents"), shingle_words=3, percent=85)


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    held_out = key_remainder(F.col("doc_id"), 5) == 0
    model = fit_toxicity(documents, read_table(spark, folder, "labels").filter(~held_out))
    scored = score_toxicity(documents, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(read_table(spark, folder, "documents"), digest_all=True)


def op8_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_vectors(read_table(spark, folder, "embeddings"))


def op9_hash_tree_shards(spark: SparkSession, folder: str) -> DataFrame:
    return assign_shards(read_table(spark, folder, "documents"))


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    records = archive_round_trip(read_table(spark, folder, "pages"), with_payload=False)
    return records.select(
        F.col("record_id").cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


def op11_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return cluster_vectors(read_table(spark, folder, "embeddings")).assigned


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return search(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


def op13_token_files(spark: SparkSession, folder: str) -> DataFrame:
    documents = token_file_round_trip(read_table(spark, folder, "documents"))
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


LLM_QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_mix_sources": op3_mix_sources,
    "op4_personal_data": op4_personal_data,
    "op5_near_dedup": op5_near_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_hash_tree_shards": op9_hash_tree_shards,
    "op10_warc": op10_warc,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_lexical_search": op12_lexical_search,
    "op13_token_files": op13_token_files,
}
