"""The queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import audit, buckets, codes, decontaminate, embeddings, jaccard, licenses, quality, secrets, sharding, substrings, suffixes, tokens
from quillon.llm.shared import documents_of


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(documents_of(spark, sf_dir)))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents_of(spark, sf_dir))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents_of(spark, sf_dir), n=3, percent=90)


def op3_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return buckets.pack(documents_of(spark, sf_dir))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(documents_of(spark, sf_dir), window=35, keep_text=False).withColumnRenamed("kept", "kept_sha256")


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), least=0.98)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(documents_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents_of(spark, sf_dir), shards=24)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op_scores(documents_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pack(documents_of(spark, sf_dir))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(documents_of(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.deduplicate(documents_of(spark, sf_dir), length=100, keep=False).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "string(kept) kept_sha256")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


QUERIES = {"op1_license_scan": op1_license_scan, "op2_jaccard_join": op2_jaccard_join, "op3_length_buckets": op3_length_buckets, "op4_substring_dedup": op4_substring_dedup, "op5_decontamination": op5_decontamination, "op6_sharding": op6_sharding, "op7_embedding_near_dedup": op7_embedding_near_dedup, "op8_quality": op8_quality, "op9_secret_scan": op9_secret_scan, "op10_packed_tokens": op10_packed_tokens, "op11_filter_audit": op11_filter_audit, "op12_suffix_dedup": op12_suffix_dedup, "op13_vector_codes": op13_vector_codes}
SQL: dict[str, str] = {"op1_license_scan": licenses.sql(), "op2_jaccard_join": jaccard.sql(3, 90), "op4_substring_dedup": substrings.sql(35), "op7_embedding_near_dedup": embeddings.sql(0.98), "op11_filter_audit": audit.sql(), "op12_suffix_dedup": suffixes.sql(), "op13_vector_codes": codes.sql()}
