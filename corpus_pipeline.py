"""A corpus pipeline: quality classifier, n-gram Jaccard join, benchmark decontamination, secret scans, packing.

Every stage takes rows with any columns beside doc_id and text, whatever their names, and all but the last return the
columns that they got. Null and empty texts, null and repeated doc_ids, repeated rows, very long texts and empty tables
have the results that each stage's docstring states; no stage cuts a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import buckets, decontaminate, jaccard, quality, secrets
from quillon.llm.shared import documents_of, written


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts; null and empty texts are scored like any other, repeated rows all go or stay."""
    return quality.accepted(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of Jaccard similarity 0.8 over five-word shingles form: that of the smallest doc_id, null last. Of repeated rows one stays; other texts without words all stay."""
    return jaccard.one_of_each(docs, n=5, percent=80)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the test set; null and empty texts stay, repeated rows all go or stay, and an empty test set takes nothing."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark and n_chars counted anew; a null text stays null."""
    return secrets.redacted(docs)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """For each document its length bucket, batch and place; null and empty texts have length 0, repeated rows each take a place."""
    return buckets.pack(docs)


STAGES = [("quality", _quality), ("near duplicates", _near_duplicates), ("decontamination", _decontamination), ("secrets", _secrets), ("packing", _packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's result is written and read again for the next."""
    docs = documents_of(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: No SQL: compression, string tiling and dynamic programming have no SQL form. tests/llm holds it against brute force.
ORACLE_SQL = None
