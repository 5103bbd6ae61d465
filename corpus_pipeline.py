"""The corpus pipeline: quality rules, near-duplicate removal, secret redaction, mixing, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cashweave.llm import stages
from cashweave.session import remove, scratch, scratch_path

STAGES = [
    ("quality_rules", stages.quality_rules),
    ("simhash_dedup", stages.simhash_dedup),
    ("secret_scan", stages.secret_scan),
    ("source_mix", stages.source_mix),
    ("bpe_codec", stages.bpe_codec),
]

# The secret scan's trained models and the byte-pair encoding have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again. What a stage writes on its way
    is removed when it is done, and its rows when the next stage is; those of the last remain for the caller."""
    docs, former = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if former is not None:
            remove(spark, former)
        docs, former = spark.read.parquet(path), path
    return docs
