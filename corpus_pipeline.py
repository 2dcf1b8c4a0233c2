"""A training-data pipeline of five stages over ``documents``; each works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelathe.llm import stages

STAGES = [
    ("language_id", stages.language_stage),
    ("near_dedup", stages.near_duplicate_stage),
    ("decontamination", stages.decontamination_stage),
    ("pii", stages.pii_stage),
    ("packing", stages.packing_stage),
]

#: Stages 1, 2, 4 and 5 cannot be written in SQL; tests hold run() against the brute-force forms of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, one plan from the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
