"""The corpus pipeline: documents in, token records out; each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrashelf.llm import stages
from terrashelf.llm.common import table
from terrashelf.session import cut

STAGES = [
    ("quality classifier", stages.quality_stage),
    ("SimHash near-dedup", stages.near_duplicate_stage),
    ("benchmark decontamination", stages.decontamination_stage),
    ("mixing sources to target weights", stages.mixing_stage),
    ("token-ID / binary output", stages.records_stage),
]

#: SQL cannot express the fitted classifier; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
