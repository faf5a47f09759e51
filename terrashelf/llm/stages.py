"""The stages of the corpus pipeline: each takes documents and returns what is kept of them.

All but the last return the columns of the table they were given, with the values they were given: a row travels as one
column, so no name of a stage's own meets one of the table's. Only the decontamination stage changes a value, the text it
cuts a benchmark passage from. Rows are told apart by their place in the files they are read from, so repeated and missing
identifiers need no care of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashelf.llm import decontaminate, mixing, quality, records, simhash
from terrashelf.llm.common import fitted, table
from terrashelf.session import cut

LEAST_SCORE = 0.5
#: Shingle length of the near-duplicate stage: the SimHash operator's, as are its ``MAX_BITS`` differing bits.
STAGE_SHINGLE = simhash.SHINGLE
#: A document goes when it holds a match of so many words with the benchmark, or when windows cover more than this share.
STAGE_LENGTH, STAGE_COVERAGE = 13, 0.5


def _packed(docs: DataFrame, *more) -> DataFrame:
    """Each row as one column ``_row``."""
    return docs.select(F.struct("*").alias("_row"), *more)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at least one half."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    found = quality.scored(_packed(docs), model, ["_row"], "_row.text")
    return found.where(F.col("_score") >= LEAST_SCORE).select("_row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that SimHash connects the row with the smallest identifier, then the first in the files."""
    placed = _packed(docs, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    names = ["_id", "_file", "_at"]
    prints = simhash.fingerprints(placed.withColumn("_id", F.col("_row.doc_id")), "_row.text", STAGE_SHINGLE, names)
    found = cut(simhash.grouped(prints))
    order = F.struct(F.col("_id").isNull(), *names)
    first = cut(found.groupBy("root").agg(F.min(order).alias("first")))
    dropped = found.join(first, "root").where(order != F.col("first")).select("_file", "_at")
    return placed.join(fitted(dropped), ["_file", "_at"], "left_anti").select("_row.*")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: those with a long one go, shorter ones are cut out of the text."""
    return decontaminate.decontaminate(
        docs, table(spark, sf_dir, "benchmark"), max_coverage=STAGE_COVERAGE, max_length=STAGE_LENGTH)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; a part of a copy counts as one from one half on."""
    sized = _packed(docs, "doc_id", "source", mixing.word_count(F.col("text")).alias("_size"))
    narrow = cut(sized.select("doc_id", "source", "_size"))
    plan = mixing.plan_mix(narrow, "source", "doc_id", "_size")
    mixed = mixing.apply_mix(sized, plan, "source", "doc_id", "_size")
    copies = F.when(F.col("_size") > 0, F.round(F.col("taken") / F.col("_size"))).otherwise(1).cast("int")
    return mixed.select("_row", F.explode(F.array_repeat(F.lit(0), copies))).select("_row.*")


def records_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token records, read back."""
    return records.written(docs)
