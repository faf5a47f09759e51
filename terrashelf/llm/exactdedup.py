"""Exact duplicates by sorting content.

Normalised texts are dealt to range partitions by sampled splitters and sorted there (Spark's external sort), so that
equal texts stand next to each other; each row is compared with its neighbour in full. The sort key is the leading
bytes of the text, the digest of the whole text, the text and the identifier. Splitters are taken over the key without
the text, so each is short however long the texts are, and the identifier in them lets a group of copies of any size
spread over many partitions. A run of equal texts that touches the edge of a partition may go on in the next one: such
runs, two a partition, are joined by comparing their texts in full.

Cases: a null text counts as empty. Empty texts are one group. Of rows with the same text and identifier exactly one is
kept, null identifiers come last. Further columns are not carried. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashelf.llm.common import UPPER, lowered, small_batches, table
from terrashelf.session import cut

#: Leading bytes of a text in the sort key; equal ones are told apart by the rest of the key.
LEAD = 16
_RUNS = "id long, sha string, part int, run long, first boolean, edge string, text string"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (id, sha, norm) to rows that carry the number of their run within the partition.

    ``first`` marks the first row of a run. The runs at both ends of the partition give their text on one row, marked
    ``first`` with edge ``head`` or ``last`` with edge ``tail`` (a row of its own without identifier).
    """
    part = TaskContext.get().partitionId()
    run, before = -1, None
    last = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        norm = batch.column("norm")
        same = np.zeros(n, dtype=bool)
        if n > 1:
            same[1:] = pc.equal(norm.slice(1), norm.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        same[0] = before is not None and norm[0].equals(before)
        runs = run + np.cumsum(~same)
        head = (run == -1) & (np.arange(n) == 0)
        yield _batch(
            batch.column("id"), batch.column("sha"), part, runs, ~same,
            pa.array(["head" if h else None for h in head], pa.string()),
            pa.array([norm[0].as_py() if h else None for h in head], pa.string()),
        )
        run, before = int(runs[-1]), norm[n - 1]
        last = batch.column("sha").slice(n - 1, 1)
    if before is not None:
        one = np.array([run])
        text = pa.array([before.as_py()], pa.string())
        yield _batch(pa.array([None], pa.int64()), last, part, one, np.array([False]), pa.array(["tail"]), text)


def _batch(ids, sha, part, runs, first, edge, text):
    parts = pa.array(np.full(len(runs), part, dtype=np.int32))
    columns = [ids, sha, parts, pa.array(runs.astype(np.int64)), pa.array(first), edge, text]
    return pa.RecordBatch.from_arrays(columns, names=["id", "sha", "part", "run", "first", "edge", "text"])


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "max") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256 of the normalised text.

    ``keep`` names the identifier that stays, ``max`` or ``min``.
    """
    small_batches(docs.sparkSession)
    order = (lambda c: F.desc_nulls_last(c)) if keep == "max" else (lambda c: F.asc_nulls_last(c))
    best = F.max if keep == "max" else F.min
    norm = lowered(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), norm.alias("norm")).select(
        "id", "norm", F.sha2("norm", 256).alias("sha")
    )
    lead = F.substring(F.encode("norm", "UTF-8"), 1, LEAD)
    placed = rows.withColumn("lead", lead).repartitionByRange(F.col("lead"), F.col("sha"), order("id"))
    sorted_rows = placed.sortWithinPartitions("lead", "sha", "norm", order("id")).select("id", "sha", "norm")
    found = cut(sorted_rows.mapInArrow(_compare, _RUNS))

    rows = found.where(~F.col("edge").eqNullSafe("tail"))
    runs = rows.groupBy("part", "run").agg(F.count("*").alias("n"), best("id").alias("best"))
    edges = found.where(F.col("edge").isNotNull()).groupBy("part", "run").agg(
        F.first("sha").alias("sha"), F.first("text").alias("text")
    )
    across = (
        edges.join(runs, ["part", "run"]).groupBy("sha", "text")
        .agg(F.collect_list(F.struct("part", "run")).alias("spread"), F.sum("n").alias("n"), best("best").alias("best"))
        .select(F.explode("spread").alias("r"), "n", "best", F.array_min("spread").alias("top"))
        .select("r.part", "r.run", F.col("n").alias("all_n"), F.col("best").alias("all_best"),
                (F.col("r") == F.col("top")).alias("top"))
    )
    whole = runs.join(across, ["part", "run"], "left").select(
        "part", "run", F.coalesce("all_n", "n").alias("group_size"), F.coalesce("all_best", "best").alias("keep_id"),
        F.coalesce("top", F.lit(True)).alias("top"),
    )
    return rows.join(whole, ["part", "run"]).select(
        "id", "keep_id", "group_size", (F.col("first") & F.col("top")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_groups(docs).withColumnRenamed("id", "doc_id")


SQL = f"""
WITH norm AS (
    SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') AS t FROM documents),
keyed AS (SELECT doc_id, sha256(t) AS text_sha256 FROM norm)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM keyed"""

QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLE = {"op2_exact_dedup": SQL}
