"""Files read in parallel block by block where a record may begin in one block and end in another.

Spark cuts large files into blocks and reads each as lines that end in a sign of the caller's choice. What a block means
depends on what came before it (whether a quote is open, how deep the brackets are), so reading takes two passes: the
first gives for every block what it does to such a state, which is added up over the blocks of a file; the second cuts
each block, from its own state on, into fragments. A fragment that goes on in the next block is joined with what follows;
all others never leave their task.

Files without any text give no rows. A compressed file is one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrashelf.session import BROADCAST_BYTES, cut, hinted, ship

BLOCK = ["file", "block"]
#: Bytes of a block that are looked at together.
SPAN = 1 << 20


def lines(spark: SparkSession, paths: str | list[str], sep: str) -> DataFrame:
    """file, block (its first byte), line (rising within a block), size (of the file) and text, without the ``sep`` after it."""
    ship(spark)
    return spark.read.option("lineSep", sep).text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), F.col("_metadata.file_size").alias("size"),
        F.col("value").cast("binary").alias("text"),
    )


def _runs(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple[tuple, slice]]:
    """The runs of rows with equal ``columns``, whose values are read once for each: a batch mostly lies in one block."""
    n, starts = batch.num_rows, {0}
    for values in (batch.column(c) for c in columns):
        starts.update((np.flatnonzero(pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist())
    bounds = [*sorted(starts), n]
    for start, end in zip(bounds, bounds[1:]):
        if end > start:
            yield tuple(batch.column(c)[start].as_py() for c in columns), slice(start, end)


def spans(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[tuple, list[bytes] | None]]:
    """The lines of each block, about ``SPAN`` bytes at a time, with the values of ``columns``; None after a block's last."""
    now, held, size = None, [], 0
    for batch in batches:
        texts = batch.column("text").to_numpy(zero_copy_only=False).tolist()
        for name, run in _runs(batch, columns):
            if name != now and now is not None:
                yield now, held
                yield now, None
                held, size = [], 0
            now = name
            for text in texts[run]:
                if size >= SPAN:
                    yield now, held
                    held, size = [], 0
                held.append(text)
                size += len(text)
    if now is not None:
        yield now, held
        yield now, None


def _earlier(rows: int = -1):
    return Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, rows)


def before(value: Column) -> Column:
    """The sum of ``value`` over the blocks of a file before the row's own; ``value`` is one number a block."""
    return F.coalesce(F.sum(value).over(_earlier()), F.lit(0))


def last_before(value: Column) -> Column:
    """The last ``value`` that is not null of the blocks of a file before the row's own."""
    return F.last(value, ignorenulls=True).over(_earlier())


def is_last() -> Column:
    """Whether the row is the file's last block."""
    return F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull()


def with_state(read: DataFrame, states: DataFrame) -> DataFrame:
    """``read`` with the columns of ``states(file, block, ...)``, each block's lines in order and in one task."""
    size = states.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return read.join(F.broadcast(states), BLOCK)
    return read.join(states, BLOCK).repartition(*BLOCK).sortWithinPartitions(*BLOCK, "line")


def whole(fragments: DataFrame) -> DataFrame:
    """``fragments(file, block, seq, begins, ends, text, of_seq, ...)`` with those that belong together joined.

    ``seq`` counts what begins in a block from 1, so 0 goes on from the block before; ``place`` counts within the file from 1.
    ``of_seq`` names an earlier fragment by its ``seq`` in the same block, null for the last so named before; it becomes ``of``, a place.
    Of further columns the last that is not null counts, or the first for names that start with ``first_``.
    """
    written = cut(fragments)
    counts = written.groupBy(*BLOCK).agg(F.max("seq").alias("n"), F.max("of_seq").alias("o"))
    offsets = counts.withColumn("_offset", before(F.col("n")))
    offsets = offsets.select(*BLOCK, "_offset", last_before(F.col("_offset") + F.col("o")).alias("_of"))
    placed = written.join(hinted(cut(offsets)), BLOCK).withColumn("place", F.col("_offset") + F.col("seq"))
    placed = placed.withColumn("first_of", F.coalesce(F.col("_offset") + F.col("of_seq"), F.col("_of")))
    more = [c for c in placed.columns if c not in (*BLOCK, *offsets.columns, "seq", "begins", "ends", "text", "of_seq", "place")]
    alone = placed.where("begins AND ends").select("file", "place", "text", *more)
    parts = placed.where("NOT (begins AND ends)").groupBy("file", "place").agg(
        F.sort_array(F.collect_list(F.struct("block", "text", *more))).alias("parts"))
    value = lambda c: F.element_at(F.filter(F.col(f"parts.{c}"), lambda x: x.isNotNull()), 1 if c.startswith("first_") else -1)
    joined = parts.select(
        "file", "place", F.array_join(F.col("parts.text"), "").alias("text"),
        *[F.when(F.exists(F.col(f"parts.{c}"), lambda x: x.isNotNull()), value(c)).alias(c) for c in more])
    every = alone.unionByName(joined)
    return every.select("file", "place", "text", *[F.col(c).alias(c.removeprefix("first_")) for c in more])
