"""Small helpers that several operators share."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashelf.session import cut, ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word: a maximal run of code points other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: The most bytes of a side that is broadcast; a larger side is joined by shuffle.
BROADCAST_BYTES = 16 * 1024 * 1024


#: Rows of a batch that goes to Python, so that two tasks of whole texts stay small beside an executor's heap.
BATCH_ROWS = 500
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Set the session's rows per Arrow batch to ``BATCH_ROWS`` unless the session has a value of its own.

    Called by every operator that runs Python; it also ships the package to the workers.
    """
    ship(spark)
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_ROWS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lowered(text: Column) -> Column:
    """``text`` with A-Z lower-cased and every other code point as it is."""
    return F.translate(text, UPPER, UPPER.lower())


def bound_to(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often it occurs in there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column) -> Column:
    """For each of an array's whole numbers the sum of those before it.

    Sums grow within parts of about the square root of the array's length, so long arrays cost little more than short ones.
    """

    def scan(part: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("found"))
        return F.aggregate(part, start, lambda s, x: F.struct(
            (s["at"] + x).alias("at"), F.concat(s["found"], F.array(s["at"])).alias("found")))["found"]

    def parted(numbers: Column) -> Column:
        step = F.greatest(F.ceil(F.sqrt(F.size(numbers))).cast("int"), F.lit(1))
        last = F.greatest(F.ceil(F.size(numbers) / step).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(numbers, i * step + 1, step))

    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    shifted = lambda parts: F.flatten(F.transform(
        F.arrays_zip(parts.alias("part"), scan(F.transform(parts, total)).alias("before")),
        lambda p: F.transform(scan(p["part"]), lambda x: x + p["before"])))
    return bound_to(values.cast("array<long>"), lambda numbers: bound_to(parted(numbers), shifted))


def fitted(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` written as a table and its bytes counted: broadcast up to ``limit``, joined as Spark likes beyond."""
    written = cut(df)
    size = written.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(written) if size <= limit else written


def byte_signs() -> dict[str, int]:
    """The byte that each sign of a byte-level vocabulary stands for: printable ones themselves, others in order from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def column_at(batch: pa.RecordBatch, path: str) -> pa.Array:
    """A column of the batch, or a field of a struct column that is never null."""
    first, *rest = path.split(".")
    return reduce(lambda found, name: found.field(name), rest, batch.column(first))


_kept: dict[str, Callable[[], None]] = {}


def claim(name: str, forget: Callable[[], None] | None = None) -> None:
    """What a Python process keeps between tasks is operator ``name``'s from now on; what others kept is let go."""
    for other in [n for n in _kept if n != name]:
        _kept.pop(other)()
        pa.default_memory_pool().release_unused()
        # What the C library holds back of freed memory would count beside the next operator's.
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
    if forget is not None:
        _kept[name] = forget
