"""Time-grid counts over a stream, in append mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashelf.functions.timegrid import nearest_slot


def slot_stream(events: DataFrame, ts: str, minutes: int, keys: list[str], delay: str) -> DataFrame:
    """Events per nearest grid point, emitted once the watermark has passed its window; see ``open_slots`` for the rest.

    ``minutes`` divides 60. Each event is moved to its grid point first and that column serves as the
    event time, so half-way times fall as in the batch job. Watermarks need zoned timestamps: run the
    session in UTC, as the catalogue's times have no zone.
    """
    if 60 % minutes:
        raise ValueError("minutes must divide 60")
    moved = events.withColumn("_slot", nearest_slot(F.col(ts), minutes).cast("timestamp"))
    return (
        moved.withWatermark("_slot", delay)
        .groupBy(F.window("_slot", f"{minutes} minutes"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("slot"), *keys, "n")
    )


def open_slots(spark: SparkSession, checkpoint: str, keys: list[str]) -> DataFrame:
    """Slots that a stopped ``slot_stream`` still holds, with the counts so far; read from its checkpoint's state.

    With the emitted ones they are all slots of the input.
    """
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(
        F.col("key.window.start").cast("timestamp_ntz").alias("slot"), *[F.col(f"key.{k}") for k in keys],
        F.col("value.count").alias("n"),
    )
