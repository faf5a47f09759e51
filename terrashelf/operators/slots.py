"""Counts on a time grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrashelf.functions.timegrid import nearest_slot, nearest_slot_text


def slot_counts(events: DataFrame, ts: str, minutes: int, keys: list[str], pattern: str | None = None) -> DataFrame:
    """Events per nearest grid point; with ``pattern`` the point is written as text."""
    slot = nearest_slot_text(F.col(ts), minutes, pattern) if pattern else nearest_slot(F.col(ts), minutes)
    return events.groupBy(slot.alias("slot"), *keys).agg(F.count(F.lit(1)).alias("n"))
