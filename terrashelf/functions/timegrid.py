"""Nearest point of a grid of N minutes that starts at every full hour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest_slot(ts: Column, minutes: int) -> Column:
    """The grid point nearest to ``ts``; half-way times go to the even step."""
    minute, second = F.minute(ts), F.extract(F.lit("SECOND"), ts)
    steps = F.rint((minute + second.cast("double") / 60) / F.lit(float(minutes))).cast("int")
    return ts - F.make_dt_interval(mins=minute, secs=second) + F.make_dt_interval(mins=steps * minutes)


def nearest_slot_text(ts: Column, minutes: int, pattern: str) -> Column:
    """The grid point written with a Spark datetime pattern."""
    return F.date_format(nearest_slot(ts, minutes), pattern)
