"""Pack ids: a pack number and a version, written as a decimal with three places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PACK_ID = "decimal(13,3)"


def from_parts(pack: Column, version: Column) -> Column:
    """``(76, 2)`` to ``76.002``; a missing or non-positive version counts as 1."""
    step = F.when(version.isNull() | (version <= 0), F.lit(1)).otherwise(version)
    return (pack.cast("decimal(13,3)") + step.cast("decimal(10,0)") / F.lit(1000).cast("decimal(4,0)")).cast(PACK_ID)


def from_text(text: Column) -> Column:
    """``'76_002'`` to ``76.002``. The sign ``_`` only stands for the point: ``'10_2'`` is version 200."""
    return F.replace(text, F.lit("_"), F.lit(".")).try_cast(PACK_ID)


def pack_of(pack_id: Column) -> Column:
    """The number before the point, cut towards zero."""
    return pack_id.cast("long")


def version_of(pack_id: Column) -> Column:
    return ((pack_id - pack_of(pack_id)) * 1000).cast("int")


def is_valid(pack_id: Column) -> Column:
    """Pack and version are not zero, and the pair leads back to the same id."""
    pack, version = pack_of(pack_id), version_of(pack_id)
    return F.coalesce((pack != 0) & (version != 0) & (from_parts(pack, version) == pack_id), F.lit(False))


def next_version(pack_id: Column) -> Column:
    return from_parts(pack_of(pack_id), version_of(pack_id) + 1)


def to_text(pack_id: Column, separator: str = ".") -> Column:
    """``076.001``: at least three digits, the separator, three decimals."""
    digits = F.abs(pack_id).cast("string")
    whole = F.substring_index(digits, ".", 1)
    padded = F.when(F.length(whole) < 3, F.lpad(whole, 3, "0")).otherwise(whole)
    sign = F.when(pack_id < 0, "-").otherwise("")
    return F.concat(sign, padded, F.lit(separator), F.substring_index(digits, ".", -1))


def pack_text(pack_id: Column) -> Column:
    """Only the pack number, padded to three digits."""
    return F.substring_index(to_text(F.floor(pack_id).cast(PACK_ID)), ".", 1)
