"""Audits and summaries of pack ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrashelf.functions import packid


def audited(rows: DataFrame, form: Column, value: Column) -> DataFrame:
    """Rows with their pack id taken apart: pack, version, validity, text forms and the next version.

    ``form`` says how the id was written (text, pair, decimal), ``value`` is the id as a decimal.
    """
    pack_id = value.cast(packid.PACK_ID)
    return rows.select(
        "*",
        form.alias("form"),
        pack_id.alias("pack_id"),
        packid.pack_of(pack_id).alias("pack"),
        packid.version_of(pack_id).alias("version"),
        packid.is_valid(pack_id).alias("is_valid"),
        packid.to_text(pack_id).alias("text_point"),
        packid.to_text(pack_id, "_").alias("text_underscore"),
        packid.pack_text(pack_id).alias("text_pack"),
        packid.next_version(pack_id).alias("next_pack_id"),
    )


def colliding_forms(audit: DataFrame, written: str) -> DataFrame:
    """Pack ids that were written in more than one way."""
    return (
        audit.where("pack_id IS NOT NULL").groupBy("pack_id", "form", written).agg(F.count(F.lit(1)).alias("n"))
        .groupBy("pack_id")
        .agg(F.count(F.lit(1)).alias("n_spellings"), F.sum("n").alias("n_rows"))
        .where("n_spellings > 1")
    )


def highest(rows: DataFrame, keys: list[str], pack_id: str = "pack_id") -> DataFrame:
    """Highest pack id per group (or of the whole table) and the one to use next."""
    top = F.max(F.col(pack_id).cast(packid.PACK_ID))
    found = rows.groupBy(*keys).agg(top.alias("max_pack_id"))
    return found.withColumn("next_pack_id", packid.next_version(F.col("max_pack_id")))
