"""Tab-separated table exports with array and geometry columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load_tsv_export(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    r"""Text columns as exported: ``\N`` is null and nothing is quoted."""
    return spark.read.schema(schema).option("sep", "\t").option("nullValue", "\\N").option("quote", "").option(
        "emptyValue", ""
    ).csv(paths)


def array_column(text: Column) -> Column:
    """``{a,b}`` as an array; ``{}`` is empty."""
    inner = F.trim(text, F.lit("{}"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, ","))


def flag_column(text: Column) -> Column:
    return F.when(text == "t", True).when(text == "f", False)


def geometry_srid(hex_text: Column) -> Column:
    """Reference system of a little-endian EWKB text whose SRID flag is set."""
    turned = F.concat(*[F.substring(hex_text, i, 2) for i in (17, 15, 13, 11)])
    return F.when(_has_srid(hex_text), F.conv(turned, 16, 10).cast("int"))


def _has_srid(hex_text: Column) -> Column:
    """Flag 0x20 in the highest byte of the type, digits 9 and 10."""
    return F.conv(F.substring(hex_text, 9, 1), 16, 10).cast("int").bitwiseAND(2) != 0


def plain_wkb(hex_text: Column) -> Column:
    """The geometry without its SRID, as binary WKB (no Z or M)."""
    bare = F.concat(F.substring(hex_text, 1, 8), F.lit("00"), F.substring(hex_text, 19, 2147483647))
    return F.unhex(F.when(_has_srid(hex_text), bare).otherwise(hex_text))


def crosswalk_rows(loaded: DataFrame) -> DataFrame:
    """A loaded crosswalk export with its arrays, flags and geometry decoded."""
    return loaded.select(
        "isolabel_ext", "subprefix", "prefix", array_column(F.col("subcells")).alias("subcells"),
        flag_column(F.col("is_subdiv_default")).alias("is_subdiv_default"),
        geometry_srid(F.col("geom")).alias("srid"), plain_wkb(F.col("geom")).alias("wkb"),
    )
