"""Grid cells to municipalities through a table of listed prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrashelf.operators.prefix import longest_prefix


def cells_to_places(cells: DataFrame, cell: str, crosswalk: DataFrame) -> DataFrame:
    """Each cell with the place of its longest listed prefix, the short prefix and the rest of the code.

    A row with subcells only takes cells whose next sign is among them. Cells without any place keep
    nulls. Rows that list the same prefix give one result each; see ``overlapping_prefixes``.
    """
    allowed = crosswalk.select(
        "isolabel_ext", "subprefix", "prefix",
        # A restricted row is the union of its one-sign-longer prefixes.
        F.explode(
            F.when(F.col("subcells").isNull(), F.array("prefix")).otherwise(
                F.transform("subcells", lambda s: F.concat("prefix", s))
            )
        ).alias("_covers"),
    )
    matched = longest_prefix(cells, cell, allowed, "_covers")
    return matched.join(allowed, matched["matched_prefix"] == allowed["_covers"], "left").select(
        *cells.columns, "isolabel_ext", "subprefix", "prefix",
        F.expr(f"substr(`{cell}`, length(prefix) + 1)").alias("rest"),
    )


def overlapping_prefixes(crosswalk: DataFrame) -> DataFrame:
    """Prefixes (with their next sign, if restricted) that more than one row covers."""
    covers = crosswalk.select(
        "isolabel_ext",
        F.explode(
            F.when(F.col("subcells").isNull(), F.array("prefix")).otherwise(
                F.transform("subcells", lambda s: F.concat("prefix", s))
            )
        ).alias("covers"),
    )
    return covers.groupBy("covers").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("isolabel_ext").alias("n_places")
    ).where("n_rows > 1")
