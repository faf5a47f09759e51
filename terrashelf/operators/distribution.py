"""Counts per grid cell: statistics, shares, share text and the quantile roll-up.

A distribution is a long table (dataset, key, n) with unique keys per dataset, n >= 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrashelf.operators.ranking import numbered
from terrashelf.session import cut, measured


def _histogram(cells: DataFrame, *extra) -> DataFrame:
    """Cells per (dataset, n).

    Partially aggregated before its shuffle. d distinct counts add up to at least d*(d-1)/2, so a
    dataset of total T keeps at most about sqrt(2T) rows: the windows below stay small even when one
    dataset holds most of the cells.
    """
    return cells.groupBy("dataset", "n").agg(F.count(F.lit(1)).alias("cells"), *extra)


def _quantile(p: float, running: str, total: str):
    """Smallest n whose running share reaches ``p``, a single-precision number as in the parameter's type."""
    share = F.lit(p).cast("float").cast("double")
    return F.min(F.when(F.col(running) >= share * F.col(total), F.col("n")))


def statistics(cells: DataFrame) -> DataFrame:
    """Keys, total, mean, deviation, median, least and greatest count per dataset."""
    whole = Window.partitionBy("dataset")
    running = whole.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = (
        _histogram(cells)
        .withColumn("running", F.sum("cells").over(running))
        .withColumn("keys", F.sum("cells").over(whole))
        .withColumn("n_tot", F.sum(F.col("n") * F.col("cells")).over(whole))
        .withColumn("mean", F.col("n_tot") / F.col("keys"))
    )
    spread = F.sum(F.col("cells") * F.pow(F.col("n") - F.col("mean"), 2)) / F.first("keys")
    return counted.groupBy("dataset").agg(
        F.first("keys").alias("keys"),
        F.first("n_tot").alias("n_tot"),
        F.round(F.first("mean")).cast("long").alias("n_avg"),
        F.round(F.sqrt(spread)).cast("long").alias("n_dev"),
        _quantile(0.5, "running", "keys").alias("n_median"),
        F.min("n").alias("n_min"),
        F.max("n").alias("n_max"),
    )


def shares(cells: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """Each cell with its dataset's total and its share in whole percent.

    The totals have one row per dataset and are broadcast if their bytes allow, so the cells stay where they are.
    """
    if totals is None:
        totals = measured(_totals(cells))
    percent = F.round(
        F.col("n").cast("decimal(20,0)") * 100 / F.col("total").cast("decimal(20,0)"), 0
    ).cast("long")
    return cells.join(totals, "dataset").withColumn("share", percent)


def _totals(cells: DataFrame) -> DataFrame:
    return cells.groupBy("dataset").agg(F.sum("n").alias("total"))


def share_text(
    cells: DataFrame, percent: bool = True, link: str = "", separator: str = ", ", part_cells: int = 1000
) -> DataFrame:
    """The distribution as text in key order, in parts of ``part_cells`` cells.

    The parts of a dataset, joined by ``separator`` in part order, are the whole text; a rolled-up
    distribution has one part. Raw counts carry the ``%`` sign too, as in the published format.
    """
    code = F.concat(F.lit("<code>"), F.col("key"), F.lit("</code>"))
    if link:
        code = F.concat(F.lit(f'<a href="{link}'), F.col("key"), F.lit('.geojson">'), code, F.lit("</a>"))
    number = F.col("share") if percent else F.col("n")
    ranked = numbered(cells, ["dataset"], ["key"], "position")
    base = shares(ranked, measured(_totals(cells))) if percent else ranked
    # Grouped by one struct: rows that lie by dataset are dealt anew, so a dataset's parts spread over tasks.
    part = F.struct("dataset", F.floor((F.col("position") - 1) / part_cells).alias("part"))
    return (
        base.select(
            part.alias("_part"), "key", F.concat(code, F.lit(": "), number.cast("string"), F.lit("%")).alias("_text")
        )
        .groupBy("_part")
        .agg(
            F.count(F.lit(1)).alias("cells"),
            F.expr(f"listagg(_text, {_quoted(separator)}) WITHIN GROUP (ORDER BY key)").alias("text"),
        )
        .select("_part.dataset", "_part.part", "cells", "text")
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rollup(
    cells: DataFrame, size: int = 6, max_cells: int = 10, percentile: float = 0.75, floor: int | None = None
) -> DataFrame:
    """Merge small cells into coarser prefixes until a dataset has at most ``max_cells`` cells.

    Every round treats all datasets at once. Cells below the percentile go to the prefix of the
    round's length; with a ``floor`` a prefix group that adds up to it stays fine. Counts that meet
    under one key are added, so a dataset's total never changes. A round's result is written to the
    checkpoint folder, finished datasets leave the loop, and at most ``size`` rounds run.
    """
    finished = []
    active = cells.select("dataset", "key", F.col("n").cast("long").alias("n"), F.lit(size).alias("size"))
    for _ in range(max(size, 0)):
        stepped = cut(_round(active, max_cells, percentile, floor))
        finished.append(stepped.where("done"))
        active = stepped.where("NOT done").drop("done")
        if active.isEmpty():
            break
    result = active.select("dataset", "key", "n")
    for part in finished:
        result = result.unionByName(part.select("dataset", "key", "n"))
    return result


def _round(active: DataFrame, max_cells: int, percentile: float, floor: int | None) -> DataFrame:
    whole = Window.partitionBy("dataset")
    running = whole.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    plan = (
        _histogram(active, F.max(F.length("key")).alias("longest"), F.max("size").alias("size"))
        .withColumn("running", F.sum("cells").over(running))
        .withColumn("keys", F.sum("cells").over(whole))
        .groupBy("dataset")
        .agg(
            F.first("keys").alias("keys"),
            (F.max("size") - (F.max("size") >= F.max("longest")).cast("int")).alias("cut_at"),
            _quantile(percentile, "running", "keys").alias("limit"),
        )
        .withColumn("done", (F.col("cut_at") < 1) | F.lit(max_cells < 2) | (F.col("keys") <= max_cells))
    )
    small = ~F.col("done") & (F.col("n") < F.col("limit"))
    prefix = F.expr("left(key, cut_at)")
    marked = active.drop("size").join(measured(plan), "dataset").withColumn("small", small).withColumn("prefix", prefix)
    merge = F.col("small")
    if floor is not None:
        # Grouped by one struct here and below: cells of one dataset spread over all tasks.
        groups = (
            marked.where("small").groupBy(F.struct("dataset", "prefix").alias("_g")).agg(F.sum("n").alias("_sum"))
            .where(F.col("_sum") < floor).select("_g.dataset", "_g.prefix", F.lit(True).alias("_light"))
        )
        marked = marked.join(groups, ["dataset", "prefix"], "left")
        merge = F.col("small") & F.coalesce("_light", F.lit(False))
    return (
        marked.withColumn("key", F.when(merge, F.col("prefix")).otherwise(F.col("key")))
        .groupBy(F.struct("dataset", "key").alias("_cell"))
        .agg(F.sum("n").alias("n"), (F.max("cut_at") - 1).alias("size"), F.max("done").alias("done"))
        .select("_cell.dataset", "_cell.key", "n", "size", "done")
    )
