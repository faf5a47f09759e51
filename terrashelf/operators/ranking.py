"""Row numbers that hold when one group keeps a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrashelf.session import cut

#: Keys are dealt into so many buckets by their hash; the keys of a bucket with so many rows are taken as hot.
BUCKETS, HOT_ROWS = 1 << 16, 1_000_000


def bucket(*keys: Column | str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def hot_buckets(df: DataFrame, *keys: Column | str) -> list[int]:
    """The buckets of ``keys`` that hold ``HOT_ROWS`` rows or more; at most one for every so many rows of the table."""
    counts = df.select(bucket(*keys).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    return [r.b for r in counts.where(F.col("n") >= HOT_ROWS).collect()]


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    """Number the rows of each ``keys`` group from 1 in ``order``; no keys means the whole table.

    Rows are dealt out by key, once, and numbered there. Only keys that may be hot by a count of buckets go through
    ``_by_slices``, so no group has to fit in one task. Rows that are equal in ``order`` are numbered by arrival.
    """
    if not keys:
        return _by_slices(df, keys, order, name)
    hot = hot_buckets(df, *keys)
    is_hot = bucket(*keys).isin(hot)
    group = Window.partitionBy(*keys).orderBy(*order, "_arrival")
    rows = df.where(~is_hot) if hot else df
    rank = F.row_number().over(group).cast("long")
    found = rows.withColumn("_arrival", F.monotonically_increasing_id()).withColumn(name, rank).select(*df.columns, name)
    return found.unionByName(_by_slices(df.where(is_hot), keys, order, name)) if hot else found


def _by_slices(df: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    """``numbered`` for groups of any size.

    The table is range-partitioned on keys and order, each slice is numbered on its own and shifted by the rows of its
    group before it.
    """
    # Equal rows are spread too: the arrival number breaks ties between copies.
    sliced = cut(
        df.withColumn("_arrival", F.monotonically_increasing_id())
        .repartitionByRange(*keys, *order, "_arrival")
        .withColumn("_slice", F.spark_partition_id())
    )
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy(*keys, "_slice").count()
        .withColumn("_before", F.sum("count").over(before))
        .select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_slice").alias("_k_slice"), "_before")
    )
    within = Window.partitionBy(*keys, "_slice").orderBy(*order, "_arrival")
    same = F.col("_slice") == F.col("_k_slice")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (
        sliced.withColumn("_rank", F.row_number().over(within))
        .join(offsets, same, "left")
        .withColumn(name, (F.col("_rank") + F.coalesce("_before", F.lit(0))).cast("long"))
        .select(*df.columns, name)
    )
