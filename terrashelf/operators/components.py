"""Connected components of a link table, by rounds over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrashelf.session import cut


def connect(edges: DataFrame, report: Callable[[int], None] | None = None) -> DataFrame:
    """node, root for every node of ``edges(a, b)``: the smallest node of its component.

    Large and small stars in turn: every node first links its larger neighbours to its smallest, then its smaller ones;
    the table is written after each round and the rounds, whose number ``report`` is told, end when it stays the same.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).distinct())
    seen, rounds = None, 0
    while True:
        rounds += 1
        both = edges.unionByName(edges.select(F.col("high").alias("low"), F.col("low").alias("high")))
        # Written, so that the join deals both sides itself and can split the rows of a node with many neighbours.
        least = cut(both.groupBy("low").agg(F.least("low", F.min("high")).alias("m")))
        larger = cut(both.where("high > low").join(least, "low").select(F.col("m").alias("low"), "high").distinct())
        least = cut(larger.groupBy("high").agg(F.min("low").alias("m")))
        joined = larger.join(least, "high").select("low", "high", "m")
        smaller = joined.select(F.col("m").alias("low"), F.explode(F.array("low", "high")).alias("high"))
        edges = cut(smaller.where("low <> high").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first()
        if now == seen:
            if report is not None:
                report(rounds)
            return edges.groupBy("high").agg(F.min("low").alias("root")).withColumnRenamed("high", "node")
        seen = now
