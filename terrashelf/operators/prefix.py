"""Prefix and substring joins written as equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrashelf.session import cut, hinted, measured


def lengths_of(df: DataFrame, column: str):
    """The distinct lengths in ``column`` as one sorted array, usable as a scalar in another plan."""
    return df.agg(F.array_sort(F.collect_set(F.length(column)))).scalar()


def prefix_lengths(text, lengths):
    """Those of ``lengths`` that a text is long enough for; none when there are no lengths at all."""
    return F.filter(F.coalesce(lengths, F.array().cast("array<int>")), lambda n: n <= F.length(text))


def longest_prefix(keys: DataFrame, key: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """``keys`` with ``matched_prefix``: the longest listed prefix of each key, null when none fits.

    Each distinct key is cut to the lengths that occur among the prefixes and joined on equality, so
    copies of a key are probed once and no LIKE join arises.
    """
    listed = measured(prefixes.select(F.col(prefix).alias("_prefix")).where(F.col("_prefix").isNotNull()).distinct())
    probes = (
        keys.select(F.col(key).alias("_key")).where(F.col("_key").isNotNull()).distinct()
        .withColumn("_lengths", lengths_of(listed, "_prefix"))
        .select("_key", F.explode(prefix_lengths(F.col("_key"), F.col("_lengths"))).alias("_n"))
        .select("_key", F.expr("left(_key, _n)").alias("_prefix"))
    )
    longest = probes.join(listed, "_prefix").groupBy("_key").agg(F.max(F.length("_prefix")).alias("_n"))
    best = longest.select("_key", F.expr("left(_key, _n)").alias("matched_prefix"))
    return keys.join(best, keys[key] == best["_key"], "left").drop("_key")


def grams(text, size: int):
    """All distinct substrings of ``size`` signs."""
    return F.array_distinct(
        F.transform(
            F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))).otherwise(
                F.array().cast("array<int>")
            ),
            lambda i: F.substring(text, i, F.lit(size)),
        )
    )


def containing(needles: DataFrame, needle: str, rows: DataFrame, key: str, text: str) -> DataFrame:
    """Pairs of needle and row key where the row's text contains the needle.

    A needle is looked up by the rarest of its three-sign pieces (or by itself, when shorter), and
    candidates are checked in full. Texts are cut to the pieces that some needle asks for.
    """
    asked = needles.select(F.col(needle).alias("_needle")).where(F.length(needle) > 0).distinct()
    size = F.least(F.length("_needle"), F.lit(3))
    wanted = cut(asked.select(
        "_needle",
        F.explode(
            F.when(size == 3, grams(F.col("_needle"), 3)).when(size == 2, grams(F.col("_needle"), 2)).otherwise(
                F.array("_needle")
            )
        ).alias("_gram"),
    ))
    # Only lengths that some needle's piece has, and one narrow table of (row, piece) that both later steps read.
    sizes = F.coalesce(lengths_of(wanted, "_gram"), F.array().cast("array<int>"))
    texts = rows.select(F.col(key).alias("_row"), F.col(text).alias("_text")).where(F.col(text).isNotNull())
    cuts = [F.when(F.array_contains("_sizes", n), grams(F.col("_text"), n)).otherwise(F.array().cast("array<string>")) for n in (1, 2, 3)]
    pieces = cut(
        texts.withColumn("_sizes", sizes).select("_row", F.explode(F.concat(*cuts)).alias("_gram"))
        .join(hinted(wanted.select("_gram").distinct()), "_gram", "left_semi")
    )
    counts = pieces.groupBy("_gram").agg(F.count(F.lit(1)).alias("_rows"))
    rarest = wanted.join(counts, "_gram").groupBy("_needle").agg(
        F.min_by("_gram", F.struct("_rows", "_gram")).alias("_gram")
    )
    candidates = pieces.join(measured(rarest), "_gram").select("_row", "_needle")
    return (
        texts.join(measured(candidates), "_row")
        .where(F.contains("_text", "_needle"))
        .select(F.col("_needle").alias(needle), F.col("_row").alias(key))
    )


#: Partitions of a stored index of pieces, and the signs of its pieces. The longest that a needle has room for leads to its rows:
#: pieces of three signs alone would be shared by a fixed part of all rows, however many there are.
INDEX_PARTS = 64
INDEX_SIGNS = (1, 3, 5, 8)


def _piece_part(parts: int):
    return F.pmod(F.xxhash64("gram"), F.lit(parts)).cast("int")


def store_piece_index(rows: DataFrame, key: str, texts: dict[str, str], path: str, parts: int = INDEX_PARTS) -> None:
    """Write which rows hold which pieces of ``INDEX_SIGNS`` signs: ``pieces`` (field, gram, row) and ``counts`` (field, gram, n).

    ``texts`` names a field and the SQL expression of its text. Built once for a version of the table; both tables are partitioned
    by field and by the hash of the piece, so a lookup reads the partitions it asks for.
    """
    listed = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.expr(t).alias("text")) for f, t in texts.items()]))
    fields = rows.select(F.col(key).alias("row"), listed.alias("f")).select("row", "f.field", "f.text").where("text IS NOT NULL")
    pieces = fields.select("field", "row", F.explode(F.concat(*[grams(F.col("text"), n) for n in INDEX_SIGNS])).alias("gram"))
    layout = ["field", "part"]
    pieces.withColumn("part", _piece_part(parts)).repartition(*layout, "gram").sortWithinPartitions(*layout, "gram").write.partitionBy(
        *layout).parquet(f"{path}/pieces")
    counts = rows.sparkSession.read.parquet(f"{path}/pieces").groupBy("field", "gram").agg(F.count(F.lit(1)).alias("n"))
    counts.withColumn("part", _piece_part(parts)).repartition(*layout).write.partitionBy(*layout).parquet(f"{path}/counts")


def containing_indexed(needles: DataFrame, path: str, rows: DataFrame, key: str, texts: dict[str, str], parts: int = INDEX_PARTS) -> DataFrame:
    """``needles(field, needle)`` with the row key of every row whose text of that field contains the needle.

    The stored counts tell the rarest of a needle's longest pieces, the stored pieces its rows; only those are checked in full. No text is taken apart, and nothing runs before the answer is asked for.
    """
    spark = needles.sparkSession
    asked = needles.where(F.length("needle") > 0).select("field", "needle").distinct()
    signs = F.greatest(*[F.when(F.length("needle") >= n, F.lit(n)) for n in INDEX_SIGNS])
    pick = lambda n: F.when(signs == n, grams(F.col("needle"), n)).otherwise(F.array().cast("array<string>"))
    wanted = asked.select("field", "needle", F.explode(F.concat(*map(pick, INDEX_SIGNS))).alias("gram")).withColumn("part", _piece_part(parts))
    counts = spark.read.schema("gram string, n long, field string, part int").parquet(f"{path}/counts")
    # A piece that no row holds settles its needle: an inner join would hide it behind the others.
    counted = wanted.join(counts, ["field", "part", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("field", "needle").agg(F.min_by(F.struct("part", "gram"), F.struct("n", "gram")).alias("g"), F.min("n").alias("n"))
    rarest = rarest.where("n > 0").select("field", "needle", "g.part", "g.gram")
    pieces = spark.read.schema(
        f"row {rows.schema[key].dataType.simpleString()}, gram string, field string, part int").parquet(f"{path}/pieces")
    candidates = pieces.join(rarest, ["field", "part", "gram"]).select("field", "needle", F.col("row").alias(key))
    narrow = rows.select(key, *[F.expr(expression).alias(f"_{field}") for field, expression in texts.items()])
    text = F.coalesce(*[F.when(F.col("field") == field, F.col(f"_{field}")) for field in texts])
    return narrow.join(candidates, key).where(F.contains(text, "needle")).select("field", "needle", key)
