"""Small tables with the cases every operator must take: nulls, empty and long texts, ties, repeats, odd columns."""

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    T.StructField("target", T.StringType()),
    T.StructField("fp", T.StringType()),
])

LONG = "lorem ipsum dolor sit amet " * 4000


def docs(spark, rows):
    """``rows`` of (doc_id, text) or (doc_id, text, source), with columns that clash with names of results."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), "t", "f") for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


ODD = [
    (1, None), (2, ""), (3, "Same Text here"), (4, "same text HERE"), (4, "same text HERE"), (9, "same text here"),
    (5, LONG), (6, LONG), (7, "É same"), (8, "é same"), (None, "same text here"), (None, "alone"), (10, " \t\n"),
    (11, "a b"), (12, "A\tb"),
]
