"""Profiles and rewrites over a column of JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrashelf.functions import jsonobj


def key_profile(docs: DataFrame, column: str) -> DataFrame:
    """Presence, nulls and length per member name."""
    pairs = docs.select(F.explode(F.map_entries(jsonobj.members(F.col(column)))).alias("m"))
    return pairs.groupBy(F.col("m.key").alias("key")).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.count_if(F.is_variant_null("m.value")).alias("n_null"),
        F.max(F.length("m.key")).alias("key_length"),
    )


def object_sizes(docs: DataFrame, column: str) -> DataFrame:
    """Documents per number of members and longest member name; non-objects have neither."""
    names = F.map_keys(jsonobj.members(F.col(column)))
    longest = F.array_max(F.transform(names, lambda k: F.length(k)))
    return docs.select(
        F.when(names.isNotNull(), F.size(names)).alias("n_keys"), longest.alias("longest_key")
    ).groupBy("n_keys", "longest_key").agg(F.count(F.lit(1)).alias("n_docs"))


def stripped(docs: DataFrame, column: str, keep_empty: bool = True) -> DataFrame:
    """The documents without null members; with ``keep_empty`` off an empty object becomes null."""
    return docs.withColumn(column, jsonobj.strip_nulls(F.col(column), keep_empty))


def dropped_keys(docs: DataFrame, column: str) -> DataFrame:
    """How often each member would be dropped for being null, at every depth; ``a.b`` is member b of a."""
    return docs.select(F.explode(jsonobj.dropped_names(F.col(column))).alias("key")).groupBy("key").agg(
        F.count(F.lit(1)).alias("n_dropped")
    )


def array_elements(docs: DataFrame, key: str, column: str) -> DataFrame:
    """One row per array element with its position; a null or empty array keeps one row without element."""
    texts = jsonobj.array_texts(F.col(column))
    return docs.select(key, texts.isNull().alias("is_null"), F.posexplode_outer(texts).alias("pos", "element"))


def element_counts(docs: DataFrame, column: str) -> DataFrame:
    return docs.select(F.explode(jsonobj.array_texts(F.col(column))).alias("element")).groupBy("element").agg(
        F.count(F.lit(1)).alias("n")
    )


def one_member(docs: DataFrame, key: str, column: str, name: str, rename: str | None = None) -> DataFrame:
    """One member of every document as an object of its own, and whether it was there."""
    present = F.coalesce(F.map_contains_key(jsonobj.members(F.col(column)), name), F.lit(False))
    return docs.select(key, jsonobj.picked(F.col(column), name, rename).alias("slice"), present.alias("present"))


def flag_outcomes(rows: DataFrame, column: str, default: bool | None = None) -> DataFrame:
    """Rows per raw flag text and what it was read as."""
    from terrashelf.functions.text import clean_flag

    return rows.groupBy(F.col(column).alias("raw"), clean_flag(F.col(column), default).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n_rows")
    )
