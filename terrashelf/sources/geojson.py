"""GeoJSON collections as tables. Geometry stays GeoJSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashelf.functions import jsonobj
from terrashelf.operators.ranking import numbered
from terrashelf.session import cut, hinted
from terrashelf.sources import jsonparts

NO_LIST = "no list of features"


def _collections(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """The parts of all files; and per file its text without features (``top``), their place ``of`` and what is wrong.

    No file is parsed as a whole: blocks are cut into features by many tasks, and only what stands around the features is put
    together per file.
    """
    parts, files = jsonparts.parts(spark, paths)
    lists = cut(jsonparts.lists(parts, "features"))
    tops = jsonparts.top_texts(parts, files, lists)
    # Of repeated members the last one counts, whichever kind it is.
    listed = F.schema_of_variant(F.element_at(jsonobj.members(F.col("top")), F.lit("features"))).startswith("ARRAY")
    wrong = F.when(F.col("top").isNull(), jsonparts.NOT_AN_OBJECT).when(~F.coalesce(listed, F.lit(False)), NO_LIST)
    last = lists.groupBy("file").agg(F.max("of").alias("of"))
    return parts, cut(tops.join(last, "file", "left").withColumn("_wrong", wrong))


def geojson_headers(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Each collection's members except its features; null with an ``error`` for a file that is no JSON object."""
    _, files = _collections(spark, paths)
    header = F.map_filter(jsonobj.members(F.col("top")), lambda name, _: name != "features")
    return files.select("file", F.to_json(header).alias("header"), F.col("_wrong").alias("error"))


def _features(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Features one a row; a file or feature that cannot be read gives a row with an ``error``."""
    parts, files = _collections(spark, paths)
    top = jsonobj.members(F.col("top"))
    crs = F.coalesce(F.element_at(top, F.lit("crs")), F.parse_json(F.lit("null")))
    known = files.select(
        "file", "of", F.element_at(top, F.lit("type")).cast("string").alias("geojson_type"), F.to_json(crs).alias("_crs_text"), "_wrong")
    found = jsonparts.elements(parts, hinted(cut(known.where("_wrong IS NULL"))))
    null = lambda kind: F.lit(None).cast(kind)
    broken = known.where("_wrong IS NOT NULL").select(*known.columns, null("int").alias("position"), null("string").alias("text"))
    rows = found.unionByName(broken).select(
        "file", "geojson_type", "_wrong", F.col("text").alias("_feature"), F.col("position").alias("feature_id"),
        F.map_from_arrays(F.array(F.lit("crs")), F.array(F.parse_json("_crs_text"))).alias("_crs"))
    return _read_features(rows)


def _read_features(rows: DataFrame) -> DataFrame:
    """``rows(..., _feature, _wrong)`` with the feature's members."""
    part = lambda name: F.expr(f"try_variant_get(_members['{name}'], '$', 'map<string,variant>')")
    found = rows.withColumn("_members", jsonobj.members(F.col("_feature")))
    return (
        found.withColumn("error", F.coalesce("_wrong", F.when(F.col("_members").isNull(), "feature is no JSON object")))
        .withColumn("feature_type", F.element_at("_members", F.lit("type")).cast("string"))
        .withColumn("_properties", part("properties"))
        .withColumn("_geometry", part("geometry"))
    )


def geojson_features(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Features as rows. The outer name joins the properties unless they hold one; crs joins the geometry.

    Large files are cut up by many tasks. ``error`` says what could not be read: a file that is no collection keeps one row, a
    feature that is none its own.
    """
    return _shaped(_features(spark, paths))


def geojson_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The same for files with one feature per line, which split over tasks; ids count a file's lines from 1."""
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_line"), F.col("value").alias("_feature"),
    )
    counted = numbered(lines, ["file"], ["_start", "_line"], "feature_id").withColumn("feature_id", F.col("feature_id").cast("int"))
    crs = F.map_from_arrays(F.array(F.lit("crs")), F.array(F.parse_json(F.lit("null"))))
    rows = counted.where(F.trim("_feature") != "").select(
        "file", "feature_id", F.lit("FeatureCollection").alias("geojson_type"), crs.alias("_crs"),
        F.lit(None).cast("string").alias("_wrong"), "_feature",
    )
    return _shaped(_read_features(rows))


def _shaped(features: DataFrame) -> DataFrame:
    null_json = F.parse_json(F.lit("null"))
    name = F.map_from_arrays(
        F.array(F.lit("name")), F.array(F.coalesce(F.element_at("_members", F.lit("name")), null_json))
    )
    return features.select(
        "file", "feature_id", "geojson_type", "feature_type",
        F.to_json(jsonobj.merged(name, F.col("_properties"))).alias("properties"),
        F.to_json(jsonobj.merged(F.col("_crs"), F.col("_geometry"))).alias("geometry"), "error",
    )


def geojson_features_jgeom(spark: SparkSession, paths: str | list[str], files: DataFrame) -> DataFrame:
    """Features of ``paths`` under the caller's ids: ``files`` lists (path, file_id). Properties are taken as they are."""
    ids = files.select(_plain_path(F.col("path")).alias("_path"), "file_id")
    return _features(spark, paths).join(ids, _plain_path(F.col("file")) == F.col("_path")).select(
        "file_id", "feature_id", "feature_type",
        F.to_json("_properties").alias("properties"),
        F.to_json(jsonobj.merged(F.col("_crs"), F.col("_geometry"))).alias("jgeom"), "error",
    )


def _plain_path(path: Column) -> Column:
    """Local paths compare equal with and without their scheme."""
    return F.regexp_replace(path, "^file:/+", "/")
