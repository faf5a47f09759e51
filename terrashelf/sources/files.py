"""File manifests and JSON documents."""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrashelf.session import ship


# How each digest is computed.
DIGESTS = {"md5": F.md5, "sha256": lambda c: F.sha2(c, 256)}


def _systems(spark: SparkSession, paths: str | list[str]) -> list[tuple]:
    """Each path with its place and the file system that holds it."""
    context = spark.sparkContext
    places = [(path, context._jvm.org.apache.hadoop.fs.Path(path)) for path in ([paths] if isinstance(paths, str) else paths)]
    return [(path, where, where.getFileSystem(context._jsc.hadoopConfiguration())) for path, where in places]


def is_mounted(spark: SparkSession, paths: str | list[str]) -> bool:
    """Whether all paths lie in folders that tasks can open themselves."""
    return all(system.getUri().getScheme() == "file" for _, _, system in _systems(spark, paths))


def _changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files of a mounted folder with their modification time."""
    for batch in batches:
        times = [int(os.stat(path.removeprefix("file:")).st_mtime * 1000) * 1000 for path in batch.column("path").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(times, pa.timestamp("us", "UTC"))], names=["path", "modification"])


#: Tasks per core that list files. Spark gives every path a task of its own, up to 10,000, which costs far more than the listing.
LISTING_TASKS = 4
_LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def _listed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All files as ``binaryFile`` rows, listed by a few tasks unless the session names their number."""
    read = spark.read.format("binaryFile")
    if spark.conf.get(_LISTING, None) is not None:
        return read.load(paths)
    spark.conf.set(_LISTING, LISTING_TASKS * spark.sparkContext.defaultParallelism)
    try:
        return read.load(paths)
    finally:
        spark.conf.unset(_LISTING)


def _files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All files with their content. The scan passes over empty files, so those are added from its listing.

    The time of an empty file is asked by a task; in a store that only Spark reaches it is null.
    """
    found = _listed(spark, paths).select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("modification"), "content"
    )
    listed = spark.createDataFrame([(unquote(name),) for name in found.inputFiles()], "path string")
    listed = listed.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    empty = listed.join(found.select("path"), "path", "left_anti")
    if is_mounted(spark, paths):
        ship(spark)
        empty = empty.mapInArrow(_changed, "path string, modification timestamp")
    else:
        empty = empty.withColumn("modification", F.lit(None).cast("timestamp"))
    return found.unionByName(empty.select("path", F.lit(0).cast("long").alias("size"), "modification", F.lit(b"").alias("content")))


def _manifest_columns(digest: str | None) -> list[Column]:
    columns = [F.col("path"), F.col("size"), F.col("modification")]
    if digest is not None:
        columns.append(DIGESTS[digest](F.col("content")).alias("hash"))
    return columns


def file_manifest(spark: SparkSession, paths: str | list[str], digest: str | None = None) -> DataFrame:
    """Path, size and modification time per file; ``digest`` adds ``hash`` by 'md5' or 'sha256'.

    Without a digest no content is read. With one, a file is read by one task, as hashing requires.
    """
    return _files(spark, paths).select(*_manifest_columns(digest))


def json_documents(
    spark: SparkSession, paths: str | list[str], digest: str | None = None, missing_ok: bool = False
) -> DataFrame:
    """Whole JSON files with their manifest columns; a text that is no JSON keeps a row with ``error``.

    A document too large for a variant has a null ``document`` and its text in ``large_text``; ``jsonparts.json_values`` reads such
    files as rows. A path that names no file is an error, or no row when ``missing_ok``.
    """
    known = _existing(spark, paths) if missing_ok else paths
    schema = "path string, size long, modification timestamp, content binary"
    found = _files(spark, known) if known else spark.createDataFrame([], schema)
    text = F.decode("content", "UTF-8")
    parsed = found.select(*_manifest_columns(digest), text.alias("_text"), F.try_parse_json(text).alias("document"))
    # A document beyond what a variant holds is still JSON: its text is handed over instead.
    large = F.col("document").isNull() & F.get_json_object("_text", "$").isNotNull()
    return parsed.withColumn("large_text", F.when(large, F.col("_text"))).withColumn(
        "error", F.when(F.col("document").isNull() & ~large, "not JSON")
    ).drop("_text")


def _existing(spark: SparkSession, paths: str | list[str]) -> list[str]:
    """The paths (globs) that match something; the file system of each path is asked."""
    return [path for path, where, system in _systems(spark, paths) if system.globStatus(where)]
