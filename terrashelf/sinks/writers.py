"""Exports: CSV, JSON and GeoJSON, written by all tasks side by side."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrashelf.session import mount_point, ship


def export_path(name: str, root: str) -> str:
    """``.csv`` is added to a name without suffix; relative names go under ``root``."""
    if not re.search(r"\.[a-zA-Z0-9]+$", name):
        name = f"{name}.csv"
    return name if name.startswith("/") or "://" in name else f"{root.rstrip('/')}/{name}"


def export_csv(df: DataFrame, name: str, root: str, header: bool = True) -> str:
    """Write ``df`` as a folder of CSV files and give its path."""
    path = export_path(name, root)
    df.write.option("header", header).option("quoteAll", False).option("escape", '"').option("emptyValue", "").csv(path)
    return path


def flat_for_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, since CSV has no nesting."""
    nested = (T.StructType, T.ArrayType, T.MapType, T.VariantType)
    return df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields]
    )


def write_answer(df: DataFrame, path: str, form: str) -> None:
    """The same rows as ``json`` lines or ``csv``, as the caller asks."""
    if form == "json":
        df.write.option("ignoreNullFields", False).json(path)
    elif form == "csv":
        flat_for_csv(df).write.option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"unknown format: {form}")


def write_dump(dump: DataFrame, path: str) -> None:
    """A public dump as JSON lines; the ranges of the sorted table become the files."""
    dump.write.option("ignoreNullFields", False).json(path)


#: The name Spark gives to the folder of a null bucket.
NULL_BUCKET = "__HIVE_DEFAULT_PARTITION__"


def _files_under(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes one file per bucket for rows that come bucket by bucket; a file has its name only once it is whole."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"part-{TaskContext.get().partitionId():05d}.txt"
        hidden = f".{name}.{uuid.uuid4().hex}"
        file, at = None, None
        for batch in batches:
            for bucket, value in zip(*(column.to_pylist() for column in batch.columns)):
                place = f"{folder}/bucket={NULL_BUCKET if bucket is None else bucket}"
                if place != at:
                    if file is not None:
                        file.close()
                        os.replace(f"{at}/{hidden}", f"{at}/{name}")
                    os.makedirs(place, exist_ok=True)
                    file, at = open(f"{place}/{hidden}", "wb"), place
                file.write((value or b"") + b"\n")
        if file is not None:
            file.close()
            os.replace(f"{at}/{hidden}", f"{at}/{name}")
        yield from ()

    return write


def write_texts(df: DataFrame, path: str) -> None:
    """Text files ``bucket=<bucket>/part-*.txt`` with a line per ``value``, one file per bucket and task.

    ``df`` has the columns ``bucket`` (a whole number) and ``value``, and each task's rows come bucket by bucket. In a mounted folder
    the tasks open the files themselves: Spark's writer starts several processes per file there to set permissions, and its
    commit renames each folder on the driver. Elsewhere Spark's writer writes them.
    """
    spark, rows = df.sparkSession, df.select("bucket", "value")
    folder = mount_point(spark, path)
    if folder is None:
        rows.write.partitionBy("bucket").text(path)
        return
    ship(spark)
    os.makedirs(folder)
    written = rows.select(F.col("bucket").cast("long"), F.col("value").cast("binary")).mapInArrow(_files_under(folder), "n long")
    written.write.format("noop").mode("overwrite").save()


def geojson_feature(
    geometry: Column, properties: Column, feature_id: Column, name: Column, title: Column,
    id_as_int: bool = False, decimals: int = 6,
) -> Column:
    """Geometry members, then properties (objects only), id, name and title; absent parts leave no key."""
    rounded = _rounded(geometry, decimals)
    number = feature_id.cast("long").cast("string") if id_as_int else _quoted(feature_id)
    is_object = F.schema_of_variant(F.try_parse_json(properties)).startswith("OBJECT")
    parts = F.array_compact(
        F.array(
            F.substring(rounded, 2, F.length(rounded) - 2),
            F.when(is_object, F.concat(F.lit('"properties":'), properties)),
            F.when(feature_id.isNotNull(), F.concat(F.lit('"id":'), number)),
            F.when(name.isNotNull(), F.concat(F.lit('"name":'), _quoted(name))),
            F.when(title.isNotNull(), F.concat(F.lit('"title":'), _quoted(title))),
        )
    )
    return F.when(geometry.isNotNull(), F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))


def _rounded(geometry: Column, decimals: int) -> Column:
    """The text with every number of more than ``decimals`` places rounded, trailing zeros gone."""
    long_number = rf"-?\d+\.\d{{{decimals + 1},}}"
    between = F.split(geometry, long_number, -1)
    short = F.transform(
        F.regexp_extract_all(geometry, F.lit(long_number), F.lit(0)),
        lambda n: F.regexp_replace(F.round(n.cast("decimal(38,18)"), decimals).cast("string"), r"\.?0+$", ""),
    )
    return F.array_join(F.zip_with(between, short, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def _quoted(text: Column) -> Column:
    """A JSON string: the value of a one-member object, without the object around it."""
    wrapped = F.to_json(F.struct(text.alias("v")))
    return F.substring(wrapped, 6, F.length(wrapped) - 6)
