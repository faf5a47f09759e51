"""Session helpers: shared scratch folder and lineage cuts that survive a lost executor."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or None
    if named is None and context.getCheckpointDir() is not None:
        named = context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="terrashelf-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


_shipped: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Let Python workers import this package, wherever the driver imported it from; once per application.

    Workers find it on their own only if it lies on their path, which depends on how and where the driver was started.
    """
    context = (spark or SparkSession.getActiveSession()).sparkContext
    root = Path(__file__).parent
    if context.applicationId in _shipped or not root.is_dir():
        return
    target = Path(tempfile.mkdtemp(prefix="terrashelf-code-")) / "terrashelf.zip"
    with zipfile.ZipFile(target, "w") as packed:
        for file in sorted(root.rglob("*.py")):
            packed.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def mount_point(spark: SparkSession, path: str) -> str | None:
    """The folder as tasks can open it themselves, or None in a store that only Spark reaches."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(context._jsc.hadoopConfiguration())
    return system.makeQualified(where).toUri().getPath() if system.getUri().getScheme() == "file" else None


_made: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path under the shared folder; ``discard`` deletes what was written there."""
    path = f"{shared_dir(spark).rstrip('/')}/terrashelf-{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def discard(spark: SparkSession) -> int:
    """Delete every table this process wrote under the shared folder, once no DataFrame needs them; gives their number."""
    context, gone = spark.sparkContext, 0
    while _made:
        where = context._jvm.org.apache.hadoop.fs.Path(_made.pop())
        gone += bool(where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True))
    return gone


#: How tables that are written are compressed: digests in hexadecimal take half the bytes of Spark's default.
COMPRESSION = "zstd"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    The lineage ends at files that outlive executors, and the next plan knows their size.
    """
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path, compression=COMPRESSION)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The most bytes of a side that is broadcast; a larger side is joined by shuffle.
BROADCAST_BYTES = 16 * 1024 * 1024


def hinted(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with its bytes counted: broadcast up to ``most``, a merge join beyond.

    For the small side of a join whose other side explodes rows: its planned size is that of the files
    behind it, so Spark might otherwise broadcast the side that grows.
    """
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if size <= most else df.hint("merge")


def measured(df: DataFrame) -> DataFrame:
    """``hinted`` for a table that is costly to compute: written first."""
    return hinted(cut(df))
