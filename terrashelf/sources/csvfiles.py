"""CSV deliveries: declared tables and header inventories."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrashelf.session import cut, ship
from terrashelf.sources import blocks
from terrashelf.sources.files import is_mounted

BAD = "_bad_record"


def load_csv(
    spark: SparkSession, paths: str | list[str], schema: str, sep: str = ",", multi_line: bool = True
) -> DataFrame:
    """Files with a declared schema. Headers must agree with it.

    Fields are read as text and cast one by one, so a line is judged by all its fields whichever of
    them a query uses. A line that does not fit is kept as text in ``_bad_record``, fields null where
    they cannot be read. With ``multi_line`` a quoted value may hold line breaks; without it a line whose quotes do not
    close is bad. Files split over tasks either way.
    """
    fields = T.StructType.fromDDL(schema).fields
    names = [f.name for f in fields]
    if multi_line:
        raw = _by_records(spark, paths, names, sep)
    else:
        raw = _by_lines(spark, paths, names, sep)
    typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in fields}
    misfit = reduce(lambda x, y: x | y, (F.col(n).isNotNull() & c.isNull() for n, c in typed.items()))
    line = F.to_json(F.struct(*typed))
    return raw.select(
        *[c.alias(n) for n, c in typed.items()], F.coalesce(F.col(BAD), F.when(misfit, line)).alias(BAD)
    )


def _reader(spark: SparkSession, names: list[str], sep: str):
    texts = T.StructType([T.StructField(name, T.StringType()) for name in [*names, BAD]])
    return (
        spark.read.schema(texts)
        .option("header", True)
        .option("sep", sep)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", BAD)
    )


_BEYOND = "_beyond"


def _check_headers(spark: SparkSession, paths: str | list[str], names: list[str], sep: str) -> None:
    heads = csv_headers(spark, paths, sep=re.escape(sep)).groupBy("file").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "column"))), lambda h: F.lower(h["column"])).alias("names")
    )
    wrong = heads.where(F.col("names") != F.array(*[F.lit(n.lower()) for n in names])).first()
    if wrong is not None:
        raise ValueError(f"header of {wrong['file']} is {wrong['names']}, not {names}")


def _by_lines(spark: SparkSession, paths: str | list[str], names: list[str], sep: str) -> DataFrame:
    """One record a line. A column beyond the last is asked for, so every good line is short of one and comes with its text."""
    _check_headers(spark, paths, names, sep)
    lines = _reader(spark, [*names, _BEYOND], sep).csv(paths)
    count = lambda text, sign: (F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))) / len(sign)
    bare = F.regexp_replace(BAD, '"[^"]*"', "")
    bad = F.col(BAD).isNull() | (count(F.col(BAD), '"') % 2 != 0) | (count(bare, sep) != len(names) - 1)
    line = F.coalesce(F.col(BAD), F.concat_ws(sep, *names, _BEYOND))
    return lines.select(*names, F.when(bad, line).alias(BAD))


def _by_records(spark: SparkSession, paths: str | list[str], names: list[str], sep: str) -> DataFrame:
    """One record for all lines up to the one that closes its quotes."""
    _check_headers(spark, paths, names, sep)
    record = F.regexp_replace("text", "\r$", "")
    texts = csv_records(spark, paths, sep).where(F.trim(record) != "").select(record.alias("text"))
    schema = ", ".join(f"`{name}` string" for name in [*names, BAD])
    options = {"sep": sep, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    # Generated, since a condition on fields would else be pushed below and parse the text again for each of them.
    return texts.select(F.inline(F.array(F.from_csv("text", schema, options))))


def csv_records(spark: SparkSession, paths: str | list[str], sep: str = ",") -> DataFrame:
    """file, place (from 2, after the header) and text of every record; line breaks in quoted values belong to the record.

    A quote counts where it opens a value, as it does for Spark's reader: after a separator or at a line's start. Per block
    is computed whether a value is open at its end, for both cases at its start, and that is composed over the blocks of
    a file; then each block is cut into records.
    """
    read = blocks.lines(spark, paths, "\n")
    maps = cut(read.select("file", "block", "text").mapInArrow(_quotes(sep), "file string, block long, end0 int, end1 int"))
    # A block sets the state, if both cases end alike, or keeps or turns it.
    turns = (F.col("end0") == 1) & (F.col("end1") == 0)
    so_far = Window.partitionBy("file").orderBy("block")
    counted = maps.withColumn("_turns", F.sum(turns.cast("int")).over(so_far))
    sets = F.when(F.col("end0") == F.col("end1"), F.col("end0") - F.col("_turns"))
    inside = F.pmod(F.coalesce(blocks.last_before(sets), F.lit(0)) + blocks.before(turns.cast("int")), F.lit(2))
    states = cut(counted.select("file", "block", inside.cast("int").alias("inside")))
    fragments = blocks.with_state(read, states).select("file", "block", "inside", "text").mapInArrow(
        _records(sep), "file string, block long, seq long, begins boolean, ends boolean, text string, of_seq long")
    return blocks.whole(fragments).where("place > 1").select("file", "place", "text")


def _line_end(sep: str):
    """A function of a line and whether a value is open before it: whether one is open after it."""
    quote, part = b'"', re.escape(sep.encode())
    # Runs of other signs are taken at once: sign by sign the pattern would cost most of the pass.
    rest = b'[^"]*+(?:""[^"]*+)*+"'
    closed = re.compile(b'(?:^|' + part + b')"' + rest)
    opened = re.compile(b'(?:^|' + part + b')"')
    closes = re.compile(b'^' + rest)

    def end(line: bytes, inside: int) -> int:
        if quote not in line:
            return inside
        if inside:
            found = closes.match(line)
            if found is None:
                return 1
            # What follows the closing quote goes on as after a value.
            line = b"x" + line[found.end() :]
        return int(opened.search(closed.sub(b"x", line)) is not None)

    return end


def _quotes(sep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, rows, state = _line_end(sep), [], (0, 1)
        for name, texts in blocks.spans(batches, ["file", "block"]):
            if texts is None:
                rows.append((*name, *state))
                state = (0, 1)
                continue
            first, second = state
            for line in texts:
                if b'"' in line:
                    # Cases that once agree do so from then on.
                    second = end(line, second) if second != first else None
                    first = end(line, first)
                    second = first if second is None else second
            state = first, second
        if rows:
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file", "block", "end0", "end1"])

    return run


def _records(sep: str):
    names = ("file", "block", "seq", "begins", "ends", "text", "of_seq")

    def batch(file: str, block: int, rows: list[tuple]) -> pa.RecordBatch:
        seq, begins, ends, text = zip(*rows)
        same = lambda value, kind: pa.repeat(pa.scalar(value, kind), len(rows))
        return pa.RecordBatch.from_arrays([
            same(file, pa.string()), same(block, pa.int64()), pa.array(seq, pa.int64()), pa.array(begins, pa.bool_()),
            pa.array(ends, pa.bool_()), pa.array(text, pa.string()), same(None, pa.int64())], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, started = _line_end(sep), False
        for (file, block, inside), texts in blocks.spans(batches, ["file", "block", "inside"]):
            if not started:
                # A value open here belongs to a record of the block before, whose break joins its lines.
                now, seq, begins = inside, 1 - inside, not inside
                held = [b""] if inside else []
            rows = []
            for line in texts or []:
                now = end(line, now)
                held.append(line)
                if not now:
                    rows.append((seq, begins, True, b"\n".join(held).decode("utf-8", "replace")))
                    held, seq, begins = [], seq + 1, True
            started = texts is not None
            if not started and held:
                rows.append((seq, begins, False, b"\n".join(held).decode("utf-8", "replace")))
            if rows:
                yield batch(file, block, rows)

    return run


def good_rows(loaded: DataFrame) -> DataFrame:
    return loaded.where(F.col(BAD).isNull()).drop(BAD)


def _first_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            with open(path.removeprefix("file:"), "rb") as file:
                found.append(file.readline().rstrip(b"\n").removeprefix(b"\xef\xbb\xbf").decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column("file"), pa.array(found, pa.string())], names=["file", "_header"])


#: Ends of names that Spark's readers decompress.
COMPRESSED = r"\.(gz|bz2|zst|lz4|snappy|deflate)$"


def _heads(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file and _header, the first line, of every file that holds anything.

    Files of a mounted folder are opened by their task and read up to the first line end. Compressed files and a store that only
    Spark reaches have no reader that stops there: those are streamed line by line and the first line of their first block
    goes on.
    """
    file = F.col("_metadata.file_path")
    read = spark.read.option("lineSep", "\n").text(paths)
    mounted = is_mounted(spark, paths)
    streamed = (
        (read.where(file.rlike(COMPRESSED)) if mounted else read)
        .select("value", file.alias("file"), F.col("_metadata.file_block_start").alias("_start"))
        .where("_start = 0")
        .withColumn("_line", F.monotonically_increasing_id())
        .groupBy("file")
        .agg(F.min_by("value", "_line").alias("_header"))
    )
    if not mounted:
        return streamed
    ship(spark)
    files = spark.read.format("binaryFile").load(paths).where(~file.rlike(COMPRESSED)).select(file.alias("file"), "path")
    return files.mapInArrow(_first_lines, "file string, _header string").unionByName(streamed)


def csv_headers(
    spark: SparkSession, paths: str | list[str], sep: str = ",", lower: bool = False, zero_based: bool = True
) -> DataFrame:
    """One row per file, column name and position. ``sep`` is a regular expression.

    Quotes vanish before the split, so a quoted separator splits as well. No file is held in memory.
    """
    line = F.regexp_replace("_header", "\r$", "")
    names = F.split(F.replace(line, F.lit('"'), F.lit("")), sep)
    column = F.lower("_name") if lower else F.col("_name")
    return _heads(spark, paths).select("file", F.posexplode(names).alias("_pos", "_name")).select(
        "file",
        F.trim(column, F.lit(' "')).alias("column"),
        (F.col("_pos") + (0 if zero_based else 1)).alias("position"),
    )


def header_drift(headers: DataFrame) -> DataFrame:
    """Files per column name, with its lowest and highest position."""
    return headers.groupBy("column").agg(
        F.count_distinct("file").alias("n_files"), F.min("position").alias("min_position"),
        F.max("position").alias("max_position"),
    )


def header_positions(headers: DataFrame, wanted: list[str]) -> DataFrame:
    """Per file the positions of the wanted columns, in the wanted order, null where absent."""
    # A name that a header repeats counts at its last place.
    spots = [F.max(F.when(F.col("column") == name, F.col("position"))) for name in wanted]
    return headers.groupBy("file").agg(F.array(*spots).alias("positions"))
