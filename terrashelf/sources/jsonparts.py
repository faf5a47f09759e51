"""Large JSON files cut into the parts of their top two levels, by many tasks.

A file is read up to each ``}``, at which any line reader can split it. Per block a structural index is computed with byte masks:
which quotes are escaped, which signs stand inside strings, how deep the brackets are. Parts lie between the commas and
brackets of the top two levels: a member's name, its scalar, an element of its array or a member of its object. Nothing
deeper is decoded here; the JVM parses the texts of parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrashelf.functions import jsonobj
from terrashelf.session import cut, hinted
from terrashelf.sources import blocks

_OPEN, _CLOSE = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_OPEN[list(b"{[")], _CLOSE[list(b"}]")] = True, True
_QUOTE, _ESCAPE, _COMMA = b'"\\,'
NOT_AN_OBJECT = "not a JSON object"


def _escaped(signs: np.ndarray) -> np.ndarray:
    """Which bytes follow an odd run of backslashes; no span begins within one."""
    found = np.zeros(len(signs), dtype=bool)
    slashes = np.flatnonzero(signs == _ESCAPE)
    if len(slashes):
        first = np.append(True, np.diff(slashes) != 1)
        run = np.maximum.accumulate(np.where(first, np.arange(len(slashes)), 0))
        odd = slashes[(np.arange(len(slashes)) - run) % 2 == 0] + 1
        found[odd[odd < len(signs)]] = True
    return found


def _structure(signs: np.ndarray, inside: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Per byte whether it is outside of strings and how it changes the depth; and whether a string is open at the end."""
    quotes = (signs == _QUOTE) & ~_escaped(signs)
    within = (np.cumsum(quotes) + inside) & 1
    outside = within == 0
    steps = (_OPEN[signs] & outside).astype(np.int64) - (_CLOSE[signs] & outside)
    return outside, steps, int(within[-1]) if len(signs) else inside


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block does, but for the ``}`` after its last line: to an open string and to the depth, from outside of a string and inside."""
    rows, state = [], None
    for name, texts in blocks.spans(batches, ["file", "block", "size"]):
        ends, depths, total = state or ((0, 1), (0, 0), -1)
        if texts is None:
            rows.append((*name, ends[0], *depths, total))
            state = None
            continue
        data = b"}" * (state is not None) + b"}".join(texts)
        signs = np.frombuffer(data, dtype=np.uint8)
        found = [_structure(signs, inside) for inside in ends]
        depths = tuple(d + int(steps.sum()) for d, (_, steps, _) in zip(depths, found))
        state = tuple(end for *_, end in found), depths, total + len(data) + (state is None)
    if rows:
        kinds = [pa.string()] + [pa.int64()] * 6
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file", "block", "size", "flips", "depth0", "depth1", "bytes"])


def _states(read: DataFrame) -> DataFrame:
    """How each block begins (``inside`` a string, ``depth``), whether a ``}`` follows its last line, and whether its file is ``whole``."""
    index = cut(read.select("file", "block", "size", "text").mapInArrow(
        _index, "file string, block long, size long, flips long, depth0 long, depth1 long, bytes long"))
    state = index.withColumn("inside", blocks.before(F.col("flips")) % 2).withColumn("last", blocks.is_last())
    state = state.withColumn("outside", (F.col("inside") + F.col("flips")) % 2 == 0).withColumn(
        "deeper", F.when(F.col("inside") == 0, F.col("depth0")).otherwise(F.col("depth1")))
    state = state.withColumn("depth", blocks.before(F.col("deeper") - F.col("outside").cast("long")))
    file = Window.partitionBy("file")
    at_end = lambda value: F.max(F.when(F.col("last"), value)).over(file)
    # The bytes tell whether the last line ends in a }; a byte order mark is not read. In a compressed file its depth does.
    beyond = F.sum(F.col("bytes") + 1).over(file) - F.col("size")
    end = F.col("depth") + F.col("deeper")
    closed = F.when(beyond.isin(0, -3), F.lit(True)).when(beyond.isin(1, -2), F.lit(False)).otherwise(at_end(end) == 1)
    state = state.withColumn("closed", ~F.col("last") | closed)
    good = at_end(F.col("outside") & (end == F.col("closed").cast("long")))
    return cut(state.withColumn("whole", good).select("file", "block", "inside", "depth", "closed", "whole"))


_FRAGMENT = {
    "file": pa.string(), "block": pa.int64(), "seq": pa.int64(), "begins": pa.bool_(), "ends": pa.bool_(), "text": pa.string(),
    "level": pa.int32(), "first_before": pa.string(), "after": pa.string(), "of_seq": pa.int64(),
}
_FRAGMENT_DDL = (
    "file string, block long, seq long, begins boolean, ends boolean, text string, level int, first_before string, after string, "
    "of_seq long")


def _cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks to fragments of parts, each with its level, the signs around it and the last part of level 1."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array(c, k) for c, k in zip(zip(*rows), _FRAGMENT.values())]
        return pa.RecordBatch.from_arrays(arrays, names=list(_FRAGMENT))

    decoded = lambda pieces: b"".join(pieces).decode("utf-8", "replace")
    rows, started = [], False
    for (file, block, inside, depth, closed), texts in blocks.spans(batches, ["file", "block", "inside", "depth", "closed"]):
        if not started:
            open_, deep = inside, depth
            fresh = block == 0
            kept, seq, begins, sign, of = [], int(fresh), fresh, None, 1 if fresh else None
        if texts is None:
            data = b"}" if closed else b""
        else:
            data = b"}" * started + b"}".join(texts)
        signs = np.frombuffer(data, dtype=np.uint8)
        outside, steps, open_ = _structure(signs, open_)
        after = deep + np.cumsum(steps)
        lower = np.minimum(after, after - steps)
        cuts = np.flatnonzero(outside & (((signs == _COMMA) & (after <= 2)) | ((steps != 0) & (lower <= 1))))
        at = 0
        for place, here, step in zip(cuts.tolist(), after[cuts].tolist(), steps[cuts].tolist()):
            kept.append(data[at:place])
            rows.append((file, block, seq, begins, True, decoded(kept), here - step, sign, chr(data[place]), of))
            at, kept, seq, begins, sign = place + 1, [], seq + 1, True, chr(data[place])
            of = seq if here <= 1 else of
            if len(rows) >= 1000:
                yield batch(rows)
                rows = []
        kept.append(data[at:])
        deep = int(after[-1]) if len(after) else deep
        started = texts is not None
        if not started:
            rows.append((file, block, seq, begins, False, decoded(kept), min(deep, 2), sign, None, of))
    if rows:
        yield batch(rows)


def parts(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """The parts of all files, and the files with whether their brackets and quotes close (``whole``).

    A part has file, place (from 1), level (brackets around it, at most 2), the signs ``before`` and ``after`` it, text, and ``of``:
    the place of the last part of level 1 up to it, which for a part of level 2 names its member.
    """
    read = blocks.lines(spark, paths, "}")
    states = _states(read)
    fragments = blocks.with_state(read, states).select("file", "block", "inside", "depth", "closed", "text").mapInArrow(
        _cut_up, _FRAGMENT_DDL)
    files = states.groupBy("file").agg(F.first("whole").alias("whole"))
    return cut(blocks.whole(fragments)), files


def _name(text: Column) -> Column:
    """The member's name in the text before its value."""
    return F.map_keys(F.from_json(F.concat(F.lit("{"), text, F.lit("null}")), "map<string,string>"))[0]


def lists(parts: DataFrame, name: str | None = None) -> DataFrame:
    """The arrays among the top members: file, of (the place of the part that names it) and name; only those of one ``name``."""
    found = parts.where("level = 1 AND after = '['").select("file", F.col("place").alias("of"), _name(F.col("text")).alias("name"))
    return found.where(F.col("name").isNotNull() if name is None else F.col("name") == name)


def top_texts(parts: DataFrame, files: DataFrame, emptied: DataFrame) -> DataFrame:
    """file and top: a file's text without the elements of the arrays ``emptied(file, of)``; null if it is no whole object.

    Only files that begin with a bracket of an object and close are put together.
    """
    opened = parts.where("place = 1 AND after = '{'").select("file")
    known = hinted(cut(files.where("whole").join(opened, "file").select("file")))
    skipped = hinted(cut(emptied.select("file", "of").withColumn("empty", F.lit(True))))
    kept = parts.join(known, "file").join(skipped, ["file", "of"], "left").where("empty IS NULL OR level < 2")
    text = F.concat(F.coalesce("before", F.lit("")), "text", F.when(F.col("empty") & (F.col("level") == 1), "[").otherwise(""))
    # Around the object stands nothing but blanks: a part before it and one after.
    around = F.when(F.col("level") < 1, (F.translate("text", " \t\r\n\ufeff", "") == "").cast("int"))
    tops = kept.groupBy("file").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", text.alias("t")))), lambda p: p["t"]), "").alias("top"),
        F.count(around).alias("outer"), F.sum(around).alias("blank"))
    whole = tops.where(jsonobj.members(F.col("top")).isNotNull() & (F.col("outer") == 2) & (F.col("blank") == 2)).select("file", "top")
    return files.select("file").join(whole, "file", "left")


def elements(parts: DataFrame, of: DataFrame) -> DataFrame:
    """The elements of the arrays ``of(file, of, ...)``, which is small: their columns, position (from 1) and text."""
    found = parts.where("level = 2").join(of, ["file", "of"])
    position = (F.col("place") - F.col("of")).cast("int")
    none = (position == 1) & (F.col("after") == "]") & (F.trim(F.translate("text", "\t\r\n", "   ")) == "")
    return found.where(~none).select(*of.columns, position.alias("position"), "text")


def json_values(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Large JSON objects as rows (file, name, position, value, error): one a member, or one an element of a member that is an array.

    Values are variants, so only a single member or element has to fit into one. A file that is no object keeps a row with
    an ``error``, and so does a value that is none. Of repeated names the last one counts.
    """
    found, files = parts(spark, paths)
    arrays = cut(lists(found))
    tops = cut(top_texts(found, files, arrays))
    kept = arrays.join(tops.where("top IS NOT NULL"), "file").groupBy("file", "name").agg(F.max("of").alias("of"))
    members = tops.select("file", F.explode(jsonobj.members(F.col("top"))).alias("name", "value"))
    is_list = F.schema_of_variant("value").startswith("ARRAY")
    kept = cut(members.where(is_list).select("file", "name").join(kept, ["file", "name"]))
    value = F.try_parse_json("text")
    rows = elements(found, hinted(kept)).select(
        "file", "name", "position", value.alias("value"), F.when(value.isNull(), "not JSON").alias("error"))
    single = members.where(~is_list).select(
        "file", "name", F.lit(None).cast("int").alias("position"), "value", F.lit(None).cast("string").alias("error"))
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    broken = tops.where("top IS NULL").select(
        "file", null("string", "name"), null("int", "position"), F.try_parse_json(F.lit(None).cast("string")).alias("value"),
        F.lit(NOT_AN_OBJECT).alias("error"))
    return rows.unionByName(single).unionByName(broken)
