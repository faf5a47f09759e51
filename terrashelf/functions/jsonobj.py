"""Row-local work on JSON objects kept as text: nothing here shuffles."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrashelf.session import ship

OBJECT = "map<string,variant>"


def members(text: Column) -> Column:
    """An object's members as a map; null for anything else. Of repeated names the last one counts."""
    parsed = F.from_json(text, OBJECT)
    pairs = F.map_entries(parsed)
    last = F.filter(
        pairs,
        lambda pair, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == pair["key"]),
    )
    repeated = F.size(F.array_distinct(F.map_keys(parsed))) < F.size(parsed)
    return F.when(repeated, F.map_from_entries(last)).otherwise(parsed)


def merged(left: Column, right: Column) -> Column:
    """Members of both maps; the right side wins where a name occurs twice."""
    only_left = F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k))
    return F.map_concat(only_left, right)


def without(text: Column, names: list[str]) -> Column:
    """The object less some members."""
    return F.to_json(F.map_filter(members(text), lambda k, _: ~k.isin(names)))


def picked(text: Column, name: str, rename: str | None = None) -> Column:
    """One member as an object of its own; the member is null where the name is absent, never left out."""
    value = F.element_at(members(text), F.lit(name))
    shown = F.coalesce(F.to_json(value), F.lit("null"))
    return F.concat(F.lit("{" + json.dumps(rename or name) + ":"), shown, F.lit("}"))


def values_in_order(text: Column, names: list[str]) -> Column:
    """The values of ``names`` as JSON texts, in the wanted order, null where absent."""
    parsed = members(text)
    return F.array(*[F.to_json(F.element_at(parsed, F.lit(n))) for n in names])


def array_texts(text: Column) -> Column:
    """A JSON array as texts; null stays null and empty stays empty."""
    return F.from_json(text, "array<string>")


class _Number(str):
    """A number as it is written, so that no digit changes."""


def _shown(value) -> str:
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_shown(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_shown, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


def _parsed(text: str):
    return json.loads(text, parse_float=_Number, parse_int=_Number, parse_constant=_Number)


def _stripped(value, path: str, dropped: list[str]):
    """``value`` without null members; their names with the names around them go to ``dropped``."""
    if isinstance(value, dict):
        dropped += [path + k for k, v in value.items() if v is None]
        return {k: _stripped(v, f"{path}{k}.", dropped) for k, v in value.items() if v is not None}
    if isinstance(value, list):
        return [_stripped(v, path, dropped) for v in value]
    return value


@F.pandas_udf(T.StringType())
def _strip_nested(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: None if text is None else _shown(_stripped(_parsed(text), "", [])))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _drops_nested(texts: pd.Series) -> pd.Series:
    def one(text):
        dropped: list[str] = []
        _stripped(_parsed(text), "", dropped)
        return dropped

    return texts.map(lambda text: None if text is None else one(text))


def _nested_with_null(text: Column) -> Column:
    """``text`` where it holds an object or array below its top and a null, and is JSON; else null."""
    ship()
    nested = F.substring(F.trim(text), 2, 2147483647).rlike(r"[{\[]")
    return F.when(text.rlike(r"[:\s]null") & nested & F.try_parse_json(text).isNotNull(), text)


def dropped_names(text: Column) -> Column:
    """Names of the null members at every depth, those below the top with the names around them (``a.b``)."""
    deep = _nested_with_null(text)
    flat = F.map_keys(F.map_filter(members(text), lambda _, v: F.is_variant_null(v)))
    return F.when(deep.isNotNull(), _drops_nested(deep)).otherwise(flat)


def strip_nulls(text: Column, keep_empty: bool = True) -> Column:
    """The object less members that are null, at every depth; null array items stay.

    Texts without a null pass through, flat objects are filtered in the JVM, and only nested ones
    that contain a null reach the Arrow helper.
    """
    parsed = members(text)
    deep = _nested_with_null(text)
    flat = F.to_json(F.map_filter(parsed, lambda _, v: ~F.is_variant_null(v)))
    out = (
        F.when(deep.isNotNull(), _strip_nested(deep)).when(parsed.isNotNull(), flat)
        .otherwise(F.to_json(F.try_parse_json(text)))
    )
    return out if keep_empty else F.when(out != "{}", out)
