"""Comparing JSON objects by content.

Two texts agree if their parsed values do: the order of properties and the way of writing do not matter, numbers are
compared by value, an absent property is the same as null or an empty string (at every level), the order within a list
matters. What the native parser is sure of is compared natively (``compared``); Python's parser, in Arrow batches, decides
on the rest: invalid texts, objects within objects, repeated names, numbers of many digits.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

INVALID = "invalid"


def _no_constant(name: str) -> None:
    raise ValueError(name)


_decode = json.JSONDecoder(parse_constant=_no_constant).decode


def _canon(v: object) -> object:
    if v is None or v == "":
        return None
    if isinstance(v, dict):
        return {k: c for k in sorted(v) if (c := _canon(v[k])) is not None}
    if isinstance(v, list):
        return [_canon(x) for x in v]
    if isinstance(v, float) and v.is_integer():
        return int(v)
    return v


def properties(text: str | None) -> dict[str, str] | None:
    """Canonical text of each property that has a value; None if ``text`` is not valid JSON. Another JSON value than an object counts as invalid but for null."""
    if text is None or not text.strip():
        return {}
    try:
        v = _decode(text)
    except (ValueError, RecursionError):
        return None
    if v is None:
        return {}
    if not isinstance(v, dict):
        return None
    return {k: json.dumps(c, ensure_ascii=True) for k, c in _canon(v).items()}


@F.pandas_udf(StringType())
def canonical_properties(text: pd.Series) -> pd.Series:
    """One text per content. Invalid JSON stands for itself, behind a mark that no valid text has."""

    def one(t: str | None) -> str:
        p = properties(t)
        return INVALID + (t or "") if p is None else json.dumps(p, sort_keys=True)

    return text.map(one, na_action=None)


@F.pandas_udf(ArrayType(StringType()))
def differing_properties(a: pd.Series, b: pd.Series) -> pd.Series:
    """Names of the fields that differ: 'properties_json.NAME' each, or 'properties_json' if either text is invalid."""

    def one(x: str | None, y: str | None) -> list[str]:
        if x == y:
            return []
        p, q = properties(x), properties(y)
        if p is None or q is None:
            return ["properties_json"]
        return [f"properties_json.{k}" for k in sorted(p.keys() | q.keys()) if p.get(k) != q.get(k)]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


# native comparison


def _surely_valid(text: Column, parsed: Column) -> Column:
    """Whether the text is one JSON object without another inside. The native parser stops after the first value, so the rest
    of the text is looked at without its strings; half surrogates are written in two ways and left out."""
    bare = F.regexp_replace(text, r'"(?:[^"\\\\]|\\\\.)*"', "")
    return parsed.isNotNull() & bare.rlike(r"^[ \t\r\n]*\{[^{}]*\}[ \t\r\n]*$") & ~text.rlike(r"(?i)\\ud[89a-f]")


def _value(j: Column) -> Column:
    """A value's text: null where it counts as absent, numbers by value."""
    return F.when(j.isin("null", '""'), None).when(j.rlike("^[-0-9]"), F.concat(F.lit("n"), j.cast("double").cast("string"))).otherwise(j)


def _doubtful(x: Column, y: Column) -> Column:
    """Values whose native texts do not settle whether they are the same: long or infinite numbers, lists with numbers, nulls or empty strings."""
    odd = lambda v: (v.rlike("^[-0-9]") & (F.length(v) > 16)) | v.isin('"Infinity"', '"-Infinity"')
    lists = x.startswith("[") & y.startswith("[") & (x != y) & F.concat(x, y).rlike('[0-9]|null|""')
    return F.coalesce(odd(x), F.lit(False)) | F.coalesce(odd(y), F.lit(False)) | F.coalesce(lists, F.lit(False))


def compared(rows: DataFrame, a: Column, b: Column, name: str, field: str = "properties_json") -> DataFrame:
    """``rows`` with ``name``: the names of the properties that differ between the texts ``a`` and ``b``, as ``field.NAME`` each, or
    ``field`` if a text is invalid; sorted. Equal texts have none."""
    told = ~a.eqNullSafe(b)
    own = rows.columns
    empty = F.create_map().cast("map<string,string>")
    text = _once(rows, own, a=F.when(told, a), b=F.when(told, b))
    read = _once(text, own, a="_h.a", b="_h.b", va=F.try_parse_json("_h.a"), vb=F.try_parse_json("_h.b"))
    as_map = lambda c: F.when(F.coalesce(F.trim(f"_h.{c}"), F.lit("")) == "", empty).when(_surely_valid(F.col(f"_h.{c}"), F.col(f"_h.v{c}")), F.transform_values(F.expr(f"try_cast(_h.v{c} AS map<string,variant>)"), lambda k, v: F.to_json(v)))
    maps = _once(read, own, a="_h.a", b="_h.b", ma=as_map("a"), mb=as_map("b"))
    at = lambda m, k: F.try_element_at(F.col(f"_h.{m}"), k)
    keys = F.array_distinct(F.concat(F.map_keys("_h.ma"), F.map_keys("_h.mb")))
    both = F.transform(keys, lambda k: F.struct(k.alias("k"), at("ma", k).alias("x"), at("mb", k).alias("y")))
    pairs = _once(maps, own, a="_h.a", b="_h.b", pairs=F.filter(both, lambda p: ~p["x"].eqNullSafe(p["y"])))
    told = F.col("_h.a").isNotNull() | F.col("_h.b").isNotNull()
    unsure = told & (F.col("_h.pairs").isNull() | F.exists("_h.pairs", lambda p: _doubtful(p["x"], p["y"])))
    native = F.transform(F.array_sort(F.transform(F.filter("_h.pairs", lambda p: ~_value(p["x"]).eqNullSafe(_value(p["y"]))), lambda p: p["k"])), lambda k: F.concat(F.lit(f"{field}."), k))
    ready = _once(pairs, own, told=told, native=native, a=F.when(unsure, F.col("_h.a")), b=F.when(unsure, F.col("_h.b")), unsure=unsure)
    decided = differing_properties(F.col("_h.a"), F.col("_h.b"))
    rest = F.transform(decided, lambda x: F.concat(F.lit(field), F.substring(x, len("properties_json") + 1, 1 << 30)))
    return ready.select(*own, F.when(F.col("_h.unsure"), rest).when(F.col("_h.told"), F.col("_h.native")).otherwise(F.array().cast("array<string>")).alias(name))


def _once(rows: DataFrame, own: list[str], **cols: Column | str) -> DataFrame:
    """``rows`` with a struct ``_h`` of ``cols``. Exploding keeps later expressions from taking these in and working them out per use."""
    held = F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in cols.items()])
    return rows.select(*own, F.explode(F.array(held)).alias("_h"))
