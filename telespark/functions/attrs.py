"""Attribute columns: VARIANT or MAP<STRING,STRING> with dotted keys."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_KEY = 256
DEPTH = 32


def check_key(key: str) -> str:
    key = key.strip()
    if not key or len(key) > MAX_KEY or re.search(r"[`'\\\x00-\x1f\x7f]", key):
        raise ValueError(f"not a usable attribute name: {key!r}")
    return key


def _path(*parts: str) -> str:
    return "$" + "".join(f"['{part}']" for part in parts)


def value_in(container: Column, dtype: T.DataType, key: str) -> Column:
    """Text of one attribute; a missing one equals the empty string."""
    key = check_key(key)
    if isinstance(dtype, T.MapType):
        return F.coalesce(container[key].cast("string"), F.lit(""))
    if isinstance(dtype, T.VariantType):
        # exporters write flat dotted names; nested objects are the other way to hold them
        ways = [_path(key), _path(*key.split("."))] if "." in key else [_path(key)]
        return F.coalesce(*[F.try_variant_get(container, way, "string") for way in ways], F.lit(""))
    raise TypeError(f"attributes must be VARIANT or MAP, not {dtype.simpleString()}")


def attr(df: DataFrame, column: str, key: str) -> Column:
    return value_in(F.col(column), df.schema[column].dataType, key)


def first_attr(df: DataFrame, column: str, keys) -> Column:
    """First non-empty of several spellings of one attribute."""
    return F.coalesce(*[F.nullif(attr(df, column, k), F.lit("")) for k in keys], F.lit(""))


def attr_names(df: DataFrame, column: str) -> Column:
    """Array of the (dotted) names present on a row."""
    return F.map_keys(F.map_filter(flatten_attributes(df, column), lambda _, v: v.cast("string") != ""))


def flatten_attributes(df: DataFrame, column: str, depth: int = DEPTH) -> Column:
    """Attributes as one map with dotted names.

    A VARIANT is opened by the type of its values, never by the look of a text: objects
    level by level (``depth`` of them; what lies deeper stays JSON text), arrays and empty objects
    stay JSON text, nulls go.  Where a flat dotted name and a nested one are equal, the one nested
    less wins."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.MapType):
        return c.cast("map<string,string>")
    objects = "map<string,variant>"

    def entry(key: Column, value: Column, level: Column) -> Column:
        return F.struct(key.alias("key"), value.alias("value"), level.cast("int").alias("level"))

    def opened(e: Column, level: Column) -> Column:
        inner = F.map_entries(e["value"].try_cast(objects))
        return F.when(F.size(inner) > 0, F.transform(inner, lambda s: entry(F.concat(e["key"], F.lit("."), s["key"]), s["value"], level))) \
            .otherwise(F.array(e))

    def once(value: Column, use) -> Column:
        """``use(value)`` with the value computed once."""
        return F.get(F.transform(F.array(value), use), F.lit(0))

    top = F.transform(F.map_entries(c.try_cast(objects)), lambda e: entry(e["key"], e["value"], F.lit(0)))
    levels = F.sequence(F.lit(1), F.lit(depth - 1))
    all_open = F.aggregate(levels, top, lambda entries, level: F.flatten(F.transform(entries, lambda e: opened(e, level))))
    present = F.array_sort(F.filter(all_open, lambda e: e["value"].isNotNull() & ~F.is_variant_null(e["value"])),
                           lambda a, b: F.when(a["level"] < b["level"], -1).when(a["level"] > b["level"], 1).otherwise(0))
    text = lambda v: F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))
    one_each = once(present, lambda entries: once(F.transform(entries, lambda e: e["key"]), lambda names: F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1)))
    return F.map_from_entries(F.transform(one_each, lambda e: F.struct(e["key"].alias("key"), text(e["value"]).alias("value"))))


@dataclass(frozen=True)
class AttrFilter:
    """``key=value`` (equal as text) or ``key`` (present and non-empty)."""

    key: str
    value: str | None = None

    @classmethod
    def parse(cls, text: str) -> "AttrFilter":
        key, eq, value = text.partition("=")
        return cls(check_key(key), value if eq else None)

    def holds(self, df: DataFrame, column: str) -> Column:
        got = attr(df, column, self.key)
        return got != "" if self.value is None else got == self.value
