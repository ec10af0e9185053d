"""Small expression helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a name inside ``body`` so that it is evaluated once per row
    however often the body (or a lambda in it) uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sql_literal(value) -> str:
    """SQL text of a string, bool, list or dict (a struct) literal."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, dict):
        return "named_struct(" + ", ".join(f"'{k}', {sql_literal(v)}" for k, v in value.items()) + ")"
    if isinstance(value, list):
        return "array(" + ", ".join(map(sql_literal, value)) + ")"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_array(values) -> Column:
    """Literal array<string>, also for an empty list."""
    return F.expr(sql_literal(list(values))).cast("array<string>")


def key128(*parts: Column) -> Column:
    """16-byte grouping key over the exact parts: keeps shuffled keys short."""
    return F.substring(F.unhex(F.sha2(F.concat_ws("\u001f", *parts), 256)), 1, 16)


def with_once(df: DataFrame, *columns: Column) -> DataFrame:
    """Add ``columns`` (aliased), evaluated exactly once per row. A plain projection would
    be copied into every filter and projection above it; the output of a generator is not."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))
