"""Names, labels and lists of text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normal_name(name: str) -> str:
    """Lower case, blanks and dashes to underscores, outer white space removed."""
    return name.lower().replace(" ", "_").replace("-", "_").strip()


def normal_name_col(name: Column) -> Column:
    """`normal_name` for header names that are data, as in a sheet's header row."""
    return strip(F.translate(F.lower(name), " -", "__"))


def normalise_headers(df: DataFrame) -> DataFrame:
    """Rename every column by `normal_name`; touches the schema only."""
    return df.toDF(*[normal_name(c) for c in df.columns])


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def joined_or_none(items: Column) -> Column:
    """Items joined by '; ', or 'none' for an empty list."""
    return F.coalesce(F.nullif(F.array_join(items, "; "), F.lit("")), F.lit("none"))
