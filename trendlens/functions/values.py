"""Scalar expressions on labels, countries and days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlens.functions import fixed


def sport_flag(label: str = "predicted_label") -> Column:
    """0 for the non-sport label, 1 for everything else, null included."""
    return F.when(F.col(label) == "non_sport", 0).otherwise(1)


def olympic_flag(label: str = "predicted_label") -> Column:
    return F.when(F.col(label) == "olympic", 1).otherwise(0)


def valid_label(c: Column) -> Column:
    return F.when(c.isin(fixed.LABELS), c).otherwise(F.lit(fixed.DEFAULT_LABEL))


def mapped(c: str, table: dict[str, str]) -> Column:
    """Value from a literal table; null where the table has no entry."""
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), F.col(c))


def replaced(c: str, table: dict[str, str]) -> Column:
    """Value from a literal table; other values stay."""
    return F.coalesce(mapped(c, table), F.col(c))


def country_or(c: str, default: str = fixed.NO_COUNTRY, empty_too: bool = False) -> Column:
    text = F.col(c).cast("string")
    if empty_too:
        text = F.nullif(text, F.lit(""))
    return F.coalesce(text, F.lit(default))


def day(df: DataFrame, c: str) -> Column:
    """Calendar day of a time column; a zone in a text is dropped, not applied."""
    kind = df.schema[c].dataType
    if isinstance(kind, T.StringType):
        return F.col(c).cast("timestamp_ntz").cast("date")
    return F.col(c).cast("date")


def share(part: str, whole: str) -> Column:
    return F.col(part).cast("double") / F.col(whole)
