"""One row per key: map-side combined arg-min, never a per-key sort of all copies."""

from __future__ import annotations

from collections.abc import Callable
from itertools import takewhile
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendlens.session import attach_small, settle

WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DateType, T.BooleanType)


def _number(c: str, kind: T.DataType) -> Column:
    return (F.unix_date(c) if isinstance(kind, T.DateType) else F.col(c)).cast("long")


def _ends(df: DataFrame, columns: list[str], strings: list[str]) -> dict[str, tuple] | None:
    """Least and greatest value of each column, found in one pass; of strings the lengths in bytes.

    None without rows, or if a string has a NUL: it could not be told from a shorter one.
    """
    ends = [(F.min(F.octet_length(c)), F.max(F.octet_length(c)), F.max(F.instr(c, "\0"))) if c in strings
            else (F.min(_number(c, df.schema[c].dataType)), F.max(_number(c, df.schema[c].dataType)), F.lit(0)) for c in columns]
    found = df.agg(*[e.alias(f"_{i}_{j}") for i, es in enumerate(ends) for j, e in enumerate(es)]).first()
    low, high, nul = (found[k::3] for k in range(3))
    if all(v is None for v in low) or any(nul):
        return None
    return dict(zip(columns, zip(low, high)))


def packed(df: DataFrame, columns: list[str], codes: tuple[str, ...] = ()) -> tuple[Column, Callable] | None:
    """The columns as one long that sorts like them (nulls first), and what gives them back from a long.

    Whole numbers, days and flags count from their least value; strings are taken if named in ``codes``, by their
    bytes. One pass over these columns finds how many values each can have. None if they do not fit into 63 bits,
    if a column is of another type, or if there are no rows.
    """
    types = {c: df.schema[c].dataType for c in columns}
    strings = [c for c in columns if types[c] == T.StringType() and c in codes]
    if df.isStreaming or not all(c in strings or isinstance(types[c], WHOLE) for c in columns):
        return None
    ends = _ends(df, columns, strings)
    return ends and _in_long(types, columns, strings, ends)


def _sizes(columns: list[str], strings: list[str], ends: dict[str, tuple]) -> list[int]:
    """How many places each column takes, null and one to spare among them."""
    return [2 + (256 ** max(1, ends[c][1] or 0) - 1 if c in strings else (ends[c][1] or 0) - (ends[c][0] or 0)) for c in columns]


def _in_long(types: dict[str, T.DataType], columns: list[str], strings: list[str], ends: dict[str, tuple]) -> tuple[Column, Callable] | None:
    low = [ends[c][0] for c in columns]
    width = {c: max(1, ends[c][1] or 0) for c in columns}
    sizes = _sizes(columns, strings, ends)
    if prod(sizes) >= 1 << 63:
        return None
    whole = F.lit(0).cast("long")
    for c, lo, n in zip(columns, low, sizes):
        if c in strings:
            place = F.conv(F.rpad(F.hex(c), 2 * width[c], "0"), 16, 10).cast("long") + 1
        else:
            place = _number(c, types[c]) - F.lit(lo or 0) + 1
        whole = whole * F.lit(n) + F.coalesce(place, F.lit(0).cast("long"))

    def unpacked(value: Column) -> list[Column]:
        out = []
        for i, (c, lo, n) in enumerate(zip(columns, low, sizes)):
            place = F.call_function("div", value, F.lit(prod(sizes[i + 1:]))) % F.lit(n) - 1
            if c in strings:
                text = F.rtrim(F.decode(F.unhex(F.lpad(F.hex(place), 2 * width[c], "0")), "UTF-8"), F.lit("\0"))
            elif isinstance(types[c], T.DateType):
                text = F.date_from_unix_date((place + F.lit(lo or 0)).cast("int"))
            else:
                text = (place + F.lit(lo or 0)).cast(types[c])
            out.append(F.when(place >= 0, text).alias(c))
        return out

    return whole, unpacked


def keep_first(
    df: DataFrame, key: list[str], order: list[str], drop_null_keys: bool = False, keep: list[str] | None = None,
    codes: tuple[str, ...] = (),
) -> DataFrame:
    """The row that comes first in ``order`` for each key, all columns or those in ``keep``.

    Copies of one key are folded in the map tasks, so a key that holds a third
    of the rows sends one row per task. Where ``order`` and the columns fit into one long (``packed``), its minimum is a
    hash aggregate; otherwise the rows of each task are sorted by key.
    """
    rows = df.dropna(subset=key) if drop_null_keys else df
    columns = keep or df.columns
    rest = [c for c in columns if c not in key]
    names = list(dict.fromkeys([*order, *rest]))
    if found := packed(rows, names, codes):
        whole, unpacked = found
        least = rows.groupBy(*key).agg(F.min(whole).alias("_packed"))
        back = [c for c, name in zip(unpacked(F.col("_packed")), names) if name in rest]
        return least.select(*key, *back).select(columns)
    return _by_sorting(rows, key, order, columns)


def first_by_prefix(df: DataFrame, key: list[str], order: list[str], keep: list[str]) -> DataFrame | None:
    """``keep_first`` where only the first columns of ``order`` fit into a long, and kept columns are whole numbers, days or flags.

    Two minima per key, as a hash aggregate, of the longest such part of the order: one with the kept columns behind it, one with
    these counted backwards. They are the least and the greatest kept columns of the rows that come first by that part.
    Where both are the same, the rest of the order decides nothing; only for other keys ``df`` is read again and ordered by all of it.
    The columns that may take part are settled. None if that cannot be done. Keys must not be null.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    rest = [c for c in keep if c not in key]
    able = list(takewhile(lambda c: isinstance(types[c], WHOLE), order))
    if df.isStreaming or not able or not all(isinstance(types[c], WHOLE) for c in rest):
        return None
    numbers = list(dict.fromkeys([*able, *rest]))
    rows = settle(df.select(*dict.fromkeys([*key, *numbers])))
    if not (ends := _ends(rows, numbers, [])):
        return None
    for n in range(len(able), 0, -1):
        after = [c for c in rest if c not in able[:n]]
        if found := _in_long(types, names := list(dict.fromkeys([*able[:n], *after])), [], ends):
            break
    else:
        return None
    whole, unpacked = found
    choices = F.lit(prod(_sizes(after, [], ends))).cast("long")

    def backwards(value: Column) -> Column:
        return value - value % choices + (choices - 1 - value % choices)

    least = rows.groupBy(*key).agg(F.min(whole).alias("_packed"), F.min(backwards(whole)).alias("_backwards"))
    sure = F.col("_backwards") == backwards(F.col("_packed"))
    back = [c for c, name in zip(unpacked(F.col("_packed")), names) if name in rest]
    if n == len(order):
        return least.select(*key, *back).select(keep)
    least = settle(least)
    first, tied = least.filter(sure).select(*key, *back).select(keep), least.filter(~sure).select(*key)
    if tied.isEmpty():
        return first
    return first.unionByName(_by_sorting(attach_small(df, tied, key, "left_semi"), key, order, keep))


def _by_sorting(rows: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    first = F.min_by(F.struct(*[c for c in columns if c not in key]), F.struct(*order)).alias("_row")
    return rows.groupBy(*key).agg(first).select(*key, "_row.*").select(columns)


def first_appearance(
    df: DataFrame,
    order: list[str],
    day: str = "date_clean",
    key: tuple[str, str] = ("video_id", "country_code"),
    keep: list[str] | None = None,
    narrow: bool = False,
) -> DataFrame:
    """Earliest day per (video, country); equal days are decided by ``order``.

    ``narrow`` tries ``first_by_prefix``, which settles the rows and does not sort them.
    """
    dated = df.filter(F.col(day).isNotNull())
    if narrow and (first := first_by_prefix(dated.dropna(subset=list(key)), list(key), [day, *order], keep or df.columns)) is not None:
        return first
    return keep_first(dated, list(key), [day, *order], True, keep)
