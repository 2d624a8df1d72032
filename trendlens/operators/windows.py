"""Row lags and rolling sums along each country's days.

A series may be longer than one task should sort. All rows are placed in one distributed order and cut in blocks of
``size`` places; the last rows of each block, as many as a window looks back, are also dealt to the next one. So
a window never needs more than its own block, and a long series is as many tasks as it has blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trendlens.operators.ranking import with_position

BLOCK = 1_000_000


def _in_blocks(panel: DataFrame, back: int, columns, size: int) -> DataFrame:
    """Add ``columns``, a function of the window, whose windows look back at most ``back`` rows of the same country."""
    if size < back:
        raise ValueError("blocks are shorter than the windows")
    placed = with_position(panel, ["country_code", "date_clean"], "_place")
    block = F.floor(F.col("_place") / size)
    also = F.when(F.col("_place") % size >= size - back, block + 1)  # the halo of the next block
    dealt = placed.withColumn("_block", F.explode(F.array_compact(F.array(block, also))))
    window = W.partitionBy("country_code", "_block").orderBy("_place")
    return dealt.withColumns(columns(window)).filter(F.col("_block") == block).select(*panel.columns, *columns(window))


def with_lags(panel: DataFrame, col: str = "medal_count", lags: int = 7, size: int = BLOCK) -> DataFrame:
    """``{col}_lag1`` … : the value some rows back, 0 before the first row."""
    def columns(w) -> dict[str, Column]:
        return {f"{col}_lag{n}": F.coalesce(F.lag(col, n).over(w), F.lit(0)) for n in range(1, lags + 1)}

    return _in_blocks(panel, lags, columns, size)


def with_rolling_sums(
    panel: DataFrame, col: str = "medal_count", widths: range = range(1, 22), prefix: str = "rolling_medals", size: int = BLOCK
) -> DataFrame:
    """``{prefix}_{t}``: sum over the last ``t`` rows, this one included."""
    def columns(w) -> dict[str, Column]:
        return {f"{prefix}_{t}": F.sum(col).over(w.rowsBetween(1 - t, 0)) for t in widths}

    return _in_blocks(panel, max(widths) - 1, columns, size)
