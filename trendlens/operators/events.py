"""Event calendars: spans, cumulative week windows, event time, disjoint bins.

Event bounds enter a plan as scalar subqueries, so nothing is collected and
no join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlens.functions import fixed


def span(days: DataFrame, col: str = "date_clean") -> Column:
    """struct(first, last) day of a table, as a scalar subquery."""
    return days.agg(F.struct(F.min(col).alias("first"), F.max(col).alias("last"))).scalar()


def with_event_windows(
    panel: DataFrame, event: Column, prefix: str, weeks_before: int = 1, weeks_after: int = 3
) -> DataFrame:
    """0/1 columns before, during and after an event.

    Bounds: ``start-7w ≤ d < start``, ``start ≤ d ≤ end``, ``end < d ≤ end+7w``.
    Windows are cumulative: the second week after contains the first.
    """
    held = panel.withColumn("_event", event)
    first, last, d = F.col("_event.first"), F.col("_event.last"), F.col("date_clean")
    flags = {}
    for w in range(1, weeks_before + 1):
        flags[f"{prefix}_week_minus_{w}"] = (d >= F.date_add(first, -7 * w)) & (d < first)
    flags[f"{prefix}_during"] = d.between(first, last)
    for w in range(1, weeks_after + 1):
        flags[f"{prefix}_week_plus_{w}"] = (d > last) & (d <= F.date_add(last, 7 * w))
    ints = {name: F.coalesce(flag, F.lit(False)).cast("int") for name, flag in flags.items()}
    return held.withColumns(ints).drop("_event")


def with_event_time(panel: DataFrame, event: Column, name: str) -> DataFrame:
    """Days since the event's first day, negative before it."""
    return panel.withColumn(f"event_time_{name}", F.date_diff("date_clean", event["first"]))


def _around(panel: DataFrame, event: Column, time: str) -> DataFrame:
    length = F.date_diff(F.col("_event.last"), F.col("_event.first"))
    return (
        panel.withColumn("_event", event)
        .withColumn("_length", length)
        .filter(F.col(time).between(F.lit(-7), F.col("_length") + 21))
    )


def event_line(panel: DataFrame, event: Column, time: str, value: str = "sports_pct") -> DataFrame:
    """Mean share across countries for each day around the event (a mean of shares)."""
    return _around(panel, event, time).groupBy(time).agg(F.avg(value).alias(value))


def event_bars(panel: DataFrame, event: Column, time: str, value: str = "sports_pct") -> DataFrame:
    """Mean share per disjoint bin, with the bin's centre and width in days."""
    near = _around(panel, event, time)

    def edge(anchor: str, offset: int) -> Column:
        return F.lit(offset) if anchor == "start" else F.col("_length") + offset

    arm = None
    for label, lo_from, lo, hi_from, hi in fixed.EVENT_BINS:
        low, high = edge(lo_from, lo), edge(hi_from, hi)
        entry = F.struct(F.lit(label).alias("window"), low.alias("lo"), high.alias("hi"))
        inside = F.col(time).between(low, high)
        arm = F.when(inside, entry) if arm is None else arm.when(inside, entry)
    return (
        near.withColumn("_bin", arm)
        .groupBy(F.col("_bin.window").alias("window"), F.col("_bin.lo").alias("lo"), F.col("_bin.hi").alias("hi"))
        .agg(F.avg(value).alias(value))
        .select("window", ((F.col("lo") + F.col("hi")) / 2).alias("centre"),
                (F.col("hi") - F.col("lo") + 1).alias("width"), value)
    )
