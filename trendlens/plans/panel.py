"""From labelled records to the country × day panel with events and medals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trendlens.functions import fixed
from trendlens.functions.values import day, mapped
from trendlens.operators.dedupe import first_appearance
from trendlens.operators.events import span, with_event_time, with_event_windows
from trendlens.operators.ranking import drop_first
from trendlens.operators.rollup import country_day_panel, daily_medals, label_flags, panel_of_flags, with_medals, with_shares
from trendlens.session import settle
from trendlens.sources.records import union_all

DAY_COLUMN = {"published": "publishedAt", "trending": "trending_date"}


def trimmed_published(panel: DataFrame, days: int = 14) -> DataFrame:
    """Days strictly later than the overall first day plus ``days``.

    The trim looks at days only, so it is made on the panel, after the rollup.
    """
    earliest = panel.agg(F.min("date_clean")).scalar()
    return panel.filter(F.col("date_clean") > F.date_add(earliest, days))


def trimmed_first_days(panel: DataFrame, n: int = 10) -> DataFrame:
    """Each country without its first ``n`` calendar days."""
    start = F.min("date_clean").over(W.partitionBy("country_code"))
    dated = panel.withColumn("_start", start)
    return dated.filter(F.col("date_clean") >= F.date_add("_start", n)).drop("_start")


def trimmed_first_rows(first: DataFrame, n: int = 10) -> DataFrame:
    """Each country without its first ``n`` videos by id. ``first`` is read twice, so settle it."""
    return drop_first(first, ["country_code"], ["video_id"], n)


def create_panel(
    records: DataFrame,
    order: list[str],
    duplicates: bool = False,
    date_type: str = "published",
    trim_by: str = "rows",
    label: str = "predicted_label",
) -> DataFrame:
    """Videos per country and day: by published or trending day, all rows or first
    appearances only (the latter with the start of the data trimmed: 14 days by
    published day; by trending day 10 videos per country, or 10 days with ``trim_by="days"``)."""
    if trim_by not in ("rows", "days"):
        raise ValueError(trim_by)
    dated = records.withColumn("date_clean", day(records, DAY_COLUMN[date_type]))
    if duplicates:
        return country_day_panel(dated, label)
    flags = label_flags(label)
    flagged = dated.withColumns(flags).select(*dict.fromkeys(["video_id", "country_code", "date_clean", *flags, *order]))
    first = first_appearance(flagged, order, keep=["video_id", "country_code", "date_clean", *flags], narrow=True)
    if date_type == "published":
        return trimmed_published(settle(panel_of_flags(first)))
    if trim_by == "days":
        return trimmed_first_days(panel_of_flags(first))
    return panel_of_flags(trimmed_first_rows(settle(first)))


def with_calendar(panel: DataFrame) -> DataFrame:
    """Month, days since the panel's first day, shares."""
    start = panel.agg(F.min("date_clean")).scalar()
    return with_shares(
        panel.withColumns({"month": F.month("date_clean"), "date_num": F.date_diff("date_clean", start)})
    )


def with_events(panel: DataFrame, events: dict[str, DataFrame]) -> DataFrame:
    """Week windows and event time per event, and a dummy for any event."""
    for name, medals in events.items():
        bounds = span(medals)
        panel = with_event_time(with_event_windows(panel, bounds, name), bounds, name)
    during = [F.col(f"{name}_during") for name in events]
    return panel.withColumn("olympic_period", sum(during[1:], during[0]))


def full_panel(
    panel: DataFrame, events: dict[str, DataFrame], codes: dict[str, str] = fixed.COMMITTEE_CODES
) -> DataFrame:
    """Panel with calendar, committee code, event windows and daily medals.

    The panel and the medals are small and used several times over, so both
    are settled first.
    """
    panel, events = settle(panel), {name: settle(rows) for name, rows in events.items()}
    coded = with_calendar(panel).withColumn("country_code_iso3", mapped("country_code", codes))
    daily = daily_medals(union_all(list(events.values())))
    return with_medals(with_events(coded, events), daily)
