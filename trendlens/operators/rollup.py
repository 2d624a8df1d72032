"""Counts, shares and per-group summaries (partial aggregation before each shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlens.functions import fixed
from trendlens.functions.values import olympic_flag, replaced, share, sport_flag
from trendlens.operators.ranking import medians
from trendlens.session import settle


def country_day_panel(df: DataFrame, label: str = "predicted_label") -> DataFrame:
    """Videos, sport videos and olympic videos per country and day; empty days are absent."""
    return panel_of_flags(df.withColumns(label_flags(label)))


def label_flags(label: str = "predicted_label") -> dict[str, Column]:
    return {"_sport": sport_flag(label), "_olympic": olympic_flag(label)}


def panel_of_flags(df: DataFrame) -> DataFrame:
    """``country_day_panel`` of rows with ``label_flags`` in the label's place."""
    return (
        df.dropna(subset=["country_code", "date_clean"])
        .groupBy("country_code", "date_clean")
        .agg(
            F.count(F.lit(1)).alias("videos"),
            F.sum("_sport").alias("sports_videos"),
            F.sum("_olympic").alias("olympic_videos"),
        )
    )


def with_shares(panel: DataFrame) -> DataFrame:
    return panel.withColumns(
        {"sports_pct": share("sports_videos", "videos"), "olympic_pct": share("olympic_videos", "videos")}
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Non-null values with their count and their share of the non-null rows."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    # the total comes from the counts, whose shuffle is reused
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def record_counts(df: DataFrame, key: str = "video_id", country: str = "country_code") -> DataFrame:
    """Distinct videos, distinct (country, video) pairs and rows; null counts as a value.

    Folds to one row per pair, then per video, so no task sees all rows of a hot video.
    """
    pairs = df.groupBy(key, country).agg(F.count(F.lit(1)).alias("rows"))
    videos = pairs.groupBy(key).agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("pairs"))
    return videos.agg(
        F.count(F.lit(1)).alias("distinct_videos"),
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("distinct_pairs"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
    )


def null_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.agg(*[F.coalesce(F.sum(F.col(c).isNull().cast("int")), F.lit(0)).alias(c) for c in cols])


def medal_rows(medals: DataFrame) -> DataFrame:
    """Country aliases resolved, one 0/1 column per medal kind (null code: all 0)."""
    kind = {1: "gold", 2: "silver", 3: "bronze"}
    flags = {name: F.coalesce((F.col("medal_code") == code).cast("int"), F.lit(0)) for code, name in kind.items()}
    return medals.withColumns({"country_code_iso3": replaced("country_code", fixed.CODE_ALIASES), **flags})


def daily_medals(medals: DataFrame) -> DataFrame:
    """Medals of each kind per day and committee code."""
    return (
        medal_rows(medals)
        .dropna(subset=["date_clean", "country_code_iso3"])
        .groupBy("date_clean", "country_code_iso3")
        .agg(*[F.sum(c).alias(c) for c in ("gold", "silver", "bronze")])
    )


def with_medals(panel: DataFrame, daily: DataFrame) -> DataFrame:
    """Panel with daily medals (0 where none), their count and their 3-2-1 score."""
    joined = panel.join(daily, ["date_clean", "country_code_iso3"], "left").fillna(0, ["gold", "silver", "bronze"])
    return joined.select(
        *panel.columns, "gold", "silver", "bronze",
        (F.col("gold") + F.col("silver") + F.col("bronze")).alias("medal_count"),
        (3 * F.col("gold") + 2 * F.col("silver") + F.col("bronze")).alias("medal_score"),
    )


def dispersion(panel: DataFrame, col: str = "sports_videos") -> DataFrame:
    """Sample variance and mean: far apart means a Poisson model does not fit."""
    return panel.agg(F.var_samp(col).alias("variance"), F.avg(col).alias("mean"))


def country_sizes(panel: DataFrame, country: str = "country_code_iso3") -> DataFrame:
    """Mean videos, mean sport videos and exact median sport share per country."""
    rows = settle(panel.dropna(subset=[country]).select(country, "videos", "sports_videos", "sports_pct"))
    means = rows.groupBy(country).agg(F.avg("videos").alias("videos"), F.avg("sports_videos").alias("sports_videos"))
    return means.join(medians(rows, [country], "sports_pct", "sports_pct"), country, "left")
