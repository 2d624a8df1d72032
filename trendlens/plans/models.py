"""The regression specifications over the full panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlens.operators.countreg import Category, Product, fit_counts
from trendlens.operators.windows import with_rolling_sums

COUNTRY = Category("country_code_iso3")
MONTH = Category("month")
TREND = Product(COUNTRY, "date_num")
WINDOWS = [
    f"{event}_{part}"
    for event in ("summer", "winter")
    for part in ("week_minus_1", "during", "week_plus_1", "week_plus_2", "week_plus_3")
]
BY_COUNTRY = [Product(COUNTRY, "winter_during"), Product(COUNTRY, "summer_during"), TREND, MONTH]

MODELS = {
    "base": ["olympic_period", COUNTRY, "date_num", MONTH],
    "trend": ["olympic_period", TREND, MONTH],
    "season": ["summer_during", "winter_during", TREND, MONTH],
    "hetero": BY_COUNTRY,
    "medal_count": ["medal_count", *BY_COUNTRY],
    "medal_score": ["medal_score", *BY_COUNTRY],
    "pre_post": [*WINDOWS, "medal_count", TREND, MONTH],
}


def fit(panel: DataFrame, *names: str) -> DataFrame:
    """Coefficient tables of the named models, fitted together."""
    return fit_counts(panel, "sports_videos", {n: MODELS[n] for n in names}, exposure="videos")


def compare_medals(panel: DataFrame) -> DataFrame:
    """Coefficient and error of the medal count and of the medal score, each in its own model."""
    return fit(panel, "medal_count", "medal_score").filter(F.col("term") == F.col("model"))


def settled(table: DataFrame) -> DataFrame:
    """What the data decide about a fit: its terms and rows, and that its score equations hold (``score`` is 0)."""
    return table.select("model", "term", "n", "dropped", "converged", F.round("score", 6).alias("score"))


def rolling_sweep(panel: DataFrame, widths: range = range(1, 22)) -> DataFrame:
    """One model per rolling window of medals: (rolling_window, coef, z_value). All share each pass."""
    rolled = with_rolling_sums(panel, widths=widths)
    models = {f"rolling_medals_{t}": [f"rolling_medals_{t}", *WINDOWS, TREND, MONTH] for t in widths}
    table = fit_counts(rolled, "sports_videos", models, exposure="videos")
    return table.filter(F.col("term") == F.col("model")).select(
        F.substring_index("model", "_", -1).cast("int").alias("rolling_window"),
        "coef", F.col("z").alias("z_value"), "n", "converged", "score",
    )
