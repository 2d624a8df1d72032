"""Seeded samples, quotas and splits by hash rank: uniform, and the same on any cluster layout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlens.functions import fixed
from trendlens.functions.values import country_or
from trendlens.operators.ranking import first_by_hash, hash_order, split_by_hash


def sample_per_country(
    df: DataFrame, key: list[str], k: int = 500, seed: int = 0, country: str = "country_code"
) -> DataFrame:
    """Uniform ``k`` rows per country without replacement; smaller countries whole."""
    rows = df.withColumn("_stratum", country_or(country, fixed.NO_COUNTRY, empty_too=True))
    return first_by_hash(rows, ["_stratum"], key, seed, k).select(df.columns)


def sample_rows(df: DataFrame, key: list[str], n: int, seed: int = 0) -> DataFrame:
    """Uniform ``n`` rows without replacement; everything if there are fewer."""
    return first_by_hash(df, [], key, seed, n).select(df.columns)


def shuffled(df: DataFrame, key: list[str], seed: int = 0) -> DataFrame:
    """All rows in seeded random order (a range-partitioned sort)."""
    return df.orderBy(hash_order(key, seed), *key)


def resample_class(
    df: DataFrame, label: str, value: str, key: list[str], target: int = 400, seed: int = 42
) -> DataFrame:
    """Bring one class to ``target`` rows.

    A smaller class keeps its rows and gets the shortfall drawn from it with
    replacement (column ``draw`` ≥ 1 on drawn rows); a larger one is sampled
    down. Other rows pass through. Null labels count as other.
    """
    is_class = F.coalesce(F.col(label) == value, F.lit(False))
    rest = df.filter(~is_class)
    numbered = first_by_hash(df.filter(is_class), [], key, seed, target, "_pos")
    size = F.coalesce(
        F.nullif(numbered.agg(F.count(F.lit(1))).scalar(), F.lit(0).cast("long")),
        F.raise_error(F.lit(f"no {value} rows to resample")).cast("long"),
    )
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("draw").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10)
    draws = (
        df.sparkSession.range(1, target + 1)
        .select(F.col("id").alias("draw"))
        .withColumn("_size", size)
        .filter(F.col("draw") <= F.lit(target) - F.col("_size"))
        .select("draw", (pick.cast("long") % F.col("_size") + 1).alias("_pos"))
    )
    # checked on the rows that pass through: with no class rows nothing else would be evaluated
    rest = rest.filter(size > 0)
    # both sides hold at most `target` rows
    drawn = numbered.join(F.broadcast(draws), "_pos")
    columns = [*df.columns, "draw"]
    return (
        rest.withColumn("draw", F.lit(0).cast("long")).select(columns)
        .unionByName(numbered.withColumn("draw", F.lit(0).cast("long")).select(columns))
        .unionByName(drawn.select(columns))
    )


def balanced_quota(
    df: DataFrame, key: list[str], quota: int = 250, seed: int = 42, country: str = "country_code"
) -> DataFrame:
    """Up to ``quota`` rows per country; ``round`` is the turn a row is taken in.

    Ordered by (``round``, country) the rows come one per country and turn.
    """
    rows = df.withColumn(country, country_or(country, fixed.UNKNOWN_COUNTRY, empty_too=True))
    return first_by_hash(rows, [country], key, seed, quota, "round")


def stratified_split(
    df: DataFrame, label: str, key: list[str], test_fraction: float = 0.2, seed: int = 42
) -> DataFrame:
    """Flag ``is_test`` on exactly ``round(test_fraction · n)`` rows of each label; a null label is an error."""
    known = F.coalesce(F.col(label), F.raise_error(F.lit("null label")).cast(df.schema[label].dataType))
    return split_by_hash(df.withColumn(label, known), [label], key, seed, test_fraction)
