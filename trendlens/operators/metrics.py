"""Run metrics gathered while a job writes, without a second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """Attach aggregate metrics to a plan; read ``Observation.get`` after the action."""
    seen = Observation()
    return df.observe(seen, *[col.alias(name) for name, col in metrics.items()]), seen


def metrics_frame(df: DataFrame, seen: Observation) -> DataFrame:
    """The observed metrics as a one-row table."""
    values = seen.get
    return df.sparkSession.createDataFrame([tuple(values.values())], list(values))


def lookup_counts(candidates: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys in a lookup table, candidate rows, and rows it assigned a value, as one row."""
    hit = candidates.join(known.select(key).distinct().withColumn("_hit", F.lit(1)), key, "left")
    return hit.agg(F.count(F.lit(1)).alias("candidates"), F.count("_hit").alias("assigned")).withColumn(
        "mapping", known.select(key).distinct().agg(F.count(F.lit(1))).scalar())


def match_counts(df: DataFrame, matched: Column, key: str) -> DataFrame:
    """Rows scanned, rows matched and distinct keys, as one row."""
    per_key = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.coalesce(matched, F.lit(False)).cast("int")).alias("_m")
    )
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("scanned"),
        F.coalesce(F.sum("_m"), F.lit(0)).alias("matched"),
        F.count(F.col(key)).alias("keys"),
    )
