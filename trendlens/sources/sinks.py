"""Sinks: parquet tables, CSV appends, sampled copies, model bundles."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from trendlens.functions import fixed
from trendlens.operators.sampling import sample_rows


# Cells are written as they are: quotes doubled, blanks at either end kept.
AS_IS = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a parquet table; no rows still leave a readable schema."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_answers(df: DataFrame, path: str) -> None:
    """Append answer rows as CSV with the fixed columns, those that exist, in fixed order."""
    columns = [c for c in fixed.ANSWER_COLUMNS if c in df.columns]
    df.select(columns).write.mode("append").option("header", True).options(**AS_IS).csv(path)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_sampled(spark: SparkSession, source: str, out: str, key: list[str], n: int, seed: int = 0) -> None:
    """A uniform sample of ``n`` rows of a table, written to another path."""
    if source.rstrip("/") == out.rstrip("/"):
        raise ValueError("cannot overwrite the table that is read; write beside it and swap")
    write_table(sample_rows(spark.read.parquet(source), key, n, seed), out)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
