"""Record sources: CSV landing, merged records, column choice, shards, labelled files."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trendlens.functions import fixed
from trendlens.session import attach_small
from trendlens.sources import splitcsv

_POSITION = ["source_file", "source_block", "source_row"]

RECORD_TYPES = {"publishedAt": "timestamp_ntz", "trending_date": "timestamp_ntz"}  # the time as written, no zone
MEDAL_SCHEMA = {"medal_date": "string", "country_code": "string", "medal_code": "int"}


def _csv(spark: SparkSession, paths: str | list[str], multiline: bool) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", multiline).option("escape", '"').csv(paths)


def _headers(spark: SparkSession, pattern: str) -> dict[str, list[str]]:
    """Files by header line, from one scan: the first line of each file's first block."""
    lines = spark.read.text(pattern).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("n"))
    first = lines.filter("at = 0").groupBy("path").agg(F.min_by("value", "n").alias("header"))
    by_header: dict[str, list[str]] = {}
    for r in first.orderBy("path").collect():  # one short row per file
        by_header.setdefault(r["header"], []).append(unquote(r["path"]))
    return by_header


def union_all(tables: list[DataFrame]) -> DataFrame:
    """All rows, columns matched by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def missing_to_null(df: DataFrame) -> DataFrame:
    """Text cells that stand for a missing value become null."""
    return df.withColumns({
        name: F.when(~F.col(name).isin(fixed.CSV_MISSING), F.col(name)) for name, kind in df.dtypes if kind == "string"
    })


def land_csv(
    spark: SparkSession, pattern: str, out: str, types: dict[str, str] | None = None, multiline: bool = True
) -> None:
    """Read per-country CSV files once and write them as parquet.

    The country is the file name up to its first underscore, also where a file has a
    country_code of its own. Files may differ
    in their columns: those with the same header share one scan. Each row
    keeps where it came from, which ``read_merged`` turns into a gapless
    ``ingest_seq``. ``multiline`` allows line breaks in quoted cells; big files are
    read by many tasks in either case.
    """
    types = RECORD_TYPES if types is None else types
    tables = []
    for paths in _headers(spark, pattern).values():
        names = _csv(spark, paths[:1], multiline).columns
        own = [c for c in names if c.lower() != "country_code"]
        name = F.element_at(F.split("source_file", "/"), -1)
        if multiline:
            placed = splitcsv.parsed(splitcsv.records(spark, paths), names).select(
                *[F.col("cells")[c].alias(c) for c in own], *_POSITION)
        else:
            placed = _csv(spark, paths, False).select(
                *[F.col(f"`{c}`") for c in own], F.col("_metadata.file_path").alias("source_file"),
                F.col("_metadata.file_block_start").alias("source_block"), F.monotonically_increasing_id().alias("source_row"))
        country = F.regexp_extract(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), "^([^_]+)_", 1).alias("country_code")
        values = missing_to_null(placed.select(*[F.col(f"`{c}`") for c in own], country, *_POSITION))
        tables.append(values.withColumns({c: F.col(c).cast(t) for c, t in types.items() if c in own}))
    union_all(tables).write.mode("overwrite").parquet(out)


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """Landed records with ``ingest_seq`` = 0, 1, … in (file, row) order.

    Row ids rise by one inside a file block, so the position is the distance
    to the block's first id plus the rows of earlier blocks: a lookup in the
    table of blocks, no sort of the records.
    """
    rows = spark.read.parquet(path)
    blocks = rows.groupBy("source_file", "source_block").agg(
        F.min("source_row").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    before = W.orderBy("source_file", "source_block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select(
        "source_file", "source_block", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start")
    )
    placed = attach_small(rows, starts, ["source_file", "source_block"], "inner")
    seq = (F.col("_start") + F.col("source_row") - F.col("_first")).alias("ingest_seq")
    return placed.select(*[c for c in rows.columns if c not in _POSITION], seq)


def read_columns(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """Parquet with those of the wanted columns that exist; all if none does."""
    return existing(spark.read.parquet(path), wanted or [])


def existing(df: DataFrame, wanted: list[str]) -> DataFrame:
    have = [c for c in wanted if c in df.columns]
    return df.select(have) if have else df


def read_labelled(spark: SparkSession, paths: list[str], required: bool = False) -> tuple[DataFrame, list[str]]:
    """Union of labelled CSV files, and the paths that were missing.

    A missing file is an error if ``required``, or if no file is there at all.
    """
    tables, missing = [], []
    for path in paths:
        try:
            tables.append(missing_to_null(_csv(spark, path, True)))
        except AnalysisException as error:
            if required or error.getCondition() != "PATH_NOT_FOUND":
                raise
            missing.append(path)
    if not tables:
        raise FileNotFoundError("no labelled file found: " + ", ".join(paths))
    return union_all(tables), missing


def read_medals(spark: SparkSession, path: str) -> DataFrame:
    """Medal rows with their calendar day."""
    raw = _csv(spark, path, True)
    typed = raw.select(*[F.col(c).cast(t).alias(c) for c, t in MEDAL_SCHEMA.items()])
    return typed.withColumn("date_clean", F.col("medal_date").cast("timestamp_ntz").cast("date"))


def shard(df: DataFrame, start: int = 0, maxrows: int | None = None, seq: str = "ingest_seq") -> DataFrame:
    """Rows ``start`` … ``start + maxrows - 1`` by position: a range filter, no sort."""
    rows = df.filter(F.col(seq) >= start)
    return rows if maxrows is None else rows.filter(F.col(seq) < start + maxrows)
