"""Incremental jobs: a file stream with a checkpoint instead of manual restarts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from trendlens.functions import fixed
from trendlens.functions.text import has_keyword, joined_text
from trendlens.operators.lookups import first_seen
from trendlens.session import join_hot
from trendlens.sources.records import existing
from trendlens.sources.sinks import AS_IS

Step = Callable[[DataFrame], DataFrame]


def record_stream(
    spark: SparkSession, folder: str, glob: str | None = None, max_files: int | None = None
) -> DataFrame:
    """Parquet files of a folder as they arrive; the schema is that of the files there now.

    ``glob`` names tables in the folder; each may be a file or a folder of part files.
    """
    path = f"{folder}/{glob}" if glob else folder
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob and not set(glob) & set("*?[]{}\\"):
        path = f"{folder}/{{{glob}}}"  # a stream takes a plain path for a folder, a pattern for either
    return reader.parquet(path)


def run_once(rows: DataFrame, checkpoint: str, out: str, step: Step | None = None, csv: bool = False,
             mode: str = "append") -> None:
    """Process what is new since the last run and stop.

    Every micro-batch writes its own folder ``batch=<id>`` and overwrites it
    when it is retried, so a rerun after a lost driver leaves each row once.
    As CSV, the answer columns are written in their fixed order.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        done = step(batch) if step else batch
        target = f"{out}/batch={batch_id}"
        if csv:
            writer = existing(done, fixed.ANSWER_COLUMNS).write.mode("overwrite").option("header", True)
            writer.options(**AS_IS).csv(target)
        else:
            done.write.mode("overwrite").parquet(target)

    query = (
        rows.writeStream.foreachBatch(write).outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def keyword_stream(rows: DataFrame, cols: list[str], terms: list[str]) -> DataFrame:
    """The keyword filter on a stream: stateless, so nothing to bound."""
    return rows.filter(has_keyword(joined_text(cols), terms))


def lookup_step(known: DataFrame, key: str, value: str, default: str) -> Step:
    """A step that joins each batch with a static (key, value) table; misses get the default.

    Batches are planned like any batch query, and hot keys are split.
    """

    def step(batch: DataFrame) -> DataFrame:
        return join_hot(batch, known, [key]).withColumn(value, F.coalesce(F.col(value), F.lit(default)))

    return step



def _place(row: dict, order: list[str]) -> tuple:
    """A comparable order: nulls first."""
    return tuple((row[c] is not None, row[c]) for c in order)


def _rows(pdf: pd.DataFrame) -> list[dict]:
    return pdf.astype(object).where(pdf.notna(), None).to_dict("records")


def first_seen_updates(rows: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Changes of a first-seen map on a stream: (key, value, order…) whenever a key gets an earlier row than all before.

    The state holds one row per key that was ever seen, so keys of earlier batches and earlier runs count. Copies of a key are
    folded before the shuffle. ``first_seen_now`` makes the map of the changes, the same as ``lookups.first_seen`` of all rows.
    """
    columns = [key, value, *order]
    known = rows.filter(F.col(key).isNotNull() & F.col(value).isNotNull()).select(*columns)

    def fold_copies(pdfs):
        for pdf in pdfs:
            best: dict = {}
            for r in _rows(pdf):
                if r[key] not in best or _place(r, order) < _place(best[r[key]], order):
                    best[r[key]] = r
            if best:
                yield pd.DataFrame(list(best.values()), columns=columns)

    def fold(_, pdfs, state):
        held = dict(zip(columns, state.get)) if state.exists else None
        best = held
        for pdf in pdfs:
            for r in _rows(pdf):
                if best is None or _place(r, order) < _place(best, order):
                    best = r
        if best is not held:
            state.update(tuple(best[c] for c in columns))
            yield pd.DataFrame([best], columns=columns)

    return known.mapInPandas(fold_copies, known.schema).groupBy(key).applyInPandasWithState(
        fold, known.schema, known.schema, "update", GroupStateTimeout.NoTimeout)


def first_seen_now(spark: SparkSession, out: str, key: str, value: str, order: list[str]) -> DataFrame:
    """(key, value): the map after all changes that were written to ``out``."""
    return first_seen(spark.read.parquet(out), key, value, order)
