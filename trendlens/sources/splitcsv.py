"""CSV with line breaks in quoted cells, read in splits.

A line break ends a record if the quotes before it are even in number. So the quotes of each block of a file are counted first; a
prefix scan over the blocks (one short row each) tells which of them begin inside a quoted cell. Then every block finds the
records that lie in it by itself. What is cut by block edges, at most one head and one tail per block, is put together afterwards.

Quotes are doubled inside quoted cells and do not occur in others; records end with ``\\n`` or ``\\r\\n``; the text is UTF-8.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trendlens.session import settle

RECORDS = "source_file string, source_block long, source_row long, part int, record string"
WHOLE, HEAD, TAIL = 0, 1, 2


def _lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines in file order within each block; ``\\r`` stays."""
    return spark.read.text(paths, lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))


def inside_blocks(spark: SparkSession, paths: str | list[str]) -> dict[str, np.ndarray]:
    """By file, the starts of the blocks that begin inside a quoted cell: eight bytes per such block are held."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    blocks = _lines(spark, paths).groupBy("path", "block").agg((F.sum(quotes) % 2).alias("odd"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # one short row per block of a file
    inside = blocks.withColumn("odd", F.sum("odd").over(before) % 2).where("odd = 1").groupBy("path").agg(
        F.array_sort(F.collect_list("block")).alias("blocks"))
    return {r["path"]: np.array(r["blocks"], np.int64) for r in inside.toLocalIterator()}


def records(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One row per record, header lines included: source_file, source_block, source_row (its number in the block), record.

    A record belongs to the block it begins in. Empty lines between records are left out.
    """
    inside = inside_blocks(spark, paths)

    def cut(batches):
        at, odd, row, head, held = None, False, 0, False, []

        def piece(part):
            text = "\n".join(held)
            text = text.removesuffix("\r") if part == WHOLE else text
            return (*at, row, part, text) if text or part != WHOLE else None

        def close():
            """The end of a block: what is held may go on in the next one."""
            return [piece(HEAD if head else TAIL)] if at is not None and held else []

        for batch in batches:
            out = []
            values = batch.column("value")
            odds = (pc.count_substring(values, '"').to_numpy(zero_copy_only=False) % 2).tolist()
            for value, path, block, flips in zip(values.to_pylist(), batch.column("path").to_pylist(), batch.column("block").to_pylist(), odds):
                if (path, block) != at:
                    out += close()
                    starts = inside.get(path)
                    odd = starts is not None and bool((starts == block).any())
                    at, row, head, held = (path, block), 0, odd, []
                if held and not odd:  # the line before ended a record
                    done = piece(HEAD if head else WHOLE)
                    out.append(done)
                    row, head, held = row + (done is not None), False, []
                held.append(value)
                odd ^= bool(flips)
            out = [r for r in out if r]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)
        last = [r for r in close() if r]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in last], schema=schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark.createDataFrame([], RECORDS).schema)
    found = settle(_lines(spark, paths).mapInArrow(cut, RECORDS))
    edges = found.where(F.col("part") != WHOLE)
    # Each head belongs to the last record that began before it in its file. Only places are sorted, not texts.
    order = W.partitionBy("source_file").orderBy("source_block", "part").rowsBetween(W.unboundedPreceding, W.currentRow)
    begun = F.when(F.col("part") == TAIL, F.struct(F.col("source_block").alias("block"), F.col("source_row").alias("row")))
    owners = settle(edges.select("source_file", "source_block", "part", F.last(begun, ignorenulls=True).over(order).alias("owner")))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("source_block", "record"))), lambda x: x["record"])
    joined = edges.join(owners, ["source_file", "source_block", "part"]).groupBy("source_file", "owner").agg(
        F.regexp_replace(F.array_join(pieces, "\n"), "\r$", "").alias("record")).where("record != ''")
    return found.where(F.col("part") == WHOLE).select("source_file", "source_block", "source_row", "record").unionByName(
        joined.select("source_file", F.col("owner.block").alias("source_block"), F.col("owner.row").alias("source_row"), "record"))


def parsed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Records to text columns; the first record of each file, its header, is left out."""
    kind = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    body = rows.where((F.col("source_block") > 0) | (F.col("source_row") > 0))
    return body.select(F.from_csv("record", kind, {"escape": '"', "multiLine": "true"}).alias("cells"),
                       "source_file", "source_block", "source_row")

