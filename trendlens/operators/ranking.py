"""Exact ranks, top-n and splits per group without gathering a group.

A group (country, label, …) may hold a third of all rows, so no group is ever
sorted in one task. Two tools:

* hash order: rows are ordered by an MD5 of their key. The first few of each group are found in one pass: every task keeps
  its own first ones, and those are merged in two steps. For many, a histogram over the
  first hex digits tells which bucket each rank falls in; only ranks inside a
  bucket are counted by a window, and buckets are small whatever the group's size.
* given order: group and order columns are sorted over all partitions; a row's place gives its rank.

Keys and orders must identify a row, or ties are decided arbitrarily.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trendlens.session import attach_small, settle

BUCKET_DIGITS = 4  # 65,536 buckets per group


def hash_order(key: list[str], seed: int) -> Column:
    """MD5 of ``key1:key2:…:seed``; the same text in any SQL engine."""
    return F.md5(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key], F.lit(str(seed))))


def _keyed(df: DataFrame, key: list[str], seed: int) -> DataFrame:
    return df.withColumn("_hash", hash_order(key, seed)).withColumn(
        "_bucket", F.substring("_hash", 1, BUCKET_DIGITS)
    )


def _bucket_offsets(keyed: DataFrame, by: list[str]) -> DataFrame:
    """Per (group, bucket): rows in it, rows before it and rows in the group."""
    counts = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*by)
    return counts.select(
        *by, "_bucket", "_n",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_total"),
    )


FEW = 999  # rows per group that one task ranks; from 1,000 on Spark no longer cuts groups inside map tasks
MERGES = 64


def first_by_hash(df: DataFrame, by: list[str], key: list[str], seed: int, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in hash order, with their position: ``rank_by_hash`` with ``upto``, from one read.

    A map task passes on at most ``k`` rows per group, a first merge takes a share of the tasks each, and the last one at
    most MERGES times ``k`` rows per group, however large the group is. More than FEW rows per group are ranked over many tasks.
    """
    if k > FEW:
        return rank_by_hash(df, by, key, seed, upto=k, rank=rank)
    order = ["_hash", *key]
    dealt = df.withColumn("_hash", hash_order(key, seed)).withColumn("_share", F.spark_partition_id() % MERGES)
    part = W.partitionBy(*by, "_share").orderBy(*order)
    some = dealt.withColumn("_at", F.row_number().over(part)).filter(F.col("_at") <= k)
    ranked = some.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long"))
    return ranked.filter(F.col(rank) <= k).select(*df.columns, rank)


def rank_by_hash(
    df: DataFrame, by: list[str], key: list[str], seed: int, upto: int | None = None, rank: str = "rank"
) -> DataFrame:
    """Add each row's position 1, 2, … in its group's hash order.

    With ``upto`` only the first ``upto`` rows per group are kept: buckets past
    that rank are dropped by a broadcast of the few buckets before it, so about
    ``upto`` rows per group reach the shuffle.
    Group columns must not be null.
    """
    keyed = _keyed(df, key, seed)
    offsets = _bucket_offsets(keyed, by).select(*by, "_bucket", "_before")
    if upto is None:
        joined = keyed.join(offsets, [*by, "_bucket"])
    else:
        joined = attach_small(keyed, offsets.filter(F.col("_before") < upto), [*by, "_bucket"], "inner")
    inside = W.partitionBy(*by, "_bucket").orderBy("_hash", *key)
    ranked = joined.withColumn(rank, F.col("_before") + F.row_number().over(inside))
    if upto is not None:
        ranked = ranked.filter(F.col(rank) <= upto)
    return ranked.select(*df.columns, rank)


def split_by_hash(
    df: DataFrame, by: list[str], key: list[str], seed: int, fraction: float, flag: str = "is_test"
) -> DataFrame:
    """Mark ``round(fraction · group size)`` rows of each group, first in hash order.

    The histogram decides all buckets but one per group; only rows of that one
    are ranked, the rest are marked in place and never shuffled.
    """
    keyed = _keyed(df, key, seed)
    quota = F.floor(F.col("_total") * F.lit(fraction) + F.lit(0.5)).cast("long")
    edges = (
        _bucket_offsets(keyed, by)
        .withColumn("_quota", quota)
        .filter((F.col("_before") <= F.col("_quota")) & (F.col("_quota") < F.col("_before") + F.col("_n")))
        .select(*by, F.col("_bucket").alias("_edge"), (F.col("_quota") - F.col("_before")).alias("_left"))
    )
    joined = attach_small(keyed, edges, by, "left")  # no edge: the whole group is inside the quota
    sure = joined.filter(~F.equal_null("_bucket", "_edge")).withColumn(
        flag, F.coalesce(F.col("_bucket") < F.col("_edge"), F.lit(True))
    )
    inside = W.partitionBy(*by).orderBy("_hash", *key)
    edge = joined.filter(F.col("_bucket") == F.col("_edge")).withColumn(
        flag, F.row_number().over(inside) <= F.col("_left")
    )
    columns = [*df.columns, flag]
    return sure.select(columns).unionByName(edge.select(columns))


def with_position(df: DataFrame, order: list[str | Column], name: str = "position") -> DataFrame:
    """Add each row's place 0, 1, … in a total order: a range-partitioned sort, written once, and one offset per partition.

    Rows that tie in ``order`` keep the places they were given when they were written.
    """
    ids = F.monotonically_increasing_id()
    placed = settle(df.orderBy(*order).select("*", F.shiftright(ids, 33).alias("_part"), (ids % F.lit(1 << 33)).alias("_at")))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition of the sort
    starts = settle(sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    joined = attach_small(placed, starts, ["_part"], "inner")
    return joined.select(*df.columns, (F.col("_start") + F.col("_at")).alias(name))


def _cutoffs(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """Per group the order value of its n-th row (its last row if it has fewer).

    All rows are placed in one distributed order, in which a group is a run of any length over as many
    partitions as it needs; the n-th row of a group is n - 1 places after its first.
    """
    placed = settle(with_position(df.select(*by, *order), [*by, *order], "_place"))
    firsts = settle(placed.groupBy(*by).agg(F.min("_place").alias("_first")))
    head = attach_small(placed, firsts, by, "inner").filter(F.col("_place") < F.col("_first") + n)
    return head.groupBy(*by).agg(F.max(F.struct(*order)).alias("_cut"))


def take_first(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """First ``n`` rows of every group; rows with a null group are dropped.

    The cut-off is found on the group and order columns alone; wide rows are
    only filtered by it, not sorted or shuffled.
    """
    rows = df.dropna(subset=by)
    cut = attach_small(rows, _cutoffs(rows, by, order, n), by, "inner")
    return cut.filter(F.struct(*order) <= F.col("_cut")).select(df.columns)


def drop_first(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """All rows of every group but its first ``n``; rows with a null group are dropped."""
    rows = df.dropna(subset=by)
    cut = attach_small(rows, _cutoffs(rows, by, order, n), by, "inner")
    return cut.filter(F.struct(*order) > F.col("_cut")).select(df.columns)


def medians(df: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """Exact median of the non-null values of each group.

    Equal values are counted first; the distinct ones are placed in one distributed order, in which a group is a run of any
    length. Counts per partition and group, added up, tell where the middle ranks lie; no task holds a group's values.
    Group columns must not be null.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = settle(counts.orderBy(*by, value).withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 33)))
    sizes = placed.groupBy("_part", *by).agg(F.sum("_n").alias("_size"))
    group = W.partitionBy(*by)
    offsets = settle(sizes.select(
        "_part", *by, F.sum("_size").over(group).alias("_total"),
        F.coalesce(F.sum("_size").over(group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start")))
    inside = W.partitionBy("_part", *by).orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = F.col("_start") + F.col("_inside")
    ranked = attach_small(placed.withColumn("_inside", F.sum("_n").over(inside)), offsets, ["_part", *by], "inner")

    def at(rank: Column) -> Column:
        return F.when((upto - F.col("_n") < rank) & (rank <= upto), F.col(value))

    low, high = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    middle = ranked.select(*by, at(low).alias("_low"), at(high).alias("_high")).filter("_low IS NOT NULL OR _high IS NOT NULL")
    return middle.groupBy(*by).agg(((F.max("_low") + F.max("_high")) / 2).alias(name))
