"""Connected components of a table of links, by alternating large-star and small-star steps.

Nothing is collected: each step is an aggregate with map-side minimum and one join whose two sides are plain tables, so
that the partitions of a hot vertex can be split. Step results are settled, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlens.session import settle


def components(links: DataFrame) -> DataFrame:
    """(a, b) long to (vertex, component): each vertex of a link with the least vertex it is joined to.

    Links with a null end and loops are passed over; repeated links do no harm.
    """
    now = settle(links.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while not now.isEmpty():
        both = now.union(now.select("b", "a"))
        least = settle(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        large = settle(both.where("b > a").join(least, "a").where("b != m").select(F.col("m").alias("a"), "b").distinct())
        # Small star: every vertex hands its smaller neighbours, and itself, to the least of them.
        least = settle(large.groupBy("b").agg(F.min("a").alias("m")))
        small = large.join(least, "b")
        then = settle(small.where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
                      .union(least.select(F.col("m").alias("a"), "b")).distinct())
        if then.count() == now.count() and then.exceptAll(now).isEmpty():
            break
        now = then
    return now.select(F.col("b").alias("vertex"), F.col("a").alias("component")).union(
        now.select(F.col("a").alias("vertex"), F.col("a").alias("component")).distinct())
