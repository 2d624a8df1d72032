"""Classification report and confusion matrix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def confusion(df: DataFrame, label: str, prediction: str, classes: list[str]) -> DataFrame:
    """One row per true class, one count column per predicted class, classes sorted.

    A row for every class, also for one that never occurs.
    """
    classes = sorted(classes)
    rows = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in classes])).alias(label))
    cells = df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("_n"))
    counted = cells.groupBy(label).agg(
        *[F.sum(F.when(F.col(prediction) == c, F.col("_n"))).alias(c) for c in classes]
    )
    return rows.join(counted, label, "left").fillna(0, classes).orderBy(label)


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def classification_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted means.

    Undefined ratios are 0. After the first count only class × class rows are left.
    """
    cells = df.groupBy(F.col(label).alias("_l"), F.col(prediction).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    sides = cells.select(
        F.explode(F.array(
            F.struct(F.col("_l").alias("class"), F.col("_n").alias("support"), F.lit(0).cast("long").alias("chosen"),
                     F.when(F.col("_l") == F.col("_p"), F.col("_n")).otherwise(0).alias("hit")),
            F.struct(F.col("_p").alias("class"), F.lit(0).cast("long").alias("support"), F.col("_n").alias("chosen"),
                     F.lit(0).cast("long").alias("hit")),
        )).alias("s")
    ).select("s.*")
    per_class = (
        sides.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "chosen", "hit")])
        .withColumn("precision", _ratio(F.col("hit"), F.col("chosen")))
        .withColumn("recall", _ratio(F.col("hit"), F.col("support")))
        .withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    )
    share = F.col("support") / F.sum("support").over(W.partitionBy())
    weighed = per_class.withColumn("_w", share)
    scores = ("precision", "recall", "f1")
    accuracy = _ratio(F.sum("hit"), F.sum("support"))
    total = F.sum("support").alias("support")
    return (
        per_class.select("class", *scores, "support")
        .unionByName(per_class.agg(*[accuracy.alias(s) for s in scores], total).withColumn("class", F.lit("accuracy")))
        .unionByName(per_class.agg(*[F.avg(s).alias(s) for s in scores], total).withColumn("class", F.lit("macro avg")))
        .unionByName(
            weighed.agg(*[F.sum(F.col(s) * F.col("_w")).alias(s) for s in scores], total)
            .withColumn("class", F.lit("weighted avg"))
        )
    )
