"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What the library expects of a session. Partition counts are left to AQE:
# start wide, coalesce at run time, split skewed join partitions.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "trendlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; keyword arguments use ``_`` for ``.``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in DEFAULTS.items():
        builder = builder.config(name, value)
    for name, value in conf.items():
        builder = builder.config(name.replace("_", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder shared by all executors that the cluster names in
    ``spark.checkpoint.dir``. Only a local session may fall back to its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return _local_dir(spark.sparkContext.applicationId)


@cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix=f"trendlens-{application}-")


def settle(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` as Parquet (with the writer's ``options``) to the shared scratch folder and go on from the files.

    Used where one result feeds several jobs (an iterative fit, a cut-off and
    the filter that uses it), so that lost executors cost a re-read, not a
    recomputation. Columns can be pruned and filters pushed into what is read
    back. The session's settled tables are removed when the driver ends.
    """
    spark = df.sparkSession
    place = f"{_settled_dir(spark)}/{uuid.uuid4().hex}"
    df.write.options(**options).parquet(place)
    return spark.read.schema(df.schema).parquet(place)


_folders: dict[str, str] = {}


def _settled_dir(spark: SparkSession) -> str:
    application = spark.sparkContext.applicationId
    if application not in _folders:
        _folders[application] = f"{scratch_dir(spark)}/settled-{application}"
        atexit.register(_remove, spark, _folders[application])
    return _folders[application]


def _remove(spark: SparkSession, place: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone already
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, max_splits: int = 64) -> DataFrame:
    """Give a table that is stored in very few splits to all cores.

    For CPU-heavy work on small files. A table of more than ``max_splits``
    splits (8 GB at the default split size), or of more than half the number of cores, is
    read as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() <= min(max_splits, cores // 2):
        return df.repartition(cores)
    return df


def attach_small(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "left", max_rows: int = 20_000
) -> DataFrame:
    """Join ``left`` with a side that is expected to be small.

    At most ``max_rows + 1`` rows of ``right`` are looked at. If that is all
    of it, the rows are broadcast and ``left`` is not shuffled; if not, the
    two are shuffled, hot keys split.
    """
    head = right.limit(max_rows + 1).toArrow()
    if head.num_rows <= max_rows:
        return left.join(F.broadcast(left.sparkSession.createDataFrame(head, right.schema)), on, how)
    return join_hot(left, right, on, how)


HOT_ROWS = 1_000_000  # what one task joins with ease: a key with no more rows is never split


def join_hot(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Left, inner or anti join whose left side may have hot keys (null among them).

    AQE cannot split a join partition when one side is an aggregate on the
    join key, as dimensions are. So the left keys are counted first. A key is hot if it
    has more rows than a task's even share, so there are fewer hot keys than tasks. Its rows
    are spread over as many salts as it has shares, and its right row is repeated once per salt.
    Without hot keys it is a plain join.
    """
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    counts = settle(left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    share = max(HOT_ROWS, -(-total // tasks))
    keys = counts.filter(F.col("_n") > share).select(*on, F.ceil(F.col("_n") / share).alias("_salts"))
    found = keys.toArrow()  # fewer than tasks
    if not found.num_rows:
        return left.join(right, on, how)
    hot = F.broadcast(spark.createDataFrame(found, keys.schema))
    no_key = F.lit(False)
    for c in on:
        no_key = no_key | F.col(c).isNull()
    salts = F.when(no_key, F.lit(tasks)).otherwise(F.coalesce("_salts", F.lit(1)))
    salted = left.join(hot, on, "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), salts)).drop("_salts")
    every = F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)).cast("long") - 1)
    copies = right.join(hot, on, "left").withColumn("_salt", F.explode(every)).drop("_salts")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
