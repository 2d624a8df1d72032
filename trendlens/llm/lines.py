"""Removal of lines that many documents hold, by levelled sorted runs of line hashes.

A line's key is the line without blanks at its ends, A-Z lower-cased. An index (``LineRuns``) holds how many documents had each
key, as runs: tables bucketed and sorted by key hash. A batch of documents is counted, its keys are merge-anti-joined with the
run of keys that are already known to be common, and what is left is added as a new run of the lowest level. ``fanout`` runs
of a level are merged to one of the next, and keys that then have enough documents move to the common run. The runs of a level are
files of one bucketed table, so merges need no shuffle.

Defined cases: a null or empty text is one empty line; each row is a document of its own, also where ids repeat or are null; keys
shorter than ``min_chars`` code points are never removed; a document all of whose lines go has an empty text; an empty table
gives no rows. Texts are split as a whole. Only the key column and the text are read, so other columns may have any name.
"""

from __future__ import annotations

import string
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlens.session import _settled_dir, attach_small, settle

BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    trimmed = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(line) == F.length(line)  # there, lowering all letters is the same and cheaper
    return F.when(ascii_only, F.lower(trimmed)).otherwise(F.translate(trimmed, string.ascii_uppercase, string.ascii_lowercase))


def key_hashes(text: Column, min_chars: int) -> Column:
    """The 128-bit hash of each line's key; null where the key is too short."""
    return F.transform(F.transform(lines_of(text), line_key), lambda key: F.when(F.length(key) >= min_chars, F.unhex(F.md5(key))))


class LineRuns:
    """An index of line keys to numbers of documents, filled batch by batch."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, min_chars: int = 1, fanout: int = 4, buckets: int | None = None):
        self.spark, self.min_docs, self.min_chars, self.fanout = spark, min_docs, min_chars, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.runs: dict[int, int] = {}  # level: runs it holds
        self.merges = 0
        self.tables: dict[int | str, str] = {}

    def _append(self, at: int | str, counts: DataFrame, dealt: bool = False) -> None:
        """Add a run to a level: one more sorted file in each bucket of its table.

        ``dealt``: the rows come from runs and are in their buckets already.
        """
        if at not in self.tables:
            self.tables[at] = f"{self.name}_{at}_{self.merges}"
        rows = counts.select("line", "n") if dealt else counts.select("line", "n").repartition(self.buckets, "line")
        name = self.tables[at]
        (rows.write.mode("append").bucketBy(self.buckets, "line").sortBy("line")
         .option("path", f"{_settled_dir(self.spark)}/{name}").saveAsTable(name))

    def counted(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """The keys of a batch and in how many of its documents they are."""
        each = docs.select(F.explode(F.array_distinct(key_hashes(F.col(text), self.min_chars))).alias("line"))
        return each.where("line is not null").groupBy("line").agg(F.count(F.lit(1)).alias("n"))

    def add(self, counts: DataFrame) -> None:
        """Add a batch (line, n): keys known to be common are left out, the others are a run of the lowest level."""
        if "common" in self.tables:
            counts = counts.join(self.spark.table(self.tables["common"]), "line", "left_anti")
        self._append(0, counts)
        self.runs[0] = self.runs.get(0, 0) + 1
        level = 0
        while self.runs[level] >= self.fanout:
            self._merge(level)
            level += 1

    def _merge(self, level: int) -> None:
        """Add up the runs of a level, bucket by bucket: common keys go to the common run, the rest is a run of the next level."""
        sums = self.spark.table(self.tables[level]).groupBy("line").agg(F.sum("n").alias("n"))
        self._append("common", sums.where(F.col("n") >= self.min_docs), dealt=True)
        self._append(level + 1, sums.where(F.col("n") < self.min_docs), dealt=True)
        self.runs[level], self.runs[level + 1] = 0, self.runs.get(level + 1, 0) + 1
        self._forget(level)

    def _forget(self, at: int | str) -> None:
        self.merges += 1
        self.spark.sql(f"DROP TABLE {self.tables.pop(at)}")

    def frequent(self) -> DataFrame:
        """All keys that enough documents hold: the common run, and what the runs of all levels add up to.

        Levels are merge-joined bucket by bucket; nothing is written, so that batches can be added afterwards. A single run of a
        merged level has no such key.
        """
        levels = [level for level in sorted(self.runs) if self.runs[level]]
        found = [self.spark.table(self.tables["common"]).select("line")] if "common" in self.tables else []
        if levels and (levels[0] == 0 or sum(self.runs[level] for level in levels) > 1):
            sums = None
            for level in levels:
                one = self.spark.table(self.tables[level]).groupBy("line").agg(F.sum("n").alias(f"_{level}"))
                sums = one if sums is None else sums.join(one, "line", "full")
            total = sum((F.coalesce(f"_{level}", F.lit(0)) for level in levels), F.lit(0))
            found.append(sums.where(total >= self.min_docs).select("line"))
        if not found:
            return self.spark.createDataFrame([], "line binary")
        return reduce(DataFrame.unionByName, found).distinct()

    def close(self) -> None:
        """Forget all runs."""
        for at in list(self.tables):
            self._forget(at)
        self.runs = {}


def without_lines(docs: DataFrame, common: DataFrame, key: str = "doc_id", min_chars: int = 1) -> DataFrame:
    """(key, text) to key, n_lines, n_dropped, kept: the lines whose keys are not in ``common``, joined again.

    Common lines are looked up by position; a document's positions come back under a digest of its key and text, so rows that are
    equal in both share them and no row needs an id.
    """
    me = F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))))
    own = docs.select(F.col(key).alias("key"), "text", F.unhex(me).alias("me"))
    placed = own.select("me", F.posexplode(key_hashes(F.col("text"), min_chars)).alias("at", "line")).where("line is not null")
    hits = settle(attach_small(placed, common, ["line"], "inner").groupBy("me").agg(F.collect_set("at").alias("drop")))
    lines = lines_of(F.col("text"))
    keep = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("drop", F.expr("CAST(array() AS array<int>)")))
    split = own.join(hits, "me", "left").select("key", lines.alias("lines"), "drop")
    kept = split.select("key", F.size("lines").cast("long").alias("n_lines"), "lines", keep.alias("keep"))
    return kept.select(F.col("key").alias(key), "n_lines", (F.col("n_lines") - F.size("keep")).alias("n_dropped"),
                       F.array_join(F.transform("keep", lambda i: F.get(F.col("lines"), i)), "\n").alias("kept"))


BATCHES = 6  # more than the fanout, so that keys found common in the first merge are left out of later batches


def op12_lines(spark, sf_dir: str) -> DataFrame:
    """Documents without the lines that at least ten of them hold. They are added to the index in BATCHES batches."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    runs = LineRuns(spark, min_docs=10, min_chars=1)
    batch = F.pmod(F.xxhash64("doc_id"), F.lit(BATCHES)).alias("batch")
    each = docs.select(batch, F.explode(F.array_distinct(key_hashes(F.col("text"), 1))).alias("line")).where("line is not null")
    counts = settle(each.groupBy("batch", "line").agg(F.count(F.lit(1)).alias("n")))  # one read of the texts for all batches
    for b in range(BATCHES):
        runs.add(counts.where(F.col("batch") == b).select("line", "n"))
    common = settle(runs.frequent())
    runs.close()
    done = without_lines(docs, common)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), each AS (
  SELECT r, doc_id, len(lines) AS n_lines, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs
), keyed AS (
  SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM each
), common AS (
  SELECT k FROM keyed WHERE k != '' GROUP BY k HAVING count(DISTINCT r) >= 10
)
SELECT doc_id, n_lines::BIGINT AS n_lines, count(*) FILTER (common.k IS NOT NULL)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (common.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common USING (k) GROUP BY r, doc_id, n_lines
"""
