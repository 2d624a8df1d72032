"""Corpus pipeline: language, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns a table; between stages tables are
written as Parquet and read again. All but the last return the columns of ``documents``.

Nulls: a document without text has no language and goes in the first stage; documents without id are in no group and stay.
Rows that share an id are told apart by their texts: different texts stay, equal ones are one row. Empty tables give empty
tables. Columns beyond those of ``documents`` are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlens.llm.jaccard import jaccard_components
from trendlens.llm.language import UNKNOWN, fit, held_out, labelled_text, predict
from trendlens.llm.packing import pack_documents
from trendlens.llm.substrings import remove_repeats
from trendlens.session import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found: those without a letter. A missing ``lang`` is filled in."""
    model = fit(labelled_text(docs, ~held_out(F.col("doc_id")), 64, 32_000))
    told = predict(docs.select(F.col("text").alias("_text"), *COLUMNS), model)
    found = F.col("lang_pred") != UNKNOWN
    return told.where(found if model["languages"] else F.col("text").isNotNull()).withColumn(
        "lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group. Where ids repeat, each row counts as a document of its own,
    but rows equal in id and text are one (the least lang, source and n_chars stay)."""
    repeated = settle(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"))
    if repeated.isEmpty():
        groups = jaccard_components(docs)
        go = settle(groups.where("component_id != doc_id").select("doc_id").distinct())
        return docs.select(*COLUMNS).join(go, "doc_id", "left_anti").select(*COLUMNS)
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    many = docs.join(repeated, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("r"))
    rows = docs.join(repeated, "doc_id", "left_anti").select(*COLUMNS).unionByName(many.select("doc_id", "text", "r.*"))
    rows = settle(rows.withColumn("row", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())))
    groups = jaccard_components(rows.select(F.col("row").alias("doc_id"), "text")).where("doc_id is not null")
    members = settle(rows.select("row", "doc_id", F.md5("text").alias("digest")).join(
        groups.select(F.col("doc_id").alias("row"), "component_id"), "row"))
    stay = settle(members.groupBy("component_id").agg(F.min(F.struct("doc_id", "digest", "row")).alias("m")).select("m.row"))
    return rows.join(stay, "row", "left_semi").select(*COLUMNS).unionByName(rows.where("doc_id is null").select(*COLUMNS))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that an earlier document holds; a document of which nothing is left goes."""
    changed = settle(remove_repeats(docs).where("n_removed > 0").select("doc_id", "kept").dropDuplicates(["doc_id"]))
    text = F.coalesce("kept", "text")
    return docs.select(*COLUMNS).join(changed, "doc_id", "left").where("kept is null or kept != ''").select(
        "doc_id", text.alias("text"), "lang", "source",
        F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("kept")).cast("long").alias("n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 ids."""
    return pack_documents(docs.select("doc_id", "text"))


STAGES = [
    ("language", language_stage), ("near duplicates", near_duplicate_stage),
    ("repeated passages", substring_stage), ("packing", packing_stage),
]
ORACLE_SQL = None  # cross-parsing is no SQL; tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
