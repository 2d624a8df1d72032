"""Queries for sources and sinks: given tables are written in the outside formats and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlens.operators import classifier, metrics, sampling
from trendlens.session import scratch_dir
from trendlens.sources import records, sinks, views


def _folder(spark) -> str:
    return f"{scratch_dir(spark)}/files-{uuid.uuid4().hex}"


def _write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).options(**sinks.AS_IS).csv(path)


def _name_by_country(spark, folder: str, raw: str) -> None:
    """Part files of ``country=XX`` folders become ``XX_<part>_trending_data.csv``: a few files, by the file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path(raw))
    for part in system.listStatus(path(folder)):
        name = part.getPath().getName()
        if name.startswith("country="):
            for file in system.listStatus(part.getPath()):
                base = file.getPath().getName()
                if base.startswith("part-"):
                    new = f"{name.removeprefix('country=')}_{base.split('-')[1]}_trending_data.csv"
                    system.rename(file.getPath(), path(f"{raw}/{new}"))


def landed_records(spark, sf):
    """Documents as one CSV file per country, with a country column of their own, landed and numbered."""
    folder = _folder(spark)
    docs = views.corpus(spark, sf).select(
        F.col("country_code").alias("country"), "video_id", "title", "description",
        F.lit("2024-07-27T23:30:00-05:00").alias("publishedAt"), F.lit("own").alias("country_code"), "doc_id")
    parts = max(4, views.table(spark, sf, "documents").rdd.getNumPartitions())  # as many as splits, so a task's share does not grow
    dealt = docs.repartitionByRange(parts, "country", "doc_id").sortWithinPartitions("country", "doc_id")
    dealt.write.partitionBy("country").option("header", True).options(**sinks.AS_IS).csv(f"{folder}/parts")
    _name_by_country(spark, f"{folder}/parts", f"{folder}/raw")
    records.land_csv(spark, f"{folder}/raw/*_trending_data.csv", f"{folder}/landed")
    return records.read_merged(spark, f"{folder}/landed").select(
        "ingest_seq", "video_id", "country_code", F.col("publishedAt").cast("date").alias("day"),
        F.sha1("title").alias("title_sha1"), F.sha1("description").alias("text_sha1"))


def labelled_files(spark, sf):
    """Labels in two CSV files with different columns, and a third path that is missing."""
    folder = _folder(spark)
    labels = views.table(spark, sf, "labels")
    _write_csv(labels.filter("doc_id % 2 = 0").select("doc_id", "quality"), f"{folder}/a")
    _write_csv(labels.filter("doc_id % 2 = 1").select("toxic", "doc_id"), f"{folder}/b")
    found, missing = records.read_labelled(spark, [f"{folder}/a", f"{folder}/none", f"{folder}/b"])
    return found.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), F.col("toxic").cast("int"),
                        F.lit(len(missing)).alias("missing"))


def medal_file(spark, sf):
    """Medal rows of both events through a CSV file."""
    path = f"{_folder(spark)}/medals"
    rows = records.union_all(list(views.medals(spark, sf).values()))
    _write_csv(rows.select(F.concat(F.col("date_clean").cast("string"), F.lit("T22:00:00Z")).alias("medal_date"),
                           "country_code", "medal_code"), path)
    return records.read_medals(spark, path).groupBy("date_clean", "country_code", "medal_code").agg(F.count(F.lit(1)).alias("n"))


def written_table(spark, sf):
    """A partitioned table, overwritten once; and what an empty table reads back as."""
    folder = _folder(spark)
    docs = views.corpus(spark, sf).select("doc_id", "title", "country_code")
    sinks.write_table(docs.limit(1), f"{folder}/docs")
    sinks.write_table(docs, f"{folder}/docs", ["country_code"])
    sinks.write_table(docs.filter("doc_id < 0"), f"{folder}/none")
    none = spark.read.parquet(f"{folder}/none")
    return spark.read.parquet(f"{folder}/docs").select("doc_id", F.sha1("title").alias("title_sha1"), "country_code").unionByName(
        none.select("doc_id", "title", "country_code").withColumnRenamed("title", "title_sha1"))


def appended_answers(spark, sf):
    """Answers appended as CSV in two runs."""
    path = f"{_folder(spark)}/answers"
    said = views.json_answers(spark, sf).withColumnsRenamed({"doc_id": "index"}).withColumn("unused", F.lit(1))
    for half in (0, 1):
        sinks.append_answers(said.filter(F.col("index") % 2 == half), path)
    got = sinks.read_answers(spark, path)
    return got.select(F.col("index").cast("long"), F.sha1(F.coalesce("raw_resp", F.lit(""))).alias("raw_sha1"))


def sampled_copy(spark, sf):
    """A uniform sample of a table, written beside it."""
    out = f"{_folder(spark)}/sample"
    sinks.write_sampled(spark, f"{sf}/documents.parquet", out, ["doc_id"], 120, 7)
    return spark.read.parquet(out).select("doc_id", F.col("lang").alias("country_code"))


def reloaded_model(spark, sf):
    """A classifier saved and loaded: every row gets the prediction it got before; the fit has settled."""
    path = f"{_folder(spark)}/model"
    rows = classifier.embedding_features(views.table(spark, sf, "embeddings")).withColumn("label", F.col("label").cast("string"))
    parts = sampling.stratified_split(rows, "label", ["vec_id"])
    model = classifier.fit_classifier(parts.filter(~F.col("is_test")))
    sinks.save_model(model, path)
    before = classifier.score(rows, model).select("vec_id", F.col("predicted_label").alias("before"))
    after = classifier.score(rows, sinks.load_model(path)).select("vec_id", "label", "predicted_label")
    return after.join(before, "vec_id").groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("before") == F.col("predicted_label"), 1)).alias("same")
    ).withColumn("converged", F.lit(model.converged))


def lookup_metrics(spark, sf):
    """Size of a country mapping, and how many candidates it assigned."""
    known, parts = views.known_parts(spark, sf), views.candidate_parts(spark, sf)
    return metrics.lookup_counts(parts, known, "video_id")


QUERIES = {f.__name__: f for f in (
    landed_records, labelled_files, medal_file, written_table, appended_answers, sampled_copy, reloaded_model, lookup_metrics)}

ORACLE = {
    "landed_records": """
SELECT row_number() OVER (ORDER BY lang, doc_id) - 1 AS ingest_seq, CAST(doc_id AS VARCHAR) AS video_id, lang AS country_code,
       DATE '2024-07-27' AS "day", sha1(split_part(text, chr(10), 1)) AS title_sha1, sha1(text) AS text_sha1 FROM documents""",
    "labelled_files": """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN quality END AS quality, CASE WHEN doc_id % 2 = 1 THEN toxic END AS toxic,
       CAST(1 AS INTEGER) AS missing FROM labels""",
    "written_table": "SELECT doc_id, sha1(split_part(text, chr(10), 1)) AS title_sha1, lang AS country_code FROM documents",
    "sampled_copy": """SELECT doc_id, lang AS country_code FROM documents
QUALIFY row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':7'), doc_id) <= 120""",
    "reloaded_model": """
SELECT CAST(label AS VARCHAR) AS label, count(*) AS n, count(*) AS same, TRUE AS converged FROM embeddings GROUP BY 1""",
}
