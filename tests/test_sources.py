import csv
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from trendlens.functions import fixed
from trendlens.operators import lookups
from trendlens.plans import roundtrips
from trendlens.session import scratch_dir
from trendlens.sources import records, sinks, views
from trendlens.streaming import incremental


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w", encoding="utf8", newline="") as f:
        f.write(text)


def test_land_and_read_merged(spark, folder):
    raw = f"{folder}/raw"
    put(raw, "US_trending.csv", 'video_id,title,publishedAt\nu1,"two\nlines, ""quoted""",2020-08-11T16:34:06Z\nu2,NaN,2020-08-12T00:00:00Z\n')
    put(raw, "BR_trending.csv", "video_id,extra,title,publishedAt\n" + "".join(f"b{i},x,t,2021-01-01T00:00:00Z\n" for i in range(5)))
    put(raw, "CA_trending.csv", "video_id,title,publishedAt\nc1,,2020-08-11T16:34:06Z\n")
    records.land_csv(spark, f"{raw}/*_trending.csv", f"{folder}/all")
    got = records.read_merged(spark, f"{folder}/all").orderBy("ingest_seq").collect()
    assert [r["ingest_seq"] for r in got] == list(range(8))
    assert [r["video_id"] for r in got] == ["b0", "b1", "b2", "b3", "b4", "c1", "u1", "u2"]
    assert [r["country_code"] for r in got] == ["BR"] * 5 + ["CA", "US", "US"]
    assert got[6]["title"] == 'two\nlines, "quoted"'
    assert got[7]["title"] is None and got[5]["title"] is None
    assert got[0]["extra"] == "x" and got[6]["extra"] is None
    assert str(got[6]["publishedAt"]).startswith("2020-08-11 16:34:06")


def test_own_country_and_zone(spark, folder):
    put(f"{folder}/raw", "JP_trending.csv", "country_code,publishedAt\nXX,2024-07-27T03:00:00+09:00\n")
    records.land_csv(spark, f"{folder}/raw/*.csv", f"{folder}/all")
    row = records.read_merged(spark, f"{folder}/all").first()
    assert row["country_code"] == "JP"
    assert str(row["publishedAt"]) == "2024-07-27 03:00:00"


def test_splittable_files_keep_row_order(spark, folder):
    put(f"{folder}/raw", "BR_x.csv", "video_id,title\n" + "".join(f"{i:05d},{'t' * 50}\n" for i in range(4000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        records.land_csv(spark, f"{folder}/raw/*.csv", f"{folder}/all", multiline=False)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rows = spark.read.parquet(f"{folder}/all")
    assert rows.select("source_block").distinct().count() > 5
    got = records.read_merged(spark, f"{folder}/all").orderBy("ingest_seq").collect()
    assert [r["video_id"] for r in got] == [f"{i:05d}" for i in range(4000)]
    assert [r["ingest_seq"] for r in got] == list(range(4000))
    part = records.shard(records.read_merged(spark, f"{folder}/all"), 100, 3).collect()
    assert sorted(r["video_id"] for r in part) == ["00100", "00101", "00102"]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("split", ["400", "134217728"])
def test_quoted_line_breaks_on_split_edges(spark, folder, split, end):
    rng = random.Random(7)
    cells = ["", "plain", 'say ""x""', "two\nlines", "\n", "a,b", "\n\n\nfour", "é😀 " * 20, '""', "long " + "line\nbreak, " * 99, "x\r\ny"]
    for country in ("US", "BR", "FR"):
        rows = [(f"{country}{i}", *rng.choices(cells, k=2)) for i in range(0 if country == "FR" else 25)]
        body = "".join(end.join([f'{key},"{a}","{b}"', ""]) + (end if rng.random() < .05 else "") for key, a, b in rows)
        put(f"{folder}/raw", f"{country}_x.csv", f"video_id,title,tags{end}{body}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        records.land_csv(spark, f"{folder}/raw/*.csv", f"{folder}/all")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rows = spark.read.parquet(f"{folder}/all")
    assert (rows.select("source_file", "source_block").distinct().count() > 8) == (split != "134217728")
    got = records.read_merged(spark, f"{folder}/all").orderBy("ingest_seq").collect()
    want = []
    for country in ("BR", "US"):
        with open(f"{folder}/raw/{country}_x.csv", encoding="utf8", newline="") as f:
            want += [r for r in csv.reader(f) if r][1:]
    null = lambda x: None if x in fixed.CSV_MISSING else x
    assert len(got) == len(want)
    for r, w in zip(got, want):
        assert [r["video_id"], r["title"], r["tags"]] == [null(x) for x in w]
    assert [r["ingest_seq"] for r in got] == list(range(50))


def test_labelled_files(spark, folder):
    put(folder, "a.csv", "title,label\nx,olympic\n")
    put(folder, "b.csv", "label,reason,title\nnon_sport,r,y\n")
    df, missing = records.read_labelled(spark, [f"{folder}/a.csv", f"{folder}/none.csv", f"{folder}/b.csv"])
    assert missing == [f"{folder}/none.csv"]
    assert sorted((r["title"], r["reason"]) for r in df.collect()) == [("x", None), ("y", "r")]
    with pytest.raises(FileNotFoundError):
        records.read_labelled(spark, [f"{folder}/none.csv"])
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        records.read_labelled(spark, [f"{folder}/none.csv"], required=True)


def test_medals(spark, folder):
    put(folder, "medals.csv", "medal_code,x,medal_date,country_code\n1,a,2021-07-24 00:00:00.0,ROC\n")
    row = records.read_medals(spark, f"{folder}/medals.csv").first()
    assert (str(row["date_clean"]), row["medal_code"], row["country_code"]) == ("2021-07-24", 1, "ROC")


def test_existing_columns_are_pruned(spark, sf):
    df = records.read_columns(spark, f"{sf}/documents.parquet", ["lang", "nowhere"])
    assert df.columns == ["lang"]
    assert "ReadSchema: struct<lang:string>" in df._jdf.queryExecution().executedPlan().toString()
    assert len(records.read_columns(spark, f"{sf}/documents.parquet", ["nowhere"]).columns) == 5


def test_shard_is_pushed_down(spark, folder):
    spark.range(100).withColumnRenamed("id", "ingest_seq").write.parquet(f"{folder}/t")
    plan = records.shard(spark.read.parquet(f"{folder}/t"), 10, 5)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ingest_seq,10)" in plan and "LessThan(ingest_seq,15)" in plan


def test_empty_table_keeps_its_schema(spark, folder):
    sinks.write_table(spark.range(0), f"{folder}/t")
    assert spark.read.parquet(f"{folder}/t").columns == ["id"]


def test_sampled_copy(spark, folder):
    sinks.write_table(spark.range(500), f"{folder}/t")
    sinks.write_sampled(spark, f"{folder}/t", f"{folder}/s", ["id"], 40)
    assert spark.read.parquet(f"{folder}/s").distinct().count() == 40
    with pytest.raises(ValueError):
        sinks.write_sampled(spark, f"{folder}/t", f"{folder}/t/", ["id"], 40)


def test_answers_append(spark, folder):
    df = spark.createDataFrame([("olympic", 'say "x"\nnow', 1)], "label string, reason string, index long")
    sinks.append_answers(df, f"{folder}/a")
    sinks.append_answers(df, f"{folder}/a")
    got = sinks.read_answers(spark, f"{folder}/a")
    assert got.columns == [c for c in fixed.ANSWER_COLUMNS if c in df.columns]
    assert [r["reason"] for r in got.collect()] == ['say "x"\nnow'] * 2


def test_landed_files_grow_in_number(spark, folder):
    """A table of more splits is dealt to more files, so no task's share grows with it."""
    os.makedirs(folder, exist_ok=True)
    docs = spark.range(400).selectExpr("id AS doc_id", "concat('t ', id, repeat(' x', 50)) AS text", "'en' AS lang", "'s' AS source")
    docs.repartition(24).write.parquet(f"{folder}/documents.parquet")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = roundtrips.landed_records(spark, folder).orderBy("ingest_seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [(r["ingest_seq"], r["video_id"]) for r in rows] == [(i, str(i)) for i in range(400)]
    newest = max(glob.glob(f"{scratch_dir(spark)}/files-*/raw"), key=os.path.getmtime)
    assert len(glob.glob(f"{newest}/en_*_trending_data.csv")) > 4


def test_incremental_runs_take_new_files_once(spark, folder):
    src, out, state = f"{folder}/in", f"{folder}/out", f"{folder}/state"
    spark.range(0, 10).selectExpr("id", "concat('gold ', id) AS title").write.parquet(src)

    def step(batch):
        return batch.withColumn("label", F.lit("olympic"))

    def run():
        rows = incremental.record_stream(spark, src)
        incremental.run_once(incremental.keyword_stream(rows, ["title"], ["GOLD"]), state, out, step)
        return sorted(r["id"] for r in spark.read.parquet(out).collect())

    assert run() == list(range(10))
    assert run() == list(range(10))
    spark.range(10, 15).selectExpr("id", "concat('gold ', id) AS title").write.mode("append").parquet(src)
    spark.range(20, 25).selectExpr("id", "'none' AS title").write.mode("append").parquet(src)
    assert run() == list(range(15))


def test_stream_of_a_named_table(spark, folder):
    """The table may be one file or a folder of part files; other tables beside it are not read."""
    spark.range(0, 10).repartition(3).write.parquet(f"{folder}/parts/documents.parquet")
    spark.range(50, 60).write.parquet(f"{folder}/parts/pages.parquet")
    os.makedirs(f"{folder}/files")
    for name in ("documents", "pages"):
        spark.read.parquet(f"{folder}/parts/{name}.parquet").toPandas().to_parquet(f"{folder}/files/{name}.parquet")
    for place in ("parts", "files"):
        def run():
            rows = incremental.record_stream(spark, f"{folder}/{place}", "documents.parquet")
            incremental.run_once(rows, f"{folder}/{place}-state", f"{folder}/{place}-out")
            return sorted(r["id"] for r in spark.read.parquet(f"{folder}/{place}-out").collect())

        assert run() == list(range(10))
    spark.range(10, 12).write.mode("append").parquet(f"{folder}/parts/documents.parquet")
    place = "parts"
    assert run() == list(range(12))


def test_stream_static_lookup(spark, folder):
    spark.createDataFrame([("v1",), ("v2",)], "video_id string").write.parquet(f"{folder}/in")
    known = spark.createDataFrame([("v1", "BR")], "video_id string, country_code string")
    step = incremental.lookup_step(known, "video_id", "country_code", "XX")
    incremental.run_once(incremental.record_stream(spark, f"{folder}/in"), f"{folder}/state", f"{folder}/out", step, csv=True)
    got = spark.read.option("header", True).csv(f"{folder}/out")
    assert sorted((r["video_id"], r["country_code"]) for r in got.collect()) == [("v1", "BR"), ("v2", "XX")]


def test_first_seen_state_survives_a_restart(spark, folder):
    """Two micro-batches and a restart give the map of one batch; a key's earlier row may come later."""
    kind = "video_id string, country_code string, day date, seq long"
    first = [("a", "US", None, 5), ("b", "BR", None, 3), ("c", None, None, 1), (None, "FR", None, 0)] + [("hot", "US", None, 100 + i) for i in range(500)]
    second = [("a", "DE", None, 2), ("b", "FR", None, 9), ("c", "JP", None, 8), ("d", "IN", None, 7), ("hot", "KR", None, 4)]
    for i, rows in enumerate((first, second)):
        spark.createDataFrame(rows, kind).repartition(3).write.mode("append").parquet(f"{folder}/in")
        stream = incremental.record_stream(spark, f"{folder}/in", max_files=2)
        changes = incremental.first_seen_updates(stream, "video_id", "country_code", ["day", "seq"])
        incremental.run_once(changes, f"{folder}/state", f"{folder}/out", mode="update")
        now = incremental.first_seen_now(spark, f"{folder}/out", "video_id", "country_code", ["day", "seq"])
        batch = lookups.first_seen(spark.read.parquet(f"{folder}/in"), "video_id", "country_code", ["day", "seq"])
        assert sorted(map(tuple, now.collect())) == sorted(map(tuple, batch.collect()))
    assert dict(map(tuple, now.collect())) == {"a": "DE", "b": "BR", "c": "JP", "d": "IN", "hot": "KR"}
    assert spark.read.parquet(f"{folder}/out").filter("video_id = 'hot'").count() <= 4  # changes only, not rows


def test_line_items_are_joined_last_and_not_sorted(spark, sf):
    """Orders get their place first, so line items go through one shuffle and one hash join."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = views.videos(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert "ShuffledHashJoin [l_orderkey" in joins[0] and len(joins) == 4
    assert not any("l_" in line for line in plan.splitlines() if "Sort [" in line)
    assert sum("Exchange hashpartitioning(l_" in line for line in plan.splitlines()) == 1
