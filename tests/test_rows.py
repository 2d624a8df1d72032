"""Dedupe, ranks, samples, lookups: against brute force, with one group holding a third of all rows or more."""

import datetime
import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendlens import session as session_module
from trendlens.operators import dedupe, lookups, ranking, sampling
from trendlens.plans import candidates, panel


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows; country A holds half of them, video v0 a third; order is a permutation."""
    rnd = random.Random(1)
    seqs = list(range(3000))
    rnd.shuffle(seqs)
    rows = [
        (s, "A" if i % 2 else rnd.choice("BCD"), "v0" if i % 3 == 0 else f"v{rnd.randrange(400)}", rnd.randrange(30))
        for i, s in enumerate(seqs)
    ]
    return spark.createDataFrame(rows, "seq long, country_code string, video_id string, day int").repartition(7).cache()


@pytest.fixture(params=["broadcast", "shuffled"])
def attach(request, monkeypatch):
    """Both ways of joining the small side."""
    if request.param == "shuffled":
        real = session_module.attach_small

        def never_small(left, right, on, how="left", max_rows=20_000):
            return real(left, right, on, how, max_rows=0)

        monkeypatch.setattr(ranking, "attach_small", never_small)


def md5_order(seq, seed):
    return hashlib.md5(f"{seq}:{seed}".encode()).hexdigest()


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["country_code"], []).append(r["seq"])
    return {k: sorted(v) for k, v in out.items()}


def test_first_appearance(spark, skewed):
    best = {}
    for r in skewed.collect():
        key = (r["video_id"], r["country_code"])
        best[key] = min(best.get(key, (99, 0)), (r["day"], r["seq"]))
    got = dedupe.first_appearance(skewed, ["seq"], day="day").collect()
    assert {(r["video_id"], r["country_code"]): (r["day"], r["seq"]) for r in got} == best
    assert len(got) == len(best)


def test_first_appearance_drops_null_keys(spark):
    df = spark.createDataFrame([(1, None, "v", 1), (2, "A", None, 1), (3, "A", "v", None), (4, "A", "v", 5)],
                               "seq long, country_code string, video_id string, day int")
    assert [r["seq"] for r in dedupe.first_appearance(df, ["seq"], day="day").collect()] == [4]


def test_packed_columns_sort_and_come_back(spark):
    day = datetime.date
    rows = [(k, d, n, f, c) for k, (d, n, f, c) in enumerate(itertools.product(
        [None, day(1969, 12, 31), day(2024, 2, 29)], [None, -5, 7], [None, False, True], [None, "", "é", "DE", "D"]))]
    df = spark.createDataFrame(rows, "k int, d date, n long, f boolean, c string")
    whole, unpacked = dedupe.packed(df, ["d", "n", "f", "c"], ("c",))
    got = df.withColumn("p", whole).select("k", "p", F.struct(*unpacked(F.col("p"))).alias("back")).collect()
    assert {r["k"]: tuple(r["back"]) for r in got} == {r[0]: r[1:] for r in rows}
    first = [r["k"] for r in df.orderBy("d", "n", "f", "c").select("k").collect()]
    assert [r["k"] for r in sorted(got, key=lambda r: r["p"])] == first
    assert dedupe.packed(df, ["c"]) is None and dedupe.packed(df.limit(0), ["n"]) is None  # not named as a code; no rows
    ends = spark.createDataFrame([(-2**63, "a\0"), (2**63 - 1, "long text")], "n long, c string")
    assert dedupe.packed(ends, ["n"]) is None and dedupe.packed(ends, ["c"], ("c",)) is None
    empty = spark.createDataFrame([(None, ""), (None, "")], "n long, c string")
    whole, unpacked = dedupe.packed(empty, ["n", "c"], ("c",))
    assert [tuple(r) for r in empty.select(whole.alias("p")).select(*unpacked(F.col("p"))).collect()] == [(None, ""), (None, "")]


def test_first_rows_by_hash(spark, skewed):
    """Narrow rows need no sort; columns that do not fit give the same rows by the other way."""
    narrow = skewed.select("video_id", "country_code", "day", "seq")
    plans = [dedupe.first_appearance(narrow, ["seq"], day="day"), lookups.first_seen(skewed, "video_id", "country_code", ["day", "seq"])]
    for df in plans:
        assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
    wide = dedupe.first_appearance(narrow.withColumn("half", F.lit(0.5)), ["seq"], day="day")
    assert sorted(map(tuple, wide.drop("half").collect())) == sorted(map(tuple, plans[0].collect()))
    slow = lookups.first_seen(skewed.withColumn("half", F.col("seq") / 2), "video_id", "country_code", ["day", "half"])
    assert sorted(map(tuple, slow.collect())) == sorted(map(tuple, plans[1].collect()))


def test_first_rows_by_a_part_of_the_order(spark, monkeypatch):
    """The order goes on with a double; rows that are alike in its whole numbers are told apart by it, whatever they keep."""
    rnd = random.Random(3)
    some = [(rnd.choice("ABC"), rnd.randrange(40), rnd.choice([None, -3, 0, 5]), rnd.choice([None, 1, 2]), n / 2, rnd.randrange(2)) for n in range(2000)]
    twins = [("D", 1, 0, 1, 0.5, 1), ("D", 1, 0, 1, 0.25, 0), ("D", 2, 0, 1, 0.5, 0), ("D", 2, 0, 1, 0.25, 1), ("D", 3, 0, 1, 0.5, 1), ("D", 3, 0, 1, 0.5, 1)]
    columns = "country_code string, video_id long, day int, a long, b double, flag int"
    best = {}
    for r in sorted(some + twins, key=lambda r: tuple((x is not None, x) for x in r[2:5])):
        if r[2] is not None:
            best.setdefault(r[:2], (r[2], r[5]))
    keep = ["video_id", "country_code", "day", "flag"]
    sorted_rows = []
    real = dedupe._by_sorting
    monkeypatch.setattr(dedupe, "_by_sorting", lambda rows, *rest: sorted_rows.append(rows.count()) or real(rows, *rest))
    got = dedupe.first_appearance(spark.createDataFrame(some + twins, columns), ["a", "b"], "day", keep=keep, narrow=True).collect()
    assert {(r["country_code"], r["video_id"]): (r["day"], r["flag"]) for r in got} == best and len(got) == len(best)
    assert len(sorted_rows) == 1 and 4 <= sorted_rows[0] < 2000  # the tied keys' rows alone
    clear = [r for r in twins if r[1] == 3] + [("E", 1, 0, 1, 1.0, 1), ("E", 1, 0, 2, 0.0, 0)]
    got = dedupe.first_appearance(spark.createDataFrame(clear, columns), ["a", "b"], "day", keep=keep, narrow=True).collect()
    assert sorted(map(tuple, got)) == [(1, "E", 0, 1), (3, "D", 0, 1)] and len(sorted_rows) == 1
    huge = [("A", 1, 0, 2**62, 1.0, 1), ("A", 1, 0, -2**62, 2.0, 0), ("A", 2, 1, 7, 0.0, 1)]  # only the day fits
    got = dedupe.first_appearance(spark.createDataFrame(huge, columns), ["a", "b"], "day", keep=keep, narrow=True).collect()
    assert sorted(map(tuple, got)) == [(1, "A", 0, 0), (2, "A", 1, 1)]
    none = dedupe.first_appearance(spark.createDataFrame([], columns), ["a", "b"], "day", keep=keep, narrow=True)
    assert none.columns == keep and not none.collect()


def test_panel_rows_are_not_sorted(spark, monkeypatch):
    """An order with times and doubles does not fit into a long; the first appearances are hashed all the same."""
    rows = [("v1", "BR", "2021-01-01", "non_sport", 0, 0.5), ("v1", "BR", "2021-01-01", "olympic", 1, 0.5), ("v2", "BR", "2021-01-20", None, 2, 0.5)]
    df = spark.createDataFrame(rows, "video_id string, country_code string, publishedAt string, predicted_label string, n long, x double")
    plans, real = [], panel.settle
    monkeypatch.setattr(panel, "settle", lambda d: plans.append(d._jdf.queryExecution().executedPlan().toString()) or real(d))
    found = panel.create_panel(df, ["n", "x"]).collect()
    assert [(r["videos"], r["sports_videos"], r["olympic_videos"]) for r in found] == [(1, 1, 0)]
    assert plans and not any("SortAggregate" in p for p in plans)


def test_keep_first_is_map_side_combined(skewed):
    plan = dedupe.keep_first(skewed, ["video_id"], ["seq"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan


@pytest.mark.parametrize("k", [1, 50, 5000])
def test_sample_per_country(skewed, attach, k):
    want = {}
    for r in skewed.collect():
        want.setdefault(r["country_code"], []).append(r["seq"])
    want = {c: sorted(sorted(v, key=lambda s: md5_order(s, 3))[:k]) for c, v in want.items()}
    assert groups(sampling.sample_per_country(skewed, ["seq"], k, 3)) == want


def test_sample_null_and_empty_country_share_a_stratum(spark):
    df = spark.createDataFrame([(i, (None, "", "XX")[i % 3]) for i in range(30)], "seq long, country_code string")
    got = sampling.sample_per_country(df, ["seq"], 6).collect()
    assert len(got) == 6


def test_rank_by_hash_is_a_full_ranking(skewed):
    got = ranking.rank_by_hash(skewed, ["country_code"], ["seq"], 9).collect()
    by = {}
    for r in got:
        by.setdefault(r["country_code"], []).append((r["rank"], r["seq"]))
    for rows in by.values():
        assert [s for _, s in sorted(rows)] == sorted((s for _, s in rows), key=lambda s: md5_order(s, 9))
        assert sorted(n for n, _ in rows) == list(range(1, len(rows) + 1))


def test_ranks_inside_shared_buckets(spark, monkeypatch):
    """One hex digit makes 16 buckets, so most ranks come from the window inside a bucket."""
    monkeypatch.setattr(ranking, "BUCKET_DIGITS", 1)
    df = spark.range(500).withColumnRenamed("id", "seq")
    order = sorted(range(500), key=lambda s: md5_order(s, 0))
    got = {r["seq"]: r["rank"] for r in ranking.rank_by_hash(df, [], ["seq"], 0, upto=123).collect()}
    assert got == {s: i + 1 for i, s in enumerate(order[:123])}


def test_no_group_is_ranked_in_one_window(skewed):
    """Rows are never partitioned by the group alone."""
    for df in (ranking.rank_by_hash(skewed, ["country_code"], ["seq"], 1),
               ranking.rank_by_hash(skewed, ["country_code"], ["seq"], 1, upto=10)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "row_number" in line and "Window" in line:
                assert "_bucket" in line.split("],")[1]


def test_medians_of_a_skewed_group(spark, attach):
    rng = random.Random(3)
    rows = [("hot", rng.choice([0.25, 0.5, rng.random()])) for _ in range(2000)] + [("one", -1.5), ("two", 1.0), ("two", 4.0), ("ties", 2.0)]
    rows += [("ties", 2.0)] * 50 + [("ties", 3.0), ("none", None), ("hot", None)]
    want = {}
    for c, v in rows:
        if v is not None:
            want.setdefault(c, []).append(v)
    df = spark.createDataFrame(rows, "c string, v double").repartition(7)
    got = {r.c: r.median for r in ranking.medians(df, ["c"], "v").collect()}
    assert got == {c: float(np.median(v)) for c, v in want.items()}


@pytest.mark.parametrize("max_bits", [28, 8])
def test_exclude_signed_by_bloom_filter(spark, max_bits):
    rows = [(i, f"t{i % 700}" if i % 50 else None, "c") for i in range(3000)] + [(3000 + i, "hot", "c") for i in range(500)]
    records = spark.createDataFrame(rows, "seq long, title string, channelTitle string")
    candidates = records.filter("seq < 300 or title = 'hot'").drop("seq")
    gone = {(r.title or "") for r in candidates.collect()}
    got = lookups.exclude_signed(records, candidates, max_bits=max_bits)
    assert sorted(r.seq for r in got.collect()) == [i for i, t, _ in rows if (t or "") not in gone]
    assert got.columns == records.columns
    assert lookups.exclude_signed(records, candidates.limit(0), max_bits=max_bits).count() == len(rows)


def test_bloom_filter_hits_every_key_and_few_others(spark):
    def signed(a, b):
        return spark.range(a, b).select(F.sha1(F.col("id").cast("string")).alias("_sig"))

    bits = lookups.bloom_filter(signed(0, 2000))
    def hits(df):
        places = np.array([list(r) for r in df.select(*lookups._probes((64 * len(bits)).bit_length() - 1)).collect()])
        return ((bits[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) == 1).all(axis=1)
    assert hits(signed(0, 2000)).all() and hits(signed(5000, 9000)).mean() < 0.03


@pytest.mark.parametrize("by", [["country_code"], []])
@pytest.mark.parametrize("k", [1, 10, 999, 1000, 5000])
def test_first_by_hash_takes_the_same_rows_in_one_read(skewed, by, k):
    took = ranking.first_by_hash(skewed, by, ["seq"], 1, k)
    want = ranking.rank_by_hash(skewed, by, ["seq"], 1, upto=k)
    plan = took._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, took.collect())) == sorted(map(tuple, want.collect()))
    if k <= ranking.FEW and by:  # groups are cut before each shuffle
        assert plan.count("WindowGroupLimit") >= plan.count("Exchange hashpartitioning")
        alone = skewed.select("*")._jdf.queryExecution().executedPlan().toString()  # of a frame that has not run, as ``plan`` is
        assert plan.count("Scan ") == alone.count("Scan ")


@pytest.mark.parametrize("fraction", [0.0, 0.2, 0.5, 1.0])
def test_stratified_split(skewed, attach, fraction):
    got = sampling.stratified_split(skewed, "country_code", ["seq"], fraction, 4).collect()
    assert len(got) == 3000
    by = {}
    for r in got:
        by.setdefault(r["country_code"], []).append((md5_order(r["seq"], 4), r["is_test"]))
    for rows in by.values():
        quota = int(len(rows) * fraction + 0.5)
        assert [t for _, t in sorted(rows)] == [True] * quota + [False] * (len(rows) - quota)


def test_split_rejects_null_labels(spark):
    df = spark.createDataFrame([(1, None), (2, "a")], "seq long, label string")
    with pytest.raises(Exception, match="null label"):
        sampling.stratified_split(df, "label", ["seq"]).collect()


@pytest.mark.parametrize("n", [0, 1, 10, 200, 2500])
def test_take_and_drop_first(skewed, attach, n):
    want = {}
    for r in skewed.collect():
        want.setdefault(r["country_code"], []).append(r["seq"])
    if n:
        assert groups(ranking.take_first(skewed, ["country_code"], ["seq"], n)) == {c: sorted(v)[:n] for c, v in want.items()}
        assert groups(ranking.drop_first(skewed, ["country_code"], ["seq"], n)) == {
            c: sorted(v)[n:] for c, v in want.items() if len(v) > n}


def test_resample_class(spark):
    rows = [(i, "rare" if i < 7 else "other") for i in range(50)] + [(99, None)]
    df = spark.createDataFrame(rows, "seq long, label string")
    up = sampling.resample_class(df, "label", "rare", ["seq"], 20).collect()
    rare = [r for r in up if r["label"] == "rare"]
    assert len(rare) == 20 and {r["seq"] for r in rare} == set(range(7))
    assert sum(r["draw"] == 0 for r in rare) == 7
    assert sorted(r["draw"] for r in rare if r["draw"]) == list(range(1, 14))
    assert len(up) == 20 + 44
    down = sampling.resample_class(df, "label", "other", ["seq"], 10).collect()
    assert sum(r["label"] == "other" for r in down) == 10 and all(r["draw"] == 0 for r in down)
    with pytest.raises(Exception, match="no nothing rows"):
        sampling.resample_class(df, "label", "nothing", ["seq"], 10).collect()


def test_balanced_quota(skewed):
    got = sampling.balanced_quota(skewed, ["seq"], 30).orderBy("round", "country_code").collect()
    assert [(r["round"], r["country_code"]) for r in got] == [(n, c) for n in range(1, 31) for c in "ABCD"]


def test_lookup_country(spark, skewed):
    known = skewed.filter("day < 15")
    first = {}
    for r in sorted(known.collect(), key=lambda r: r["seq"]):
        first.setdefault(r["video_id"], r["country_code"])
    cands = spark.createDataFrame([("v0", "old")] * 50 + [(f"v{i}", "old") for i in range(450)] + [(None, "old")],
                                  "video_id string, country_code string")
    got = lookups.lookup_country(cands, known, ["seq"]).collect()
    assert len(got) == 501
    assert all(r["country_code"] == first.get(r["video_id"], "XX") for r in got)


def test_lookup_ignores_null_values(spark):
    known = spark.createDataFrame([(1, "v", None), (2, "v", "BR"), (3, None, "US")], "seq long, video_id string, country_code string")
    cands = spark.createDataFrame([("v",), (None,)], "video_id string")
    assert sorted(r["country_code"] for r in lookups.lookup_country(cands, known, ["seq"]).collect()) == ["BR", "XX"]


def test_annotate_picks_the_key_both_have(spark):
    records = spark.createDataFrame([(1, "v1", "a", "BR"), (2, "v2", "b", "US")], "seq long, video_id string, title string, country_code string")
    cands = spark.createDataFrame([("v1", "a"), ("lost", "b"), (None, "c")], "video_id string, title string")

    def got(df, **options):
        rows = lookups.annotate_country(df, records, ["seq"], **options).collect()
        return {r["title"]: r["country_code"] for r in rows}

    assert got(cands) == {"a": "BR", "b": "XX", "c": "XX"}
    assert got(cands, use_signature_if_missing=True) == {"a": "BR", "b": "US", "c": "XX"}
    assert got(cands.drop("video_id")) == {"a": "BR", "b": "US", "c": "XX"}


@pytest.fixture()
def few_rows_are_hot(monkeypatch):
    monkeypatch.setattr(session_module, "HOT_ROWS", 100)


def test_as_many_hot_keys_as_there_are(spark, monkeypatch):
    monkeypatch.setattr(session_module, "HOT_ROWS", 2)
    left = spark.range(0, 9000, 1, 8).select("id", (F.col("id") % 2000).alias("k"))
    right = spark.range(1990).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    got = {r["id"]: r["v"] for r in session_module.join_hot(left, right, ["k"]).collect()}
    assert got == {i: i % 2000 * 3 if i % 2000 < 1990 else None for i in range(9000)}


def test_more_than_a_thousand_of_each_group(spark):
    df = spark.range(0, 7000, 1, 6).select("id", (F.col("id") % 3).alias("g"), (F.hash("id") % 50).alias("a"))
    rows = [(r["g"], r["a"], r["id"]) for r in df.collect()]
    for n in (1, 1500, 9999):
        want = {x for g in range(3) for x in sorted(r for r in rows if r[0] == g)[:n]}
        assert {(r["g"], r["a"], r["id"]) for r in ranking.take_first(df, ["g"], ["a", "id"], n).collect()} == want
        assert {(r["g"], r["a"], r["id"]) for r in ranking.drop_first(df, ["g"], ["a", "id"], n).collect()} == set(rows) - want


def test_positions_of_any_table(spark):
    df = spark.range(0, 500, 1, 7).select((F.col("id") * 37 % 501).alias("x"))
    got = ranking.with_position(df, ["x"]).orderBy("x").collect()
    assert [r["position"] for r in got] == list(range(500))


@pytest.mark.parametrize("how", ["left", "inner", "left_anti"])
def test_hot_join_gives_the_plain_join(spark, few_rows_are_hot, how):
    kind = F.col("id") % 3
    key = F.when(kind == 0, "hot").when(kind == 1, None).when(F.col("id") % 30 == 2, "unknown")
    left = spark.range(0, 3000, 1, 12).select("id", key.otherwise(F.col("id").cast("string")).alias("k"))
    right = spark.range(3000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("v"))
    right = right.union(spark.createDataFrame([("hot", -1)], "k string, v long")).groupBy("k").agg(F.max("v").alias("v"))
    got = session_module.join_hot(left, right, ["k"], how)
    want = left.join(right, ["k"], how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hot_key_rows_go_to_many_tasks(spark, few_rows_are_hot):
    names = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("-1", "false")):
        spark.conf.set(n, v)
    try:
        left = spark.range(0, 3000, 1, 12).select("id", F.lit("hot").alias("video_id"))
        known = spark.createDataFrame([(1, "hot", "BR"), (2, "x", "US")], "seq long, video_id string, country_code string")
        got = lookups.lookup_country(left, known, ["seq"]).withColumn("task", F.spark_partition_id())
        rows = got.groupBy("task", "country_code").count().collect()
        assert sum(r["count"] for r in rows) == 3000 and {r["country_code"] for r in rows} == {"BR"}
        assert len(rows) > 1
    finally:
        for n, v in zip(names, before):
            spark.conf.set(n, v)


def test_exclude_signed_partitions_all(spark):
    rows = [(i, f"t{i % 40}", "c", None) for i in range(100)]
    df = spark.createDataFrame(rows, "seq long, title string, channelTitle string, publish_time string")
    taken = df.filter("seq < 10")
    got = {r["seq"] for r in lookups.exclude_signed(df, taken).collect()}
    assert got == {i for i in range(100) if i % 40 >= 10}


def test_candidates_without_text_or_country(spark):
    df = spark.createDataFrame([(i, "gold medal" if i % 2 else "none") for i in range(20)], "seq long, title string")
    assert candidates.keyword_candidates(df, ["gold"], ["nowhere"]).count() == 0
    got = candidates.capped_candidates(df, ["seq"], ["seq"], overall=4)
    assert sorted(r["seq"] for r in got.collect()) == [1, 3, 5, 7]


def test_labelling_samples(spark, skewed):
    texts = skewed.withColumns({"title": F.concat_ws(" ", "video_id", "seq"), "channelTitle": F.lit("c"),
                                "publish_time": F.lit(None).cast("string")})
    cands = texts.filter("day < 3")
    pos, neg = candidates.labelling_samples(cands, texts, ["seq"], 20, 30)
    pos, neg = groups(pos), groups(neg)
    ids = {r["seq"] for r in cands.collect()}
    assert all(len(v) == 20 and set(v) <= ids for v in pos.values())
    assert all(len(v) == 30 and not set(v) & ids for v in neg.values())
