import datetime as dt

import pytest
from pyspark.sql import functions as F

from trendlens.operators import evaluation, events, metrics, rollup, windows
from trendlens.plans import panel as plans

D = dt.date


def frame(spark, days, **cols):
    rows = [(d, *[c[i] for c in cols.values()]) for i, d in enumerate(days)]
    return spark.createDataFrame(rows, "date_clean date" + "".join(f", {c} {'string' if isinstance(v[0], str) else 'long'}" for c, v in cols.items()))


def test_trim_is_strictly_later(spark):
    days = [D(2020, 8, 1), D(2020, 8, 15), D(2020, 8, 16)]
    df = frame(spark, days, videos=[1, 2, 3])
    assert [r["videos"] for r in plans.trimmed_published(df).collect()] == [3]


def test_trim_trending_by_rows_and_days(spark):
    days = [D(2020, 8, 1) + dt.timedelta(n) for n in range(12)]
    df = frame(spark, days, video_id=[f"v{n:02d}" for n in range(12)], country_code=["X"] * 12)
    assert sorted(r["video_id"] for r in plans.trimmed_first_rows(df).collect()) == ["v10", "v11"]
    assert sorted(r["video_id"] for r in plans.trimmed_first_days(df).collect()) == ["v10", "v11"]
    with pytest.raises(ValueError):
        plans.create_panel(df, ["video_id"], date_type="trending", trim_by="weeks")


def test_panel_from_text_times(spark):
    rows = [("v1", "BR", "2021-01-01T10:00:00Z", "non_sport", 0), ("v1", "BR", "2021-01-01T10:00:00Z", "olympic", 1),
            ("v2", "BR", "2021-01-20T23:59:59Z", None, 2), ("v3", None, "2021-01-20T00:00:00Z", "olympic", 3)]
    df = spark.createDataFrame(rows, "video_id string, country_code string, publishedAt string, predicted_label string, ingest_seq long")
    once = plans.create_panel(df, ["ingest_seq"]).collect()
    assert [(r["country_code"], r["date_clean"], r["videos"], r["sports_videos"], r["olympic_videos"]) for r in once] == [
        ("BR", D(2021, 1, 20), 1, 1, 0)]
    twice = plans.create_panel(df, ["ingest_seq"], duplicates=True).orderBy("date_clean").collect()
    assert [r["videos"] for r in twice] == [2, 1]


def test_event_window_edges(spark):
    start, end = D(2021, 7, 24), D(2021, 8, 8)
    medals = frame(spark, [end, start], medal_code=[1, 2])
    near = [start - dt.timedelta(8), start - dt.timedelta(7), start - dt.timedelta(1), start, end,
            end + dt.timedelta(1), end + dt.timedelta(7), end + dt.timedelta(8), end + dt.timedelta(22)]
    df = frame(spark, near, videos=list(range(9)))
    got = events.with_event_windows(df, events.span(medals), "s").orderBy("videos").collect()
    assert [r["s_week_minus_1"] for r in got] == [0, 1, 1, 0, 0, 0, 0, 0, 0]
    assert [r["s_during"] for r in got] == [0, 0, 0, 1, 1, 0, 0, 0, 0]
    assert [r["s_week_plus_1"] for r in got] == [0, 0, 0, 0, 0, 1, 1, 0, 0]
    assert [r["s_week_plus_2"] for r in got] == [0, 0, 0, 0, 0, 1, 1, 1, 0]
    timed = events.with_event_time(df, events.span(medals), "s").orderBy("videos").collect()
    assert [r["event_time_s"] for r in timed][:5] == [-8, -7, -1, 0, 15]


def test_event_bars_are_disjoint(spark):
    start = D(2021, 7, 24)
    medals = frame(spark, [start, start + dt.timedelta(15)], medal_code=[1, 1])
    days = [start + dt.timedelta(n) for n in range(-9, 40)]
    df = frame(spark, days, sports_pct=list(range(49)))
    timed = events.with_event_time(df, events.span(medals), "s")
    bars = {r["window"]: r for r in events.event_bars(timed, events.span(medals), "event_time_s").collect()}
    assert {k: (r["centre"], r["width"]) for k, r in bars.items()} == {
        "Week −1": (-4.0, 7), "During": (7.5, 16), "Week +1": (19.0, 7), "Week +2": (26.0, 7), "Week +3": (33.0, 7)}
    assert bars["Week −1"]["sports_pct"] == 5.0
    assert events.event_line(timed, events.span(medals), "event_time_s").count() == 44


def test_medals(spark):
    df = spark.createDataFrame(
        [(D(2021, 8, 1), "ROC", 1), (D(2021, 8, 1), "RUS", 2), (D(2021, 8, 1), "JPN", None), (None, "JPN", 1)],
        "date_clean date, country_code string, medal_code int")
    daily = {r["country_code_iso3"]: (r["gold"], r["silver"], r["bronze"]) for r in rollup.daily_medals(df).collect()}
    assert daily == {"RUS": (1, 1, 0), "JPN": (0, 0, 0)}
    cells = spark.createDataFrame([(D(2021, 8, 1), "RUS"), (D(2021, 8, 2), "RUS"), (D(2021, 8, 1), None)],
                                  "date_clean date, country_code_iso3 string")
    got = rollup.with_medals(cells, rollup.daily_medals(df)).orderBy("country_code_iso3", "date_clean").collect()
    assert [(r["medal_count"], r["medal_score"]) for r in got] == [(0, 0), (2, 5), (0, 0)]


def test_rows_not_days_are_lagged(spark):
    df = frame(spark, [D(2021, 1, 1), D(2021, 1, 9), D(2021, 1, 10)], country_code=["A"] * 3, medal_count=[1, 2, 4])
    got = windows.with_rolling_sums(windows.with_lags(df), widths=range(1, 4)).orderBy("date_clean").collect()
    assert [r["medal_count_lag1"] for r in got] == [0, 1, 2]
    assert [r["medal_count_lag7"] for r in got] == [0, 0, 0]
    assert [r["rolling_medals_1"] for r in got] == [1, 2, 4]
    assert [r["rolling_medals_3"] for r in got] == [1, 3, 7]


def test_counts_with_nulls(spark):
    df = spark.createDataFrame([("v", "A"), ("v", None), (None, "A"), ("v", "A")], "video_id string, country_code string")
    assert tuple(rollup.record_counts(df).first()) == (2, 3, 4)
    shares = {r["country_code"]: r["share"] for r in rollup.value_counts(df, "country_code").collect()}
    assert shares == {"A": 1.0}
    assert rollup.null_counts(df, ["video_id"]).first()[0] == 1


def test_report_and_confusion(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] * 2 + [("c", "b")]
    df = spark.createDataFrame(pairs, "label string, p string")
    report = {r["class"]: r for r in evaluation.classification_report(df, "label", "p").collect()}
    assert (report["a"]["precision"], report["a"]["recall"], report["a"]["support"]) == (1.0, 0.75, 4)
    assert (report["c"]["precision"], report["c"]["f1"]) == (0.0, 0.0)
    assert report["accuracy"]["precision"] == pytest.approx(5 / 7)
    assert report["macro avg"]["recall"] == pytest.approx((0.75 + 1 + 0) / 3)
    assert report["weighted avg"]["recall"] == pytest.approx(5 / 7)
    table = evaluation.confusion(df, "label", "p", ["d", "c", "b", "a"]).collect()
    assert [tuple(r) for r in table] == [("a", 3, 1, 0, 0), ("b", 0, 2, 0, 0), ("c", 0, 1, 0, 0), ("d", 0, 0, 0, 0)]


def test_observed_metrics(spark, folder):
    df, seen = metrics.observed(spark.range(100), rows=F.count(F.lit(1)), even=F.sum((F.col("id") % 2 == 0).cast("int")))
    df.write.parquet(f"{folder}/out")
    assert metrics.metrics_frame(df, seen).first().asDict() == {"rows": 100, "even": 50}


@pytest.mark.parametrize("size", [21, 50, 10 ** 6])
def test_long_series_is_cut_in_blocks(spark, size):
    """One country holds nearly all rows; blocks with a halo give what one window over the series gives."""
    rows = [("hot" if i % 40 else f"c{i % 3}", i, (i * 7919) % 13 - 3 if i % 11 else None) for i in range(700)] + [(None, 3, 1), (None, 9, 2)]
    panel = spark.createDataFrame(rows, "country_code string, date_clean int, n int")
    done = windows.with_rolling_sums(windows.with_lags(panel, "n", 7, size), "n", range(1, 22), "sum", size)
    series, want = {}, {}
    for country, day, n in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        before = series.setdefault(country, [])
        lags = [(before[-k] if len(before) >= k else None) or 0 for k in range(1, 8)]
        before.append(n)
        sums = [[x for x in before[-t:] if x is not None] for t in range(1, 22)]
        want[country, day] = (n, *lags, *(sum(x) if x else None for x in sums))
    assert {(r.country_code, r.date_clean): tuple(r)[2:] for r in done.collect()} == want
    assert done.count() == len(rows)
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert all("_block" in line for line in plan.splitlines() if line.strip(" +-:").startswith("Window"))
