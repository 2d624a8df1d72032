import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from trendlens.functions import fixed
from trendlens.operators import classifier, countreg, features, sampling
from trendlens.operators.countreg import Category, Product
from trendlens.plans import models, queries, training
from trendlens.sources import sinks, views
from trendlens.plans.queries import _train_text


def newton(x, y, off, alpha=1.0):
    """Maximum of the negative-binomial likelihood by Newton steps on the score, one matrix in memory."""
    beta = np.zeros(x.shape[1])
    beta[0] = math.log(y.sum() / np.exp(off).sum())
    for _ in range(60):
        mu = np.exp(x @ beta + off)
        score = x.T @ ((y - mu) / (1 + alpha * mu))
        hess = (x * (mu * (1 + alpha * y) / (1 + alpha * mu) ** 2)[:, None]).T @ x
        beta = beta + np.linalg.solve(hess, score)
    return beta


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(5)
    n = 900
    pdf = pd.DataFrame({
        "country": rng.choice(["BR", "DE", "US"], n), "month": rng.integers(1, 5, n), "t": rng.integers(0, 2000, n),
        "during": rng.integers(0, 2, n), "nothing": 0, "videos": rng.integers(1, 80, n),
    })
    mean = pdf.videos * np.exp(-1 + 0.3 * pdf.during + 0.2 * (pdf.country == "US") - 0.0002 * pdf.t)
    pdf["y"] = rng.poisson(mean * rng.gamma(1.0, 1.0, n))
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


def dense(pdf):
    c = [(pdf.country == k).astype(float) for k in ("DE", "US")]
    m = [(pdf.month == k).astype(float) for k in (2, 3, 4)]
    names = ["Intercept", "during", "C(country)[T.DE]", "C(country)[T.US]", "t", "C(country)[T.DE]:t",
             "C(country)[T.US]:t", "C(month)[T.2]", "C(month)[T.3]", "C(month)[T.4]"]
    cols = [np.ones(len(pdf)), pdf.during, *c, pdf.t, c[0] * pdf.t, c[1] * pdf.t, *m]
    return names, np.column_stack(cols).astype(float)


def test_fit_matches_newton_and_sandwich(cells):
    pdf, df = cells
    terms = ["during", Product(Category("country"), "t"), Category("month")]
    got = {r["term"]: r for r in countreg.fit_counts(df, "y", {"m": terms}, exposure="videos").collect()}
    names, x = dense(pdf)
    assert set(got) == set(names)
    y, off = pdf.y.to_numpy(float), np.log(pdf.videos.to_numpy(float))
    beta = newton(x, y, off)
    mu = np.exp(x @ beta + off)
    bread = np.linalg.inv((x * (mu / (1 + mu))[:, None]).T @ x)
    s = (y - mu) / (1 + mu)
    h = np.einsum("ij,jk,ik->i", x, bread, x) * mu / (1 + mu)
    for key, resid in (("se_hc0", s), ("se_hc3", s / (1 - h))):
        xr = x * resid[:, None]
        se = np.sqrt(np.diag(bread @ (xr.T @ xr) @ bread))
        assert np.allclose([got[n][key] for n in names], se, rtol=1e-5)
    assert np.allclose([got[n]["coef"] for n in names], beta, rtol=1e-5, atol=1e-8)
    r = got["during"]
    assert r["converged"] and r["n"] == 900
    assert r["z"] == pytest.approx(r["coef"] / r["se_hc3"])
    assert r["p_value"] == pytest.approx(math.erfc(abs(r["z"]) / math.sqrt(2)))


def test_rows_are_folded_to_distinct_inputs(cells):
    pdf, df = cells
    cell = countreg.folded(df, "y", ["country", "month"]).toPandas().sort_values(["country", "month"])
    want = pdf.groupby(["country", "month"]).y.agg(["count", "mean", lambda v: ((v - v.mean()) ** 2).sum()]).to_numpy()
    assert len(cell) < len(pdf) / 5
    assert np.allclose(cell[["_n", "_mean", "_spread"]].to_numpy(float), want)


def test_main_models_match_a_dense_fit(spark, sf):
    """Coefficients and errors that the queries show, against Newton steps on the whole design of the small panel."""
    pdf = queries._full(spark, sf).toPandas()
    y, off = pdf.sports_videos.to_numpy(float), np.log(pdf.videos.to_numpy(float))
    shown = {(r["model"], r["term"]): r for r in queries.nb_coefficients(spark, sf).collect()}
    assert {m for m, _ in shown} == set(models.MODELS)

    def design(model):
        out = {"Intercept": np.ones(len(pdf))}
        for term in models.MODELS[model]:
            category = term if isinstance(term, Category) else getattr(term, "category", None)
            flags = {} if category is None else {
                f"C({category.column})[T.{v}]": (pdf[category.column] == v).to_numpy(float) for v in sorted(pdf[category.column].unique())[1:]}
            number = term if isinstance(term, str) else getattr(term, "number", None)
            out |= flags | ({number: pdf[number].to_numpy(float)} if number else {})
            if number and flags:
                out |= {f"{k}:{number}": v * pdf[number].to_numpy(float) for k, v in flags.items()}
        return {k: v for k, v in out.items() if np.any(v)}

    compared, met = [], 0
    for model in models.MODELS:
        x = design(model)
        names, x = list(x), np.stack(list(x.values()), axis=1)
        scale = np.append(1.0, np.sqrt((x ** 2).mean(axis=0))[1:])
        if np.linalg.matrix_rank(x / scale) < x.shape[1]:
            continue  # no single solution to compare with
        compared.append(model)
        beta = newton(x / scale, y, off)
        mu = np.exp(x / scale @ beta + off)
        bread = np.linalg.pinv((x / scale * (mu / (1 + mu))[:, None]).T @ (x / scale), hermitian=True)
        h = np.einsum("ij,jk,ik->i", x / scale, bread, x / scale) * mu / (1 + mu)
        jack = np.where(1 - h > 1e-10, (y - mu) / (1 + mu) / np.where(1 - h > 1e-10, 1 - h, 1), 0)
        xr = x / scale * jack[:, None]
        se = np.sqrt(np.diag(bread @ (xr.T @ xr) @ bread)) / scale
        for i, term in enumerate(names):
            r = shown[model, term]
            if max(abs(beta[i]) / scale[i], abs(r["coef"])) * np.abs(x[:, i]).max() > 15:
                continue  # a level without any sport video: the estimate has no end
            met += 1
            assert r["coef"] == pytest.approx(beta[i] / scale[i], rel=1e-4, abs=2e-6)
            assert r["se_hc3"] == pytest.approx(se[i], rel=1e-3, abs=2e-6)
            assert r["z"] == pytest.approx(r["coef"] / r["se_hc3"], rel=1e-2, abs=1e-2)
    assert {"base", "trend", "season"} <= set(compared) and met > 60
    rolled = {r["rolling_window"]: r for r in queries.nb_rolling_z(spark, sf).collect()}
    assert sorted(rolled) == list(range(1, 22))
    assert {r["model"] for r in queries.nb_predictors(spark, sf).collect()} == {"medal_count", "medal_score"}


def test_models_fitted_together_equal_single_fits(cells):
    _, df = cells
    several = {"a": ["during"], "b": ["during", Category("country")], "c": [Category("month"), "t"]}
    together = {(r["model"], r["term"]): r["coef"] for r in countreg.fit_counts(df, "y", several, "videos").collect()}
    for name, terms in several.items():
        for r in countreg.fit_counts(df, "y", {name: terms}, "videos").collect():
            assert together[name, r["term"]] == pytest.approx(r["coef"], rel=1e-6, abs=1e-9)


def test_empty_column_is_reported_and_nulls_left_out(spark, cells):
    _, df = cells
    holed = df.withColumn("country", F.when(F.col("month") != 4, F.col("country")))
    got = {r["term"]: r for r in countreg.fit_counts(holed, "y", {"m": ["nothing", Category("country")]}, "videos").collect()}
    assert got["nothing"]["dropped"] and got["nothing"]["coef"] == 0 and got["nothing"]["z"] is None
    assert not got["Intercept"]["dropped"]
    assert got["Intercept"]["n"] == df.filter("month <> 4").count()


def test_too_many_levels(cells):
    _, df = cells
    with pytest.raises(ValueError, match="more than"):
        countreg._levels(df, [Category("t")], max_levels=10)


def test_tfidf_rows_have_unit_length(spark):
    df = spark.createDataFrame([(1, "aa bb aa"), (2, "bb cc"), (3, "")], "id long, text string")
    got = features.tfidf(df, "id", "text", (1, 1), max_df=1.0)
    norms = got.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert {r["id"] for r in norms} == {1, 2} and all(r["s"] == pytest.approx(1) for r in norms)
    w = {(r["id"], r["term"]): r["weight"] for r in got.collect()}
    raw = [2 * (math.log(4 / 2) + 1), math.log(4 / 3) + 1]
    assert w[1, "aa"] == pytest.approx(raw[0] / math.hypot(*raw))


def test_pipeline_features_equal_the_table(spark):
    df = spark.createDataFrame([(1, "Aa bb aa dd"), (2, "bb cc x"), (3, "dd aa")], "id long, text string")
    fitted = classifier.fit_text_features(df, max_df=1.0)
    vocab = next(s for s in fitted.stages if hasattr(s, "vocabulary")).vocabulary
    ml = {(r["id"], vocab[i]): float(v) for r in fitted.transform(df).collect()
          for i, v in zip(r["features"].indices, r["features"].values)}
    table = {(r["id"], r["term"]): r["weight"] for r in features.tfidf(df, "id", "text", max_df=1.0).collect()}
    assert ml.keys() == table.keys()
    assert all(ml[k] == pytest.approx(table[k]) for k in ml)


def test_documents_of_one_row_are_counted_without_a_shuffle(spark):
    """Rows that share an id, or have none, still count as one document."""
    rows = [(1, "aa bb aa"), (2, None), (3, "")]
    more = [*rows, (4, "aa bb"), (4, "bb cc"), (None, "aa"), (None, "dd aa")]
    alone = features.term_counts(spark.createDataFrame(rows, "id long, text string"), "id", "text", (1, 2))
    assert "Exchange" not in alone._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, alone.collect())) == [(1, "aa", 2), (1, "aa bb", 1), (1, "bb", 1), (1, "bb aa", 1)]
    df = spark.createDataFrame(more, "id long, text string")
    got = {(r["id"], r["term"]): r["tf"] for r in features.term_counts(df, "id", "text", (1, 1)).collect()}
    assert got == {(1, "aa"): 2, (1, "bb"): 1, (4, "aa"): 1, (4, "bb"): 2, (4, "cc"): 1, (None, "aa"): 2, (None, "dd"): 1}
    weights = features.tfidf(df, "id", "text", (1, 1), max_df=1.0)
    norms = weights.groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("s")).collect()
    assert {r["id"] for r in norms} == {1, 4, None} and all(r["s"] == pytest.approx(1) for r in norms)


def test_descent_needs_few_passes():
    """A badly conditioned bowl: each pass is a run over all rows, so their number is what a fit costs."""
    rng = np.random.default_rng(3)
    scale, goal, passes = np.logspace(-5, 0, 60), rng.normal(size=60), 0

    def objective(x):
        nonlocal passes
        passes += 1
        return 0.5 * float(scale @ (x - goal) ** 2), scale * (x - goal)

    x, gradient, _ = classifier._descend(objective, np.zeros(60), 1e-9, 10_000)
    assert gradient <= 1e-9 and np.allclose(x, goal, atol=1e-3)
    assert passes < 1_600  # 1,294; with ten remembered steps 1,964


def test_row_vocabulary_equals_the_count_of_all_ngrams(spark):
    """Words, pairs and trigrams that the cap rules out are not counted; ties, nulls and capped shares come out the same."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{min(int(w), 90)}" for w in rng.zipf(1.4, size=rng.integers(0, 60))) for _ in range(120)]
    df = spark.createDataFrame([(t,) for t in [*texts, None, "", "x", "w1 w1 w1 w1", "Été w1 w2"]], "text string").repartition(3)
    n_docs = F.lit(df.count())
    for cap, min_df, max_df in ((150, 1, 0.5), (400, 2, 0.98)):
        got = features.row_vocabulary(df, "text", n_docs, cap, min_df, max_df)
        want = features.vocabulary(features.row_term_counts(df, "text"), n_docs, cap, min_df, max_df)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_row_vocabulary_without_numbers_or_pairs(spark, monkeypatch):
    """Too many words or pairs to be looked up: the whole count goes another way."""
    df = spark.createDataFrame([("a1 b1 c1 d1",), ("a1 b1 c1 e1",), ("b1 c1 d1",)], "text string")
    want = sorted(map(tuple, features.row_vocabulary(df, "text", F.lit(3), 6, 1, 1.0).collect()))
    assert len(want) == 6
    for limit in ("MAX_PAIRS", "MAX_WORDS"):
        monkeypatch.setattr(features, limit, 1)
        assert sorted(map(tuple, features.row_vocabulary(df, "text", F.lit(3), 6, 1, 1.0).collect())) == want


def _sparse_rows(spark, n=1500, width=400):
    """Rare and common features, one rare class: badly conditioned, as texts are."""
    rng, rows = np.random.default_rng(7), []
    for i in range(n):
        at = np.unique(np.minimum(rng.zipf(1.3, size=40) - 1, width - 1))
        val = rng.random(len(at)) + 0.1
        label = "rare" if i % 50 == 0 else "odd" if (at % 3 == 0).mean() > 0.45 else "even"
        rows.append((label, 20.0 if label == "rare" else 1.0, Vectors.sparse(width, at.tolist(), (val / np.linalg.norm(val)).tolist())))
    rows += [("odd", 1.0, Vectors.sparse(width, [], [])), ("even", 1.0, Vectors.dense([0.05] * width))]
    return spark.createDataFrame(rows, ["label", "weight", "features"]).repartition(3)


def test_fit_takes_few_passes(spark, monkeypatch):
    """Steps scaled by the curvature of some rows end at the same minimum after far fewer passes over all rows."""
    df, passes, gradient = _sparse_rows(spark), [0], classifier._gradient
    monkeypatch.setattr(classifier, "SAMPLE", 300)
    monkeypatch.setattr(classifier, "_gradient", lambda *a: passes.__setitem__(0, passes[0] + 1) or gradient(*a))
    model = classifier.fit_classifier(df, weight="weight")
    assert model.converged and passes[0] < 30  # 22; 42 without
    rows = [(r["label"], r["weight"], r["features"].toArray()) for r in df.collect()]
    names = sorted({r[0] for r in rows})
    x, w = np.array([[*r[2], 1.0] for r in rows]), np.array([r[1] for r in rows])
    own = np.eye(3)[[names.index(r[0]) for r in rows]]
    theta = np.column_stack([model.stages[0].coefficientMatrix.toArray(), model.stages[0].interceptVector.toArray()])
    p = np.exp(x @ theta.T)
    p /= p.sum(axis=1, keepdims=True)
    left = ((p - own) * w[:, None]).T @ x + theta * np.append(np.ones(theta.shape[1] - 1), 0)
    assert np.abs(left).max() / w.sum() <= 1.1e-7


def test_max_df_and_cap(spark):
    df = spark.createDataFrame([(i, f"common w{i % 3}") for i in range(9)], "id long, text string")
    counts = features.term_counts(df, "id", "text", (1, 1))
    assert {r["term"] for r in features.vocabulary(counts, F.lit(9)).collect()} == {"w0", "w1", "w2"}
    assert [r["term"] for r in features.vocabulary(counts, F.lit(9), max_features=2).orderBy("term").collect()] == ["w0", "w1"]


def test_training_rows(spark):
    rows = [(1, "v", "T ", "g", "d", " Olympic\n"), (2, "v", "T", "g", "e", "non_sport"), (3, None, "T", "g", None, "non_sport")]
    df = spark.createDataFrame(rows, "i long, video_id string, title string, tags string, description string, label string")
    got = training.training_rows(df, ["i"]).orderBy("i").collect()
    assert [(r["i"], r["label"], r["text"]) for r in got] == [(1, "olympic", "T  g d"), (3, "non_sport", "T g ")]
    with pytest.raises(Exception, match="null label"):
        training.training_rows(df.withColumn("label", F.lit(None).cast("string")), ["i"]).collect()


def test_text_classifier_end_to_end(spark, folder):
    words = {"olympic": "medal podium games", "other_sport": "goal match league", "non_sport": "song video music"}
    rows = [(i, label, f"{text} filler{i % 7}") for i, (label, text) in enumerate(list(words.items()) * 20)]
    df = spark.createDataFrame(rows, "id long, label string, text string")
    feats, model, valid = training.train_text_classifier(df, ["id"], target=30, max_iter=30)
    assert valid.filter("label <> predicted_label").count() == 0
    assert valid.count() == 6 + 4 + 4
    top = [r["term"] for r in classifier.top_features(feats, model, "olympic", 5).collect()]
    assert set(top) <= {"medal", "podium", "games", "medal podium", "podium games", "medal podium games"}
    sinks.save_model(feats, f"{folder}/features")
    sinks.save_model(model, f"{folder}/model")
    again = classifier.score(df.select("id", "text"), sinks.load_model(f"{folder}/features"), sinks.load_model(f"{folder}/model"))
    assert again.columns == ["id", "text", "predicted_label"] and again.count() == 60
    assert classifier.class_names(sinks.load_model(f"{folder}/model")) == sorted(fixed.LABELS)


def test_split_first_keeps_copies_apart(spark, sf):
    rows = _train_text(spark, sf).select("doc_id", "label", "text")
    parts = sampling.stratified_split(rows, "label", ["doc_id"])
    grown = sampling.resample_class(parts.filter("not is_test"), "label", "olympic", ["doc_id"], 60)
    assert grown.join(parts.filter("is_test"), "doc_id", "left_semi").count() == 0


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2, "label string")
    got = {r["label"]: r["weight"] for r in classifier.with_class_weights(df).distinct().collect()}
    assert got == {"a": pytest.approx(8 / 12), "b": pytest.approx(8 / 4)}


def test_views_are_keyed(spark, sf):
    v = views.videos(spark, sf)
    assert v.select(*views.ORDER).distinct().count() == v.count()
