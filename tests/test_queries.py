"""Every query with an SQL counterpart gives the same rows; the others run."""

import pytest

import __spark_entry__ as contract

QUERIES, SQL = contract.queries(), contract.oracle_sql()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())


def test_entry(spark):
    got = contract.entry(spark)
    assert got.columns == ["window", "centre", "width", "sports_pct"]
    assert 0 < got.count() <= 5


def test_models_converge(spark, sf):
    from trendlens.plans import models, queries

    table = models.fit(queries._full(spark, sf), *models.MODELS).collect()
    assert {r["model"] for r in table} == set(models.MODELS)
    assert all(r["converged"] for r in table)
    assert all(r["coef"] == 0 for r in table if r["dropped"])
    sweep = QUERIES["nb_rolling_sweep"](spark, sf).orderBy("rolling_window").collect()
    assert [r["rolling_window"] for r in sweep] == list(range(1, 22))
    assert all(r["converged"] for r in sweep)


def test_embedding_classifier(spark, sf):
    report = {r["class"]: r for r in QUERIES["embedding_classifier"](spark, sf).collect()}
    assert len(report) == 13
    assert report["accuracy"]["support"] == 100
