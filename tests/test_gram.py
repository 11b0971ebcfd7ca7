import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from scoreloom.models import experiments, statistics, training
from scoreloom.models.gram import covariances, eliminate, gram, grams, subsets

FEATURES = [f"f{i}" for i in range(9)]


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(3)
    rows = []
    for i in range(500):
        x = [rng.gauss(50 * j, 1 + j) for j in range(9)]
        y = 1000 + sum((j % 4) * v for j, v in enumerate(x)) + rng.gauss(0, 5)
        rows.append((i, *[None if j == 0 and i % 7 == 0 else v for j, v in enumerate(x)], None if i % 50 == 0 else y))
    return spark.createDataFrame(rows, "i long, " + ", ".join(f"{f} double" for f in FEATURES) + ", y double").repartition(5).persist()


def test_twenty_subsets_equal_spark_ml(data):
    g = gram(data, FEATURES, "y")
    rng = random.Random(8)
    for _ in range(20):
        some = rng.sample(FEATURES, rng.randint(1, 9))
        fit = g.fit(some)
        model = Pipeline(stages=[training.assembler(some), LinearRegression(solver="normal", labelCol="y")]).fit(training.design(data, some, "y")).stages[-1]
        s = model.summary
        assert fit.coefficients == pytest.approx(model.coefficients.toArray(), rel=1e-8) and fit.intercept == pytest.approx(model.intercept, rel=1e-8)
        assert fit.r2 == pytest.approx(s.r2, rel=1e-8) and fit.n == s.numInstances
        assert fit.errors == pytest.approx(s.coefficientStandardErrors, rel=1e-6)
        assert fit.p_values == pytest.approx(s.pValues, abs=1e-8)
        terms = {t["name"]: t for t in fit.terms()}
        assert all(t["low"] < t["coef"] < t["high"] for t in terms.values())


def test_splits_in_one_pass_score_the_test_rows(data):
    by = grams(data, FEATURES, "y", F.col("i") < 350)
    some = FEATURES[1:6]
    fit = by[True].fit(some)
    model = Pipeline(stages=[training.assembler(some), LinearRegression(solver="normal", labelCol="y")]).fit(training.design(data.where("i < 350"), some, "y"))
    scored = model.transform(training.design(data.where("i >= 350"), some, "y"))
    from scoreloom.models.metrics import regression

    want = scored.agg(*regression("y", "prediction")).first()
    got = by[False].scores(fit)
    assert got["n"] == want.n and got["r2"] == pytest.approx(want.r2, rel=1e-8) and got["rmse"] == pytest.approx(want.rmse, rel=1e-8)
    rows = subsets(by[True], by[False], {"all": FEATURES, "some": some, "none of the strong": ["f0", "f4", "f8"]})
    assert [r["n_features"] for r in rows] == [9, 5, 3] and rows[0]["r2"] > 0.9 > rows[2]["r2"]


def test_elimination_drops_what_has_no_part(data):
    by = grams(data, FEATURES, "y", F.col("i") < 350)
    rounds = eliminate(by[True], by[False], drop=2, least=6)
    assert [len(r["features"]) for r in rounds] == [9, 7, 6] and rounds[-1]["dropped"] == []
    assert set(rounds[0]["dropped"]) | set(rounds[1]["dropped"]) == {"f0", "f4", "f8"}


def test_dependent_constant_and_no_rows(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 7.0, 3.0 * i + 1) for i in range(20)], "a double, b double, c double, y double")
    fit = gram(df, ["a", "b", "c"], "y").fit()
    assert fit.r2 == pytest.approx(1.0) and np.isfinite(fit.coefficients).all() and fit.coefficients[2] == 0
    assert fit.coefficients[0] + 2 * fit.coefficients[1] == pytest.approx(3.0)
    none = gram(df.where("false"), ["a"], "y")
    assert none.n == 0 and np.isnan(none.fit().r2)


def test_t_distribution():
    assert statistics.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-6)
    assert statistics.t_p_value(2.228139, 10) == pytest.approx(0.05, abs=1e-6)


def test_covariances(data):
    got = {(r.a, r.b): r for r in covariances(data.where("y is not null").fillna(0.0), ["f1", "f2", "y"]).collect()}
    full = data.where("y is not null").fillna(0.0)
    assert got["f1", "y"].covariance == pytest.approx(full.agg(F.covar_samp("f1", "y")).first()[0])
    assert len(got) == 6


@pytest.mark.parametrize("n", [1, 2, 3, 7, 240])
def test_deals_are_permutations(n):
    for _, _, a, b in experiments.deals(n, 3, 4, 1):
        assert sorted((a * i + b) % n for i in range(n)) == list(range(n))


def test_importance_equals_a_brute_force_shuffle(data):
    some = ["f1", "f2", "f4"]
    test = data.where("i >= 300")
    model = Pipeline(stages=[training.assembler(some), RandomForestRegressor(numTrees=5, maxDepth=3, labelCol="y", seed=1)]).fit(training.design(data.where("i < 300"), some, "y"))
    got = {r.feature: r for r in experiments.permutation_importance(model, test, some, "y", "i", repeats=3, seed=5).collect()}
    base = training.design(test, some, "y")
    rows = sorted(experiments.numbered(base, "i", 5).collect(), key=lambda r: r["__i"])
    n = len(rows)
    assert [r["__i"] for r in rows] == list(range(n))
    spark = test.sparkSession

    def r2(columns):
        df = spark.createDataFrame([(r.y, *[c[k] for c in columns]) for k, r in enumerate(rows)], "y double, __x_0 double, __x_1 double, __x_2 double")
        p = [(r.y, r.prediction) for r in model.transform(df).collect()]
        mean = sum(y for y, _ in p) / n
        return 1 - sum((y - q) ** 2 for y, q in p) / sum((y - mean) ** 2 for y, _ in p)

    x = [[r[f"__x_{i}"] for r in rows] for i in range(3)]
    whole, losses = r2(x), {}
    for f, _, a, b in experiments.deals(n, 3, 3, 5):
        dealt = [None] * n
        for i in range(n):
            dealt[(a * i + b) % n] = x[f][i]
        losses.setdefault(some[f], []).append(whole - r2([dealt if j == f else c for j, c in enumerate(x)]))
    for f in some:
        assert got[f]["mean"] == pytest.approx(np.mean(losses[f])) and got[f]["std"] == pytest.approx(np.std(losses[f], ddof=1))
    assert experiments.permutation_importance(model, test.where("false"), some, "y", "i").collect() == []
