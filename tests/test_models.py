import random

import pytest
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from scoreloom.models import backtest, experiments, metrics, statistics, training


def test_f_distribution():
    assert statistics.f_p_value(4.1028, 2, 10) == pytest.approx(0.05, abs=1e-4)
    assert statistics.f_p_value(0.0, 2, 10) == 1.0
    assert statistics.incomplete_beta(2, 3, 0.5) == pytest.approx(0.6875)


def frame(spark, n=600):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)
        rows.append((i, a, b, c, 0.5 * a + 0.3 * b + rng.gauss(0, 0.3), None if i % 7 == 0 else a))
    return spark.createDataFrame(rows, "i long, a_roll3 double, b_roll5 double, pos_c double, y double, base double")


FEATURES = ["a_roll3", "b_roll5", "pos_c"]


def test_fits_diagnostics_and_groups(spark):
    df = frame(spark)
    kinds = {"linear_regression": LinearRegression(solver="normal", labelCol="y")}
    models, table = training.fit_regressors(df, FEATURES, "y", "base", F.col("i") < 400, kinds)
    r2 = {r.model: r.r2 for r in table.collect()}
    assert r2["linear_regression"] > 0.7 > r2["baseline"]
    d = {t["name"]: t for t in experiments.ols_diagnostics(df, FEATURES, "y")["terms"]}
    assert d["a_roll3"]["p_value"] < 0.01 and d["a_roll3"]["low"] < 0.5 < d["a_roll3"]["high"]
    assert experiments.group_features(FEATURES) == {"form_3": ["a_roll3"], "form_5": ["b_roll5"], "position": ["pos_c"]}
    imp = {r.feature: r["mean"] for r in experiments.permutation_importance(models["linear_regression"], df.where("i >= 400"), FEATURES, "y", "i", repeats=2).collect()}
    assert imp["a_roll3"] > imp["b_roll5"] > imp["pos_c"]


def test_backward_elimination_keeps_the_strong():
    strength = {f"f{i}": float(i) for i in range(20)}
    rounds = experiments.backward_elimination(lambda fs: (sum(strength[f] for f in fs), strength), list(strength))
    assert [len(r[0]) for r in rounds] == [20, 16, 12, 8]
    assert set(rounds[-1][0]) == {f"f{i}" for i in range(12, 20)}


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, p double")
    r = metrics.auc_brier(df, "y", "p").first()
    assert r.auc == pytest.approx(0.75) and r.brier == pytest.approx((0.01 + 0.16 + 0.4225 + 0.04) / 4)
    q = spark.createDataFrame([(3.0, 1.0, 2.0)], "a double, b double, c double").select(*metrics.sorted_quantiles("a", "b", "c")).first()
    assert tuple(q) == (1.0, 2.0, 3.0)
    curve = metrics.calibration_curve(spark.range(1000).select((F.col("id") / 1000).alias("p"), (F.col("id") >= 500).cast("int").alias("y")), "y", "p").orderBy("bin").collect()
    assert len(curve) == 10 and curve[0].positive_rate == 0 and curve[-1].positive_rate == 1


def test_backtest(spark):
    rng = random.Random(6)
    rows, pid = [], 0
    for team in range(8):
        for p, n in (("GKP", 1), ("DEF", 2), ("MID", 2), ("FWD", 1)):
            for _ in range(n):
                pid += 1
                price, skill = rng.randrange(8, 14) / 2, rng.random() * 6
                for gw in (2, 3, 4):
                    rows.append((gw, pid, p, f"T{team}", price, skill + rng.random() * (gw == 3) * 6, skill + rng.random()))
    weeks = spark.createDataFrame(rows, "gw int, player long, position string, team string, price double, predicted double, actual double")
    out = backtest.run_backtest(weeks, budget=90.0).persist()
    assert out.count() == 9
    t = backtest.summarise(out).first()
    assert t.static_oracle >= t.static
    first = {r.points for r in out.where("gw = 2 and policy <> 'static_oracle'").collect()}
    assert len(first) == 1
