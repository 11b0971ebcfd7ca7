"""Small operators by value: selection, missing numbers, reads, payloads, folds, groups left out."""

import datetime as dt
import random

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F

from scoreloom import semantics as sem
from scoreloom.functions import text as tx
from scoreloom.models import experiments, metrics, training
from scoreloom.operators import aggregates, decisions, teams, windows
from scoreloom.plans import features, payloads, reads
from scoreloom.sources import archive


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_missing_numbers(spark):
    df = spark.createDataFrame([(1, float("nan"), 2.5), (2, 1.0, None)], "i int, x double, y double")
    assert rows(sem.nan_to_null(df)) == [(1, None, 2.5), (2, 1.0, None)]
    assert rows(df.select(archive.nan_free(F.col("x")))) == [(None,), (1.0,)]
    halves = spark.createDataFrame([(0.125,), (0.135,), (0.115,)], "x double")
    assert float(halves.agg(sem.exact_mean("x", 2)).first()[0]) == 0.13
    top = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 3, "w"), ("b", 0, "z")], "k string, n int, v string")
    assert sorted(rows(sem.top_one(top, ["k"], [F.col("n").desc(), F.col("v")]))) == [("a", 3, "w"), ("b", 0, "z")]


def test_hash_uniform_equals_plain_arithmetic(spark):
    def u(seed, a, b):
        x = (a % sem.PRIME * sem.FACTORS[0] + b % sem.PRIME * sem.FACTORS[1] + seed) % sem.PRIME
        for step in sem.STEPS:
            x = (x * x + step) % sem.PRIME
        return x / sem.PRIME

    df = spark.range(0, 3_000_000_000, 7_000_003).select("id", sem.hash_uniform(42, F.col("id"), F.col("id") % 977).alias("u"))
    got = df.collect()
    assert all(r.u == u(42, r.id, r.id % 977) for r in got)
    assert 0.45 < sum(r.u for r in got) / len(got) < 0.55


def test_draws_and_bootstrap_by_hand(spark):
    squad = spark.createDataFrame([("s", 7, 2, 1.0, 3.0, 9.0), ("s", 8, 1, None, 4.0, None)], "g string, player long, multiplier int, floor double, median double, ceiling double").withColumn("predicted", F.lit(4.0))
    got = {r.draw: r.total for r in decisions.simulate(squad, ["g"], "player", draws=50).collect()}
    u = {(r.p, r.d): r.u for r in spark.range(1, 51).select(F.explode(F.array(F.lit(7), F.lit(8))).alias("p"), F.col("id").alias("d")).select("p", "d", sem.hash_uniform(42, F.col("p"), F.col("d")).alias("u")).collect()}

    def points(lo, mid, hi, x):
        return max(0.0, lo if x < 0.1 else lo + (mid - lo) * (x - 0.1) / 0.4 if x < 0.5 else mid + (hi - mid) * (x - 0.5) / 0.4)

    assert all(t == pytest.approx(2 * points(1, 3, 9, u[7, d]) + points(0, 4, 4, u[8, d])) for d, t in got.items()) and len(got) == 50
    shares = [sum(cut > x for x in u.values()) for cut in metrics.poisson_cuts()]
    weights = {r.w for r in spark.range(400).select(metrics.replicate_weight(1, F.lit(3), F.col("id")).alias("w")).collect()}
    assert shares == sorted(shares) and weights >= {0, 1, 2, 3}


def test_reads(spark):
    names = spark.createDataFrame([("A",), ("B",), ("C",), ("A",)], "web_name string")
    players = spark.createDataFrame([("A", 1), ("B", 2), ("B", 3)], "web_name string, player_code long")
    assert sorted(rows(reads.codes_of(names, players))) == [("A", 1), ("B", None), ("C", None)]
    weeks = spark.createDataFrame([(1, "s", 2, 50), (1, "s", 1, 40), (2, "s", 1, 30), (1, "t", 1, 20)], "entry_id int, season string, event_id int, points int")
    assert [r.points for r in reads.manager_history(weeks, "s", 1).collect()] == [50, 40]
    assert [r.points for r in reads.manager_history(weeks, "s", 1, newest_first=False).collect()] == [40, 50]
    rolling = spark.createDataFrame([("s", 1, 2, 5.0), ("s", 2, 2, 6.0), ("s", 3, 1, 9.0)], "season string, player_code long, event_id int, rolling double")
    weighted = spark.createDataFrame([("s", 1, 4.0), ("s", 2, None), ("s", 3, 8.0)], "season string, player_code long, weighted_form double")
    assert [(r.player_code, r.weighted_form) for r in reads.form_leaders(rolling, weighted).collect()] == [(1, 4.0), (2, None)]
    at = dt.datetime(2024, 1, 1)
    fixtures = spark.createDataFrame([(9, "s", 1, at, 10, 20, 2, 1, True, "x"), (8, "t", 1, at, 10, 20, 2, 1, True, "x")], "fpl_fixture_id int, season string, event_id int, kickoff_time timestamp, team_h_code int, team_a_code int, team_h_score int, team_a_score int, finished_provisional boolean, more string")
    assert rows(reads.season_fixtures(fixtures, "s")) == [(9, 1, at, 10, 20, 2, 1, True)]


def test_browser_and_page(spark):
    df = spark.createDataFrame([(1, "A", "MID", "T", 4.25, 5.0, 0.123, 10.0, "a"), (2, "B", "MID", "T", None, 0.0, None, 50.0, "a"), (3, "C", "DEF", "T", 6.35, 4.0, 0.5, 5.0, "i"), (4, "D", "MID", "T", 6.0, 0.0, 0.5, 5.0, "a")], "player_code long, web_name string, position string, team string, predicted_points double, price double, haul_probability double, ownership double, status string")
    assert [r.player_code for r in payloads.browse(df).collect()] == [3, 4, 1, 2]
    assert [r.player_code for r in payloads.browse(df, position="MID", least=4.0, most_owned=20.0, available=True).collect()] == [4, 1]
    assert [r.player_code for r in payloads.browse(df, sort="price", top=2).collect()] == [1, 3]
    page = payloads.players_page(df).collect()
    assert [(r.player_code, r.predicted, r.price, r.haul, r.value) for r in page] == [(4, 6.0, 0.0, 50, None), (1, 4.2, 5.0, 12, 0.85)]


def test_snapshots_and_reshapes(spark):
    log = archive.raw_snapshot(spark.createDataFrame([('{"a": [1, 2]}',), ("no json",)], "payload string"), "live", "s")
    assert rows(log.select("endpoint", "season", F.try_variant_get("payload", "$.a[1]", "int"))) == [("live", "s", 2), ("live", "s", None)]
    df = spark.createDataFrame([(1, "x", "y")], "k int, captain string, vice string")
    assert rows(teams.points_to_rows(df, ["k"], ["captain", "vice"])) == [(1, "captain", "x"), (1, "vice", "y")]
    form = spark.createDataFrame([("s", "t", i, float(v)) for i, v in enumerate([4, 2, 6])] + [("s", "u", 0, 8.0)], "season string, team string, at int, v double")
    out = form.withColumn("f", windows.first_then_mean(form, ["season", "team"], ["at"], "v", ["season"], n=2))
    assert sorted((r.team, r["at"], r.f) for r in out.collect()) == [("t", 0, 5.0), ("t", 1, 4.0), ("t", 2, 3.0), ("u", 0, 5.0)]
    panel = spark.createDataFrame([("s", 1, 1, 5.0, 90.0), ("s", 1, 2, 7.0, 80.0), ("s", 2, 1, 1.0, 10.0)], "season string, element int, GW int, total_points double, minutes double")
    got = sorted(rows(features.next_week_rows(panel)))
    assert got == sorted([*rows(panel), ("s", 1, 3, 0.0, 0.0), ("s", 2, 2, 0.0, 0.0)])


def test_relabelled(spark):
    df = spark.createDataFrame([(1, "GK", 9), (4, "AM", 8), (None, None, 7)], "element_type int, pos string, n int")
    out = archive.relabelled(df, {"n": "points"}, {"element_type": archive.POSITION_NAMES, "pos": archive.POSITION_NAMES})
    assert out.columns == ["element_type", "pos", "points"] and rows(out) == [("GKP", "GKP", 9), ("FWD", "AM", 8), (None, None, 7)]


def test_texts_and_times(spark):
    df = spark.createDataFrame([("abcdef",), ("abc",), ("ab cdef",), (None,)], "s string")
    assert [r[0] for r in df.select(tx.shortened(F.col("s"), 4)).collect()] == ["abc…", "abc", "ab…", None]
    at = spark.createDataFrame([(dt.datetime(2024, 7, 1, 12),), (dt.datetime(2024, 1, 1, 23, 30),)], "t timestamp")
    assert [r[0] for r in at.select(tx.shown_at(F.col("t"), "Europe/London", "d MMM HH:mm")).collect()] == ["1 Jul 13:00", "1 Jan 23:30"]


def test_squad_problems(spark):
    shape = {"GKP": 1, "DEF": 2}
    squads = [("ok", 1, "GKP", "T", 5.0), ("ok", 2, "DEF", "T", 5.0), ("ok", 3, "DEF", "U", 5.0), ("bad", 1, "GKP", "T", 9.0), ("bad", 1, "GKP", "T", 9.0)]
    got = dict(rows(aggregates.squad_problems(spark.createDataFrame(squads, "group string, player long, position string, team string, price double"), shape, 15.0, limit=2)))
    assert got == {"ok": [], "bad": ["2 players, not 3", "2 GKP, not 1", "0 DEF, not 2", "a player more than once", "costs 18.0, more than 15.0"]}


def learnable(spark, n=400):
    rng = random.Random(4)
    data = []
    for i in range(n):
        a, b = rng.gauss(0, 1), rng.gauss(0, 1)
        data.append((i, f"s{i % 4}", a, b, 3 * a + 0.2 * b + rng.gauss(0, 0.5), float(a > 0) * 90))
    return spark.createDataFrame(data, "i long, season string, a_roll3 double, pos_b double, y double, minutes double")


def test_folds_classifiers_and_groups(spark):
    df = learnable(spark)
    names = ["a_roll3", "pos_b"]
    kinds = {"linear": LinearRegression(solver="normal", labelCol="y")}
    folds = [(["s0"], "s1"), (["s0", "s1"], "s2"), (["s0", "s1", "s2"], "s3")]
    out = training.walk_forward(df, "season", folds, lambda d, is_train: training.fit_regressors(d, names, "y", "minutes", is_train, kinds)[1])
    got = {(r.fold, r.model): r for r in out.collect()}
    assert set(got) == {(k, m) for k in (1, 2, 3) for m in ("baseline", "linear")} and {r.n for r in got.values()} == {100}
    assert all(got[k, "linear"].r2 > 0.9 > got[k, "baseline"].r2 for k in (1, 2, 3))
    auc = training.fit_classifiers(df, names, "y", 1.0, F.col("i") < 300, {"logistic": LogisticRegression(weightCol="weight")}).first()
    test = [r for r in df.where("i >= 300").collect()]
    assert auc.auc > 0.95 and auc.base_rate == pytest.approx(sum(r.y >= 1.0 for r in test) / len(test)) and auc.brier < 0.15
    left = {r.left_out: r for r in experiments.leave_groups_out(df, names, "y", "i", F.col("i") < 300, lambda: LinearRegression(solver="normal", labelCol="y"), draws=40).collect()}
    assert set(left) == {"all", "form_3", "position"}
    assert left["form_3"].delta < -0.5 and left["form_3"].p_value == 0.0 and abs(left["position"].delta) < 0.05
    segment = {r.segment: (r.n, r.rate) for r in metrics.calibration_by_segment(df.withColumn("p", F.lit(0.0)), "y", "p", "minutes").collect()}
    every = df.collect()
    for name, mine in (("starter", [r.y for r in every if r.minutes >= 75]), ("other", [r.y for r in every if r.minutes < 75])):
        assert segment[name] == (len(mine), pytest.approx(sum(v <= 0 for v in mine) / len(mine)))
    forest = Pipeline(stages=[training.assembler(names), RandomForestRegressor(numTrees=5, labelCol="y", seed=1)]).fit(training.design(df, names, "y"))
    told = experiments.impurity_importances(forest, names)
    assert told[0][0] == "a_roll3" and sum(v for _, v in told) == pytest.approx(1.0)


def test_best_model(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    ledger = spark.createDataFrame([("a", "y", 2.0, "p", t(1)), ("b", "y", 1.0, "p", t(1)), ("c", "y", 1.0, "p", t(2)), ("d", "y", 0.5, None, t(3)), ("e", "z", 0.1, "p", t(3)), ("f", "y", None, "p", t(4))], "run_id string, target string, rmse double, artifact_path string, trained_at timestamp")
    assert training.best_model(ledger, "y", "rmse").first().run_id == "c"
