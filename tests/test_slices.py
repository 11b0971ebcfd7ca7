"""Windows on a key with a third of all rows: cut in slices they give what plain windows give."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import asof, intervals, slices, teams, windows
from scoreloom.operators.slices import Line
from scoreloom.semantics import DAY_US

N = 900


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(1)
    rows = []
    for i in range(N):
        key = rng.choice([None, "b", "c", "d"]) if i % 3 else "hot"
        at = dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(3000)) if rng.random() > 0.02 else None
        rows.append((i, key, at, rng.choice([None, *range(100)]), rng.random() < 0.3))
    return spark.createDataFrame(rows, "id long, key string, ts timestamp, value long, hit boolean").withColumn("value", F.col("value") / 4).persist()


def both(monkeypatch, make):
    """Rows of ``make`` by plain windows and in slices."""
    plain = sorted(map(tuple, make().collect()), key=repr)
    monkeypatch.setattr(slices, "SLICE_ROWS", 30)
    monkeypatch.setattr(slices, "LEAST_BYTES", 0)
    cut = make()
    got = sorted(map(tuple, cut.collect()), key=repr)
    assert len(got) == len(plain)
    for g, w in zip(got, plain):
        assert g == pytest.approx(w, nan_ok=True) if not any(isinstance(x, (dt.datetime, type(None), str)) for x in w) else all(a == b or a == pytest.approx(b) for a, b in zip(g, w))
    return cut


def test_slices_are_small(spark, events, monkeypatch):
    monkeypatch.setattr(slices, "SLICE_ROWS", 30)
    monkeypatch.setattr(slices, "LEAST_BYTES", 0)
    line = Line(events, ["key"], ["ts", "id"])
    sizes = line.df.groupBy(*line.by).agg(F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")).collect()
    assert sum(r.n for r in sizes) == N and max(r.n for r in sizes) < N / 10
    hot = sorted((r for r in sizes if r.key == "hot" and r.lo), key=lambda r: r.lo)
    assert len(hot) > 5 and all(a.hi < b.lo for a, b in zip(hot, hot[1:]))
    assert [r["__slice"] for r in hot] == sorted(r["__slice"] for r in hot)
    assert line.done().columns == events.columns


def test_small_inputs_stay_whole(events):
    line = Line(events, ["key"], ["ts", "id"])
    assert not line.cut and line.by == ["key"]


ORDER = ["ts", "id"]
MAKERS = {
    "rolling": lambda e: windows.rolling_form(e, ["key"], ORDER, "value"),
    "rolling exact": lambda e: windows.rolling_form(e, ["key"], ORDER, "value", exact=4),
    "leakfree": lambda e: windows.leakfree_form(e, ["key"], ORDER, "value", exact=4),
    "rate": lambda e: windows.prior_rate(e, ["key"], ORDER, "value", "id", "rate"),
    "weighted": lambda e: windows.weighted_form(e, ["key"], ORDER, "value"),
    "deltas": lambda e: windows.deltas(e, ["key"], ORDER, ["value"]),
    "congestion": lambda e: windows.congestion(e, ["key"], "ts", ["id"], 9, idle=14.0),
    "total": lambda e: windows.running_total(e, ["key"], ORDER, "value"),
    "strict": lambda e: asof.strict_history(e, e.where("hit"), ["key"], "ts", "ts", ["id"]),
    "latest": lambda e: asof.latest_at(e, e.where("hit").withColumnRenamed("id", "eid"), ["key"], "ts", "ts", ["eid"], ["value", "eid"], ["id"]),
    "within": lambda e: asof.count_within(e, ["key"], "ts", F.col("hit"), 7 * DAY_US),
    "intervals": lambda e: intervals.open_intervals(e.where("ts is not null"), e.where("ts is not null").withColumn("until", F.col("ts") + F.expr("make_interval(0, 0, 0, id % 20)")), ["key"], "ts", "ts", "until", ["id"]),
}


@pytest.mark.parametrize("name", MAKERS)
def test_equal_to_plain_windows(events, monkeypatch, name):
    cut = both(monkeypatch, lambda: MAKERS[name](events))
    assert "__slice" in cut._jdf.queryExecution().optimizedPlan().toString()


def test_team_form(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, f"T{rng.choice([1, 1, 2, 3])}", i // 2, rng.randrange(5), rng.randrange(5)) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, team string, kickoff long, scored int, conceded int")
    both(monkeypatch, lambda: teams.team_form(df, ["team"], ["kickoff", "id"]))


def test_slices_with_fewer_rows_than_the_frame(spark, monkeypatch):
    """Cuts at every value: each slice has a row or two, and frames of five rows reach over several."""
    monkeypatch.setattr(slices, "SLICE_ROWS", 2)
    monkeypatch.setattr(slices, "LEAST_BYTES", 0)
    df = spark.createDataFrame([(i, "k", float(i * i % 17)) for i in range(40)], "at long, key string, value double")
    got = {r.at: r.form_5 for r in windows.rolling_form(df, ["key"], ["at"], "value").collect()}
    values = [float(i * i % 17) for i in range(40)]
    assert all(got[i] == pytest.approx(sum(values[max(0, i - 4) : i + 1]) / min(5, i + 1)) for i in range(40))
