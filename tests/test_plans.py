"""What Spark sends to every task: not players' seasons or weeks, whose size the bytes of their file don't tell."""

import pytest

from scoreloom import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["ownership_movers", "player_totals", "live_rows", "net_transfers"])
def test_players_and_seasons_are_merged(spark, name):
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") >= 2


def test_weeks_are_merged_with_squads(spark):
    plan = catalogue.queries()["season_score"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    first = [line for line in plan.splitlines() if "Join" in line][-1]
    assert "SortMergeJoin [player" in first


def test_no_window_holds_a_season(spark):
    plan = catalogue.queries()["form_or_season"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line]
    assert len(windows) == 1 and "player_code" in windows[0]


def test_dealt_values_are_shuffled_as_plain_rows(spark):
    """No list is made of a value before the shuffle, where each is alone with its target."""
    from pyspark.sql import functions as F

    from scoreloom.models.experiments import _gathered

    sent = spark.range(100).select((F.col("id") % 10).alias("__to"), (F.col("id") % 30).cast("int").alias("k"), F.lit(1.0).alias("v"))
    out = _gathered(sent, 10)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("collect_list") < plan.index("Exchange") and "collect_list" not in plan[plan.index("Exchange") :]
    rows = out.collect()
    assert sorted((r["__to"], len(r["dealt"])) for r in rows) == [(i, 10) for i in range(10)]
    assert {(v.f, v.r) for r in rows for v in r["dealt"]} == {(f, r) for f in range(3) for r in range(10)}
