import random

import pytest

from scoreloom.plans import approvals

SEASONS = "season string, player_code long, fpl_id int, element_type int"


def test_lookups(spark):
    seasons = spark.createDataFrame([("s", 1, 10, 1), ("s", 2, 20, 3), ("t", 1, 11, 1), ("s", 2, 20, 3)], SEASONS)
    assert sorted(map(tuple, approvals.id_map(seasons, "s", [1, 2, 99]).collect())) == [(1, 10), (2, 20)]
    assert approvals.id_map(seasons, "s", []).collect() == []
    prices = spark.createDataFrame([("s", 1, "2024-01-01", 50), ("s", 1, "2024-01-09", 52), ("s", 2, "2024-01-01", 70), ("t", 1, "2025-01-01", 99)], "season string, player_code long, snapshot_date string, now_cost int")
    assert sorted(map(tuple, approvals.latest_prices(prices, "s", [1, 3]).collect())) == [(1, 52)]
    with pytest.raises(ValueError, match="more than 1000"):
        approvals.id_map(seasons, "s", list(range(1001)))
    people = spark.createDataFrame([(1, "A"), (2, "B"), (3, "B")], "player_code long, web_name string")
    assert approvals.code_by_name(people, "A") == 1
    for name, why in (("B", "more than one player"), ("C", "no player")):
        with pytest.raises(ValueError, match=why):
            approvals.code_by_name(people, name)


def test_live_squad(spark):
    seasons = spark.createDataFrame([("s", 1, 10, 1), ("s", 2, 20, 3), ("s", 3, 30, 4)], SEASONS)
    people = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C")], "player_code long, web_name string")
    told = spark.createDataFrame([("s", 1, 5, 3.0), ("s", 1, 6, 4.0), ("s", 2, 5, 9.0), ("t", 2, 9, 8.0)], "season string, player_code long, event_id int, predicted_points double")
    assert sorted(map(tuple, approvals.live_squad([10, 20], seasons, people, told, "s").collect())) == [(10, 1, "A", "GKP", 4.0), (20, 2, "B", "MID", 0.0)]
    with pytest.raises(ValueError, match=r"\[40\]"):
        approvals.live_squad([10, 40], seasons, people, told, "s")


def test_bundle_and_plan(spark):
    rng = random.Random(3)
    shape = ["GKP"] * 2 + ["DEF"] * 5 + ["MID"] * 5 + ["FWD"] * 3
    rows = [(i, f"P{i}", shape[i % 15], f"T{i % 9}", 4.0 + i % 5, "a" if i % 11 else "i", None if i == 40 else round(rng.uniform(0, 9), 2)) for i in range(90)]
    rankings = spark.createDataFrame(rows, "player_code long, web_name string, position string, team string, price double, status string, predicted_points double")
    fixtures = spark.createDataFrame([(i, rng.uniform(-1, 1)) for i in range(90) for _ in range(i % 3)], "player long, score double")
    squad = spark.createDataFrame([(i,) for i in range(15)], "player_code long")
    got = approvals.bundle(squad, rankings, fixtures, 3, 1.0)
    assert set(got) == {"rankings", "squad", "next_week", "horizon", "line_up"}
    assert got["rankings"].count() == 90 and got["squad"].count() == 15
    line_up = got["line_up"].collect()
    assert sorted(r.role for r in line_up if r.role != "starter") == ["bench"] * 4 + ["captain", "vice"]
    points = {r[0]: r[6] or 0.0 for r in rows}
    assert next(r.player_code for r in line_up if r.role == "captain") == max((r.player_code for r in line_up if r.starts), key=lambda c: (points[c], -c))
    by = {r[0]: r for r in rows}
    for r in got["next_week"].collect():
        s, b = by[r.sell_player], by[r.buy_player]
        assert s[2] == b[2] and b[5] == "a" and b[0] >= 15 and b[4] <= s[4] + 1.0 and r.gain == pytest.approx(points[b[0]] - points[s[0]])
    plan = approvals.transfer_plan(got["next_week"], rankings, hit=4.0, free=1)
    assert plan and plan[0]["hit"] == 0.0 and all(p["hit"] == 4.0 and p["net"] > 0 for p in plan[1:])
    assert len({p["sell_code"] for p in plan}) == len({p["buy_code"] for p in plan}) == len(plan) <= 5
    assert [p["gain"] for p in plan] == sorted((p["gain"] for p in plan), reverse=True)
    assert approvals.transfer_plan(got["next_week"].where("false"), rankings, 4.0, 1) == []
