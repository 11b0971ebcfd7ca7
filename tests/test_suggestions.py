import random

import pytest
from pyspark.sql import functions as F

from scoreloom.operators import decisions, slices

SCHEMA = "player long, position string, team string, price double, value double, status string"


def league(seed, n=300):
    rng = random.Random(seed)
    pool = [(i, rng.choice(["GKP", "DEF", "MID", "MID", "MID", None]), f"T{rng.randrange(6)}", rng.choice([None, *range(40, 130)]), rng.choice([None, *range(12)]), rng.choice("aaai")) for i in range(n)]
    pool = [(i, p, t, None if c is None else c / 10, None if v is None else v / 2, s) for i, p, t, c, v, s in pool]
    return pool, rng.sample(pool, 15)


def brute(pool, owned, bank, top):
    held = {}
    for r in owned:
        held[r[2]] = held.get(r[2], 0) + 1
    mine = {r[0] for r in owned}
    out = set()
    for s in owned:
        if None in s[1:5]:
            continue
        ok = [b for b in pool if b[5] == "a" and b[0] not in mine and b[1] == s[1] and None not in b[3:5] and b[3] <= s[3] + bank and b[4] > s[4] and held.get(b[2], 0) - (b[2] == s[2]) + 1 <= decisions.TEAM_LIMIT]
        ok.sort(key=lambda b: (-(b[4] - s[4]), b[0]))
        out |= {(s[0], b[0], b[4] - s[4], k) for k, b in enumerate(ok[:top], 1)}
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("sliced", [False, True])
def test_against_all_pairs(spark, monkeypatch, seed, sliced):
    if sliced:
        monkeypatch.setattr(slices, "SLICE_ROWS", 20)
        monkeypatch.setattr(slices, "LEAST_BYTES", 0)
    pool, owned = league(seed)
    out = decisions.suggestions(spark.createDataFrame(owned, SCHEMA).drop("status"), spark.createDataFrame(pool, SCHEMA), 0.7)
    assert out.columns == ["position", "sell_player", "sell_team", "sell_price", "sell_value", "buy_player", "buy_team", "buy_price", "buy_value", "gain", "gain_after_hit", "choice"]
    assert {(r.sell_player, r.buy_player, r.gain, r.choice) for r in out.collect()} == brute(pool, owned, 0.7, 3)


def test_no_join_forms_pairs(spark):
    """All players of one position: what joins and explodes put out stays in proportion to players and sellers."""
    pool = spark.range(3000).select(F.col("id").alias("player"), F.lit("MID").alias("position"), (F.col("id") % 500).cast("string").alias("team"), (F.col("id") % 97 / 1.0).alias("price"), (F.col("id") % 89 / 1.0).alias("value"), F.lit("a").alias("status"))
    owned = pool.where("player % 30 = 0").drop("status")
    out = decisions.suggestions(owned, pool, 1.0)
    assert out.count() > 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    for line in plan.splitlines():
        if "Join" in line and "[position" in line:
            raise AssertionError(line)
