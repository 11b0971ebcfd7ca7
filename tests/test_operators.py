"""Hand-computed cases and properties of the analytics operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from scoreloom.functions import text as tx
from scoreloom.operators import aggregates, bands, decisions, matching, merge, windows
from scoreloom.plans import payloads
from scoreloom.sources import archive


def col(spark, values, expr, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").collect()]


def test_bands(spark):
    assert col(spark, [-10.0, -0.5, 0.0, 0.5, 10.0], bands.difficulty_multiplier) == [1.5, 1.2, 1.0, 0.8, 0.6]
    scores = [-1.0, -0.35, -0.349, -0.1, -0.099, 0.1, 0.101, 0.35, 0.351, None, float("nan")]
    assert col(spark, scores, bands.fixture_grade) == [1, 1, 2, 2, 3, 3, 4, 4, 5, None, None]
    assert col(spark, [-0.2, 0.0, 0.25], bands.run_rating) == ["Easy", "Mixed", "Brutal"]
    assert col(spark, [-1.0, 0.0, 2.0, 10.5, 200.0], lambda v: bands.right_closed(v, [-1, 0, 2, 5, 10, 100], list("abcde"))) == [None, "a", "b", "e", None]
    assert col(spark, ["Hamstring pull", "Flu", None], lambda v: bands.contains_any(v, bands.MUSCLE_WORDS), "string") == [True, False, False]


def test_horizon_points(spark):
    players = spark.createDataFrame([(1, 10.0), (2, 8.0), (3, 6.0)], "player int, predicted double")
    fixtures = spark.createDataFrame([(1, 0.25), (1, 0.5), (1, -0.5), (2, -0.5)], "player int, score double")
    got = {r.player: (round(r.horizon_points, 6), r.fixtures) for r in decisions.horizon_points(players, fixtures, 2).collect()}
    assert got == {1: (29.0, 3), 2: (9.6, 1), 3: (0.0, 0)}
    none = decisions.horizon_points(players.limit(1), fixtures.limit(0), 3).first()
    assert (none.horizon_points, none.fixtures) == (30.0, 3)


def test_draws_and_summary(spark):
    def draw(lo, mi, hi, us):
        return [round(x, 6) for x in col(spark, us, lambda u: decisions.inverse_draw(F.lit(lo), F.lit(mi), F.lit(hi), u))]

    assert draw(2.0, 6.0, 10.0, [0.05, 0.3, 0.7, 0.95]) == [2, 4, 8, 10.5]
    assert draw(-3.0, -1.0, 5.0, [0.05, 0.5, 0.95]) == [0, 0, 5.75]
    squad = spark.createDataFrame([("s", 1, 1, 2.0, 2.0, 2.0, 0.0), ("s", 2, 2, 3.0, 3.0, 3.0, 0.0), ("s", 3, 0, 100.0, 100.0, 100.0, 0.0)], "k string, p int, multiplier int, floor double, median double, ceiling double, predicted double")
    assert {r.total for r in decisions.simulate(squad, ["k"], "p", draws=20).collect()} == {8.0}
    nulls = squad.where("p = 1").withColumns({c: F.lit(None).cast("double") for c in ("floor", "median", "ceiling")}).withColumn("predicted", F.lit(4.0))
    a, b, c = ([r.total for r in decisions.simulate(nulls, ["k"], "p", draws=30, seed=s).orderBy("draw").collect()] for s in (7, 7, 8))
    assert a == b != c and min(a) >= 0
    r = aggregates.simulation_summary(spark.createDataFrame([(float(x),) for x in (0, 60, 70, 80, 100)], "v double"), "v").first()
    assert [round(x, 6) for x in r] == [62, 24, 70, 92, 0.8, 0.4]


def test_best_line_up(spark):
    assert all(sum(f) == 10 for f in decisions.FORMATIONS)
    lines = {"GKP": [5, 4], "DEF": [8, 7, 6, 1, 1], "MID": [10, 9, 8, 7, 3], "FWD": [12, 11, 1]}
    rows = [(f"{p}{i}", p, float(v)) for p, vs in lines.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, player string, position string, value double")
    r = decisions.best_line_up(df, ["k"], "position", "value", ["player"]).first()
    assert (r.formation, r.total) == ("3-5-2", 86.0)
    low = df.withColumn("value", F.col("value") - 100)
    assert decisions.best_line_up(low, ["k"], "position", "value", ["player"]).first().formation == "3-5-2"
    assert decisions.best_line_up(df.where("position <> 'GKP'"), ["k"], "position", "value", ["player"]).count() == 0


def test_free_moves(spark):
    df = spark.createDataFrame([("a", 1, 99), ("a", 3, 0), ("a", 2, 1), ("a", 4, 2)] + [("b", g, 0) for g in range(1, 9)], "k string, gw int, made long")
    assert {r.k: r.free_moves for r in windows.capped_fold(df, ["k"], "gw", "made").collect()} == {"a": 1, "b": 5}


POOL = [(3, "MID", "T3", 6.0, 10.0, "a"), (4, "MID", "T1", 5.0, 7.0, "a"), (5, "DEF", "T3", 5.0, 10.0, "a"), (6, "MID", "T3", 1.0, 20.0, "i"), (7, "MID", "T3", 10.0, 20.0, "a")]
SQUAD = [(1, "MID", "T1", 5.0, 5.0), (2, "DEF", "T2", 4.0, 4.0)]


def frames(spark):
    pool = spark.createDataFrame(POOL, "player long, position string, team string, price double, value double, status string")
    squad = spark.createDataFrame(SQUAD, "player long, position string, team string, price double, value double")
    return squad, pool


def test_suggestions(spark):
    squad, pool = frames(spark)
    got = {r.sell_player: (r.buy_player, r.gain, r.gain_after_hit) for r in decisions.suggestions(squad, pool, 1.0, top=1).collect()}
    assert got == {2: (5, 6.0, 2.0), 1: (3, 5.0, 1.0)}
    crowd = squad.union(spark.createDataFrame([(8, "FWD", "T1", 9.0, 9.0), (9, "FWD", "T1", 9.0, 9.0), (10, "GKP", "T1", 9.0, 9.0)], squad.schema))
    buys = {r.buy_player for r in decisions.suggestions(crowd.where("player <> 1").union(spark.createDataFrame([(11, "MID", "T9", 6.0, 1.0)], squad.schema)), pool, 1.0).collect()}
    assert 4 not in buys and 3 in buys
    assert decisions.suggestions(squad, pool.limit(0), 1.0).count() == 0


def test_greedy_plan(spark):
    squad, pool = frames(spark)
    squads = squad.withColumns({"group": F.lit("g"), "bank": F.lit(1.0)})
    two = decisions.greedy_plans(squads, pool, free=2, most=3).orderBy("step").collect()
    assert [(r.buy, r.net, r.hit) for r in two] == [(5, 6.0, 0.0), (4, 2.0, 0.0)]
    assert two[-1].bank == 0.0
    none = decisions.greedy_plans(squads, pool, free=0).collect()
    assert [(r.hit, r.net) for r in none] == [(4.0, 2.0)]


def brute_plan(squad, pool, bank, free, most=5):
    """Transfers of one squad by loops over all pairs; rows are player, position, team, price, value."""
    have, bought, counts, out = list(squad), set(), {}, []
    for r in squad:
        counts[r[2]] = counts.get(r[2], 0) + 1
    for step in range(most):
        owned = {r[0] for r in have} | bought
        pairs = [
            (-(b[4] - s[4]), s[0], b[0], s, b) for s in have for b in pool
            if b[0] not in owned and b[1] == s[1] and b[3] <= s[3] + bank + 1e-9 and counts.get(b[2], 0) - (b[2] == s[2]) + 1 <= 3 and b[4] > s[4]
        ]
        if not pairs:
            break
        _, _, _, s, b = min(pairs)
        cost = 4.0 if step >= free else 0.0
        if b[4] - s[4] - cost <= 0:
            break
        bank += s[3] - b[3]
        counts[s[2]] -= 1
        counts[b[2]] = counts.get(b[2], 0) + 1
        bought.add(b[0])
        have = [r for r in have if r != s] + [b]
        out.append((step + 1, s[0], b[0], b[4] - s[4]))
    return out


def test_greedy_plans_of_a_large_pool(spark, monkeypatch):
    """No bound on the pool, and the players it is cut to give every plan the whole pool gives, with many equal prices and values."""
    monkeypatch.setattr(decisions, "POOL_ROWS", 100)
    rows = [(i, "GDMF"[i * 7 % 4], f"T{i * 13 % 11 % 5}", float(i * 31 % 17), float(i * 29 % 23)) for i in range(1200)]
    squads = {g: rows[g * 40 : g * 40 + 15] for g in range(4)}
    pool = spark.createDataFrame([(*r, "a") for r in rows], "player long, position string, team string, price double, value double, status string")
    given = spark.createDataFrame([(str(g), *r, 3.0) for g, s in squads.items() for r in s], "group string, player long, position string, team string, price double, value double, bank double")
    got = {}
    for r in decisions.greedy_plans(given, pool, free=2).orderBy("group", "step").collect():
        got.setdefault(int(r.group), []).append((r.step, r.sell, r.buy, r.gain))
    assert got == {g: brute_plan(s, rows, 3.0, 2) for g, s in squads.items()} and len(got) == 4


def test_undominated_is_what_pairs_say(spark):
    rows = [(i, "GD"[i % 2], f"T{i % 3}" if i % 50 else None, None if i % 41 == 0 else float(i * 31 % 13), float(i * 29 % 11)) for i in range(400)]
    pool = spark.createDataFrame(rows, "player long, position string, team string, price double, value double")

    def beats(a, b):
        return a[1:3] == b[1:3] and None not in (*a, *b) and a[3] <= b[3] and a[4] >= b[4] and (a[3] < b[3] or a[4] > b[4] or a[0] < b[0])

    want = {b[0] for b in rows if sum(beats(a, b) for a in rows) < 3}
    out = decisions.undominated(pool)
    assert {r.player for r in out.collect()} == want and len(want) < 100
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_fixture_grid(spark):
    rows = [("AAA", "BBB", True, 12, -0.5), ("AAA", "CCC", False, 14, -0.4), ("AAA", "BBB", True, 14, 0.2), ("BBB", "AAA", False, 12, 0.5), ("BBB", "CCC", True, 13, 0.4)]
    df = spark.createDataFrame(rows, "team string, opponent string, is_home boolean, gw int, score double")
    got = payloads.fixture_grid(df, 12, 3).collect()
    assert [r.team for r in got] == ["AAA", "BBB"]
    assert [r.run for r in got] == ["Easy", "Brutal"]
    cells = {c.gw: c for c in got[0].cells}
    assert cells[13].parts is None and cells[13].grade is None
    assert round(cells[14]["mean"], 6) == -0.1 and cells[14].grade == 2 and sorted(p.grade for p in cells[14].parts) == [1, 4]


def test_season_pages(spark):
    weeks = spark.createDataFrame([(1, 50, 4, None, None), (2, 72, 9, 55.0, 58.0), (3, 61, 2, 60.0, 52.0)], "gw int, points int, bench_points int, model_points double, official_points double")
    s = payloads.season_summary(weeks).first()
    assert (s.total, s.best_gw, s.best_points, s.bench, s.average) == (183, 2, 72, 15, 61.0)
    a = payloads.season_accuracy(weeks).first()
    assert (a.weeks, a.beats, a.model_error, a.official_error, a.miss_gw, a.miss_gap) == (2, 1, 9.0, 11.5, 2, 17.0)


def test_leak_free_windows_ignore_the_present(spark):
    rng = random.Random(1)
    rows = [(k, t, float(rng.randrange(100))) for k in "ab" for t in range(12)]
    df = spark.createDataFrame(rows, "k string, t int, v double")
    changed = df.withColumn("v", F.when(F.col("t") >= 6, 1e6).otherwise(F.col("v")))
    f = lambda d: sorted(map(tuple, windows.leakfree_form(d, ["k"], ["t"], "v").where("t <= 6").drop("v").collect()))
    assert f(df) == f(changed)


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, None, 20)], "k int, s string, n int")
    new = spark.createDataFrame([(2, "b", 21), (3, "c", 30)], "k int, s string, n int")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(merge.upsert_keeping(old, new, ["k"], ["s"])) == [(1, "a", 10), (2, "b", 21), (3, "c", 30)]
    assert rows(merge.insert_absent(old, new, ["k"], ["n"])) == [(1, "a", 10), (2, None, 20), (3, "c", 30)]
    state = spark.createDataFrame([(1, "proposed"), (2, "sent")], "k int, status string")
    assert rows(merge.claim(state, ["k"], spark.createDataFrame([(1,), (2,)], "k int"), "proposed", "taken")) == [(1, "taken"), (2, "sent")]


def test_similarity():
    assert tx.normal(" Ødegård ") == "ødegard"
    assert tx.ratio("abc", "abc") == 100 and tx.ratio("", "") == 100 and tx.ratio("abc", "xyz") == 0
    assert tx.ratio("kitten", "sitting") == pytest.approx(200 * 4 / 13)
    assert tx.token_sort_ratio("son heung min", "min heung son") == 100
    assert tx.partial_ratio("united", "manchester united") == 100


def test_name_passes(spark):
    people = [(1, "Bruno Fernandes", "B.Fernandes", "Man Utd"), (2, "Son Heung-Min", "Son", "Spurs"), (3, "Ben White", "White", "Arsenal"), (4, "Jon White", "White", "Leeds"), (5, "Mohamed Salah", "Salah", "Liverpool")]
    directory = spark.createDataFrame(people, "code int, full_name string, web_name string, team string")
    raw = spark.createDataFrame(
        [("bruno fernandes", "x", 1), ("H. Son", None, 1), ("B. White", "Arsenal", 1), ("Mohammed Salah-Hamed", None, 1), ("Mohamed Salahh", "Liverpool FC", 1), ("Nobody Here", None, 1), ("Fixed", None, 1)],
        "raw_name string, club string, seq int",
    )
    over = spark.createDataFrame([("Fixed", 4)], "raw_name string, code int")
    got = {r.raw_name: (r.code, r["pass"]) for r in matching.match_names(raw, directory, over).collect()}
    assert got["bruno fernandes"] == (1, "exact")
    assert got["H. Son"] == (2, "token")
    assert got["B. White"] == (3, "token_club")
    assert got["Mohamed Salahh"] == (5, "fuzzy")
    assert got["Nobody Here"] == (None, None)
    assert got["Fixed"] == (4, "override")


def test_archive_and_features(spark, tmp_path):
    from scoreloom.plans import features

    rng = random.Random(3)
    base = ["element", "GW", "fixture", "name", "position", "team", "opponent_team", "was_home", "kickoff_time", "team_h_score", "team_a_score", "value", "selected", *archive.STATS]
    for season, extra in (("2021-22", []), ("2022-23", archive.XG_COLUMNS)):
        (tmp_path / season).mkdir()
        with open(tmp_path / season / "merged_gw.csv", "w") as f:
            f.write(",".join(base + extra) + "\n")
            for gw in range(1, 7):
                for e in range(1, 9):
                    for double in range(2 if gw == 4 and e < 3 else 1):
                        team = "T1" if e % 2 else "T2"
                        row = [e, gw, gw * 10 + double, f"P{e}", "GK" if e == 1 else "AM" if e == 8 else "MID", team, 2, team == "T1", f"2022-0{gw}-0{1 + double}T15:00:00Z", 2, 1, 50, 100]
                        f.write(",".join(map(str, row + [rng.randrange(0, 9) for _ in archive.STATS + extra])) + "\n")
    rows = archive.seasons(spark, str(tmp_path), ["2022-23", "2021-22"])
    assert rows.where("position = 'AM'").count() == 0 and rows.where("position = 'GKP'").count() > 0
    assert {(r.season, r.xg_data_available) for r in rows.select("season", "xg_data_available").distinct().collect()} == {("2021-22", 0), ("2022-23", 1)}
    plan = rows._jdf.queryExecution().executedPlan()
    assert plan.toString().count("FileScan") == 1
    one = rows.where("season = '2021-22'")
    assert {r.expected_goals for r in one.select("expected_goals").distinct().collect()} == {None}
    scan = one._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    scan.executeColumnar() if scan.supportsColumnar() else scan.execute().count()
    assert scan.metrics().apply("numFiles").value() == 1
    assert archive.seasons(spark, str(tmp_path), ["1999-00"]).collect() == []
    (tmp_path / "2023-24").mkdir()
    (tmp_path / "2023-24" / "merged_gw.csv").write_text('\ufeffGW,name,element,position,expected_goals\n\n3,"Some, One",5,GK,0.25\n4,x,bad,FWD,\n')
    moved = archive.seasons(spark, str(tmp_path), ["2023-24", "2022-23", "1999-00"]).where("season = '2023-24'").orderBy("GW").collect()
    assert [(r.GW, r.name, r.element, r.position, r.expected_goals, r.minutes, r.xg_data_available) for r in moved] == [(3, "Some, One", 5, "GKP", 0.25, None, 1), (4, "x", None, "FWD", None, None, 1)]
    rows = rows.withColumns({"code": F.col("element") + 1000, "opponent": F.when(F.col("team") == "T1", "T2").otherwise("T1")})
    frame = features.training_frame(rows).persist()
    assert frame.count() == rows.select("season", "element", "GW").distinct().count()
    assert set(features.feature_columns(frame)) <= set(frame.columns)
    total = rows.where("element = 1 and season = '2021-22' and GW = 4").agg(F.sum("total_points")).first()[0]
    assert frame.where("element = 1 and season = '2021-22' and GW = 4").first().total_points == total
    assert {r.had_prior_season for r in frame.where("season = '2021-22'").select("had_prior_season").distinct().collect()} == {0}
    assert {r.had_prior_season for r in frame.where("season = '2022-23'").select("had_prior_season").distinct().collect()} == {1}
    assert archive.read_or_empty(spark, str(tmp_path / "none.csv"), "a int").count() == 0


def test_injury_edges(spark):
    from scoreloom.plans import features

    day = dt.datetime(2023, 5, 1, 15)
    rows = spark.createDataFrame([(1, "s", 1, 1, day), (2, "s", 2, 1, day)], "code int, season string, element int, GW int, kickoff_time timestamp")
    d = dt.date
    inj = spark.createDataFrame([(1, d(2023, 4, 20), d(2023, 4, 25)), (1, d(2022, 4, 20), d(2022, 5, 1)), (1, d(2023, 5, 2), None)], "code int, injury_from date, injury_until date")
    got = {r.code: r for r in features.injury_features(rows, inj).collect()}
    assert got[1].injuries_365d == 1 and got[1].days_since_injury == pytest.approx(6.625) and got[1].returning == 1
    assert (got[2].days_since_injury, got[2].injuries_365d, got[2].injury_data_available) == (9999.0, 0, 0)


def test_strict_json():
    assert archive.strict_json({"a": [1, 2.5, None, "é"]}) == '{"a":[1,2.5,null,"é"]}'
    with pytest.raises(ValueError):
        archive.strict_json({"a": float("nan")})


def test_flatten(spark):
    df = spark.createDataFrame([('{"elements":[{"id":1,"stats":{"minutes":"90"}},{"id":2,"stats":{"minutes":"x"}}]}',)], "j string")
    landed = df.select(F.from_json("j", "elements array<struct<id:int,stats:struct<minutes:string>>>").alias("p")).select("p.elements")
    assert [r.minutes for r in archive.flatten(landed, "elements", {"minutes": "int"}, nested="stats").collect()] == [90, None]


def test_due_tiers(spark):
    hours = spark.createDataFrame([("s", 1, 5.0), ("s", 2, -1.0)], "season string, event_id int, hours double")
    log = spark.createDataFrame([("s", 1, 24)], "season string, event_id int, tier int")
    assert [r.tier for r in payloads.due_tiers(hours, log).collect()] == [6]
