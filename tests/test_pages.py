"""Landing, registry, live state, pages and their decisions, on small hand-made frames."""

import json

import pytest
from pyspark.sql import functions as F

from scoreloom.models import registry
from scoreloom.plans import pages
from scoreloom.sources import landing

SQUAD = [("GKP", 2), ("DEF", 5), ("MID", 5), ("FWD", 3)]


def squad(spark):
    rows, code = [], 0
    for pos, n in SQUAD:
        for i in range(n):
            code += 1
            first = (pos == "GKP" and i == 0) or (pos == "DEF" and i < 3) or (pos == "MID" and i < 4) or (pos == "FWD")
            rows.append((code, code, pos, f"T{code % 4}", float(20 - code), (2 if code == 3 else 1) if first else 0, code == 3))
    return spark.createDataFrame(rows, "player_code long, squad_position int, position string, team string, predicted_points double, multiplier int, is_captain boolean")


def test_landing_in_order(spark, tmp_path):
    (tmp_path / "boot.json").write_text(json.dumps({"elements": [{"code": 100, "id": 1, "web_name": "A"}, {"code": 200, "id": 2, "web_name": "B"}]}, indent=1))
    boot = landing.landed_json(spark, str(tmp_path / "boot.json"), "elements array<struct<code: long, id: int, web_name: string>>")
    people = landing.land_players(spark.createDataFrame([(100, "old", "s", 0)], "player_code long, web_name string, season string, seq int"), boot, "s", F.lit(1))
    assert {(r.player_code, r.web_name) for r in people.collect()} == {(100, "A"), (200, "B")}
    ids = boot.select(F.explode("elements").alias("e")).select(F.lit("s").alias("season"), "e.id", "e.code")
    live = spark.createDataFrame([([(1, (90, 7)), (9, (10, 1))],)], "elements array<struct<id: int, stats: struct<minutes: int, total_points: int>>>")
    old = spark.createDataFrame([("s", 100, 3, 45, 2, 0), ("s", 100, 2, 90, 5, 0)], "season string, player_code long, event_id int, minutes int, total_points int, seq int")
    got = landing.land_week(old, live, ids, "s", 3, F.lit(1))
    assert {(r.player_code, r.event_id, r.minutes) for r in got.collect()} == {(100, 3, 90), (100, 2, 90)}
    done = []
    events = spark.createDataFrame([(3, False, True), (1, True, False), (2, True, False), (4, False, False)], "id int, finished boolean, is_current boolean")
    assert landing.ingest_weeks(events, [lambda: done.append("dims"), lambda: done.append("fixtures")], done.append) == [1, 2, 3]
    assert done == ["dims", "fixtures", 1, 2, 3]
    (tmp_path / "boot.json").write_text("{broken")
    with pytest.raises(Exception):
        landing.landed_json(spark, str(tmp_path / "boot.json"), "elements array<struct<code: long>>").collect()


def test_bound_parameters(spark):
    df = spark.createDataFrame([("a",), ("b' OR 1=1",)], "x string")
    assert landing.sql_read(spark, "SELECT * FROM {t} WHERE x = :v", {"v": "b' OR 1=1"}, t=df).count() == 1


def test_names_over_seasons_and_back(spark, tmp_path):
    for season, text in (("2019-20", "code,first_name,second_name,web_name,team,extra\n1,Ann,Lee,Lee,3,x\n"), ("2020-21", "code,first_name,second_name,web_name,team\n1,Ann,Lee,Lee,4\n2,Bo,Ek,Ek,4\n")):
        (tmp_path / season).mkdir()
        (tmp_path / season / "players_raw.csv").write_text(text)
    (tmp_path / "2020-21" / "teams.csv").write_text("id,name\n4,Leeds\n")
    got = landing.directory(spark, str(tmp_path), ["2020-21", "2019-20", "2018-19"]).collect()
    assert {tuple(r) for r in got} == {(1, "Ann Lee", "Lee", None, "2019-20"), (1, "Ann Lee", "Lee", "Leeds", "2020-21"), (2, "Bo Ek", "Ek", "Leeds", "2020-21")}
    records = spark.createDataFrame([("Lee", "EPL", "Knee", "2020-01-02", "bad", "43 days", "4"), ("Zed", "EPL", "Toe", "2020-01-02", None, "?", None)], "player_name string, league string, injury string, injury_from string, injury_until string, days string, games string")
    matches = spark.createDataFrame([("Lee", 1), ("Zed", None), ("Abe", None)], "raw_name string, code long")
    rows, unmatched = landing.apply_matches(records, matches, "k")
    (r,) = rows.collect()
    assert (r.player_code, str(r.injury_from), r.injury_until, r.days_out, r.games_missed) == (1, "2020-01-02", None, 43, 4)
    assert landing.add_injuries(rows, rows.unionByName(rows)).count() == 1
    landing.report(unmatched, str(tmp_path / "out"), ["raw_name"])
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text().split() == ["raw_name", "Abe", "Zed"]


def test_cache_ages(spark):
    now, built = [0.0], []
    cache = landing.Aged(300, lambda: now[0])
    build = lambda: built.append(1) or spark.range(3)
    first = cache.get("k", build)
    now[0] = 299
    assert cache.get("k", build) is first and len(built) == 1
    now[0] = 301
    assert cache.get("k", build).count() == 3 and len(built) == 2 and not first.is_cached


def test_registry_round_trip(spark, tmp_path):
    rows = [(i, float(i % 7), float(i % 5), 2.0 * (i % 7) + 1 + (i % 3) * 0.1, i < 150) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double, train boolean")
    got = registry.evaluate_features(df, ["a", "b"], "y", F.col("train"), "id", draws=50).first()
    assert got.r2 > 0.99 and got.low <= got.r2 <= got.high and got.overfit_gap == pytest.approx(got.train_r2 - got.r2) and got.n_features == 2
    assert registry.evaluate_features(df, ["b"], "y", F.col("train"), "id", fraction=0.5, draws=20).first().r2 < 0.5
    from pyspark.ml import Pipeline

    from scoreloom.models.training import assembler, design, regressors

    model = Pipeline(stages=[assembler(["a", "b"]), regressors("y")["linear_regression"]]).fit(design(df, ["a", "b"], "y"))
    name = registry.save_model(model, str(tmp_path / "m"), "run1", "linear")
    again = registry.load_model(str(tmp_path / "m"), name)
    out = registry.score_next(again, spark.createDataFrame([(1, 3.0), (2, -50.0)], "player_code long, a double"), ["a", "b"], ["player_code"])
    got = {r.player_code: r.predicted_points for r in out.collect()}
    assert got[1] == pytest.approx(7.1, abs=0.1) and got[2] == 0.0
    path = str(tmp_path / "registry")
    registry.register(spark, path, {"run_id": "run1", "features": ["a", "b"], "r2": 0.9, "diagnostics": {"overfit_gap": 0.2}, "artifact_path": name, "is_experiment": True, "target": "y", "model_type": "linear"})
    registry.register(spark, path, {"run_id": "run2", "is_experiment": False, "target": "y"})
    from scoreloom.plans.reads import experiment_ledger

    (r,) = experiment_ledger(spark.read.parquet(path), "y").collect()
    assert (r.feature_count, r.overfit_gap, r.r2) == (2, 0.2, 0.9)
    with pytest.raises(ValueError):
        registry.register(spark, path, {"nope": 1})


def test_team_state(spark):
    rows = [(1, 1, 2, "2024-01-01", 2, 0, True), (2, 2, 1, "2024-01-10", 1, 3, True), (3, 1, 2, "2024-01-13", None, None, False), (4, 3, 1, "2024-01-20", None, None, False)]
    fx = spark.createDataFrame(rows, "k int, home int, away int, t string, home_score int, away_score int, finished boolean").withColumn("kickoff", F.to_timestamp("t"))
    got = {r.team: r for r in registry.team_state(fx, ["k"]).collect()}
    assert (got[1].opponent, got[1].own_attack, got[1].opp_attack, got[1].days_since, got[1].matches_14d, got[1].is_congested) == (2, 2.5, 0.5, 3.0, 2, 1.0)
    assert (got[3].opponent, got[3].own_attack, got[3].opp_defense, got[3].days_since, got[3].matches_14d, got[3].is_congested) == (1, 1.5, 0.5, 14.0, 0, 0.0)


def test_calls_and_week_page(spark):
    s = squad(spark)
    plan = spark.createDataFrame([(2, 5, 60, 1.0, 4.0), (1, 4, 50, 2.34, 0.0)], "step int, sell long, buy long, net double, hit double")
    got = pages.calls(s, plan)
    assert [c["kind"] for c in got] == ["captain", "lineup", "transfer"] and [c["n"] for c in got] == [1, 2, 3]
    assert (got[0]["from"], got[0]["to"], got[0]["done"]) == (3, 1, False)
    assert (got[2]["sell"], got[2]["net"], got[2]["more"]) == (4, 2.3, 1)
    # The best eleven has five defenders and two forwards fewer; whoever goes off meets his position first.
    assert len(got[1]["pairs"]) == 2 and {p[0] for p in got[1]["pairs"]} == {6, 7} and not got[1]["done"]
    assert pages.paired([{"player_code": 1, "position": "DEF"}, {"player_code": 2, "position": "MID"}], [{"player_code": 9, "position": "MID"}, {"player_code": 8, "position": "FWD"}]) == [(1, 8), (2, 9)]
    assert pages.this_week_page(None) == {"squad": None, "after": None, "calls": [], "plan": []}
    page = pages.this_week_page(s, plan)
    assert len(page["squad"]) == len(page["after"]) == 15 and [p["step"] for p in page["plan"]] == [1, 2]


def test_comparison_extremes_and_replan(spark):
    s = squad(spark)
    best = s.withColumn("player_code", F.when(F.col("player_code") <= 12, F.col("player_code")).otherwise(F.col("player_code") + 100))
    got = pages.squad_comparison(s, best, 200.0, "predicted_points").first()
    assert (got.overlap, got.transfers_needed) == (12, 3) and got.gap == 200 - got.own_total
    grid = spark.createDataFrame([("T1", -0.2), ("T2", 0.3), ("T9", 0.9)], "team string, avg double")
    assert tuple(pages.fixture_extremes(grid, s).first()) == ("T1", "T9", False)
    assert pages.fixture_extremes(grid.where("team <> 'T9'"), s).first().warn
    assert pages.replan(s, list(range(1, 16))).count() == 15
    for live in ([1, 2, 99], [1, 1, 2]):
        with pytest.raises(ValueError):
            pages.replan(s, live)


def test_solutions_by_budget(spark):
    rows = [("p", 100.0, 99.0, 50.0, [3, 1, 2]), ("p", 99.5, 99.0, 50.0, [1, 2, 3]), ("p", 80.0, None, None, None)]
    sol = spark.createDataFrame(rows, "basis string, budget double, spend double, objective double, players array<long>")
    page = pages.optimal_squad_page(sol, spark.createDataFrame([(i,) for i in range(6)], "player_code long"))
    assert page["squads"].count() == 1 and page["players"].count() == 3 and page["by_budget"].count() == 3
    look = lambda b: pages.solution_lookup(page["squads"], page["by_budget"], "p", b).first()
    assert (look(100.0).found, look(100.0).unspent, look(99.5).unspent) == (True, 1.0, 0.5)
    assert not look(80.0).found and not look(55.0).found


def test_site_season_and_approvals(spark):
    stats = spark.createDataFrame([("s", 4)], "season string, event_id int")
    rank = spark.createDataFrame([(5,), (None,)], "predicted_gw int")
    weeks = spark.createDataFrame([("s", 5, "GW5", False, "2024-02-01 11:00:00")], "season string, event_id int, name string, finished boolean, t string").withColumn("deadline_time", F.to_timestamp("t"))
    now = F.lit("2024-01-31 08:00:00").cast("timestamp")
    got = pages.site_page(stats, rank, weeks, "s", now).first()
    assert (got.generated_at, got.last_gw, got.predicted_gw, got.deadline.time, got.horizon) == ("2024-01-31T08:00:00Z", 4, 5, "2024-02-01T11:00:00Z", 5)
    assert pages.site_page(stats, rank, weeks.limit(0), "s", now).first().deadline is None
    season = spark.createDataFrame([(2, 60, 5, 55.0, 50.0), (1, 40, 3, None, None)], "gw int, points int, bench_points int, model_points double, official_points double")
    page = pages.season_page(season)
    assert [w["gw"] for w in page["gameweeks"]] == [1, 2] and page["summary"]["total"] == 100 and page["accuracy"]["weeks"] == 1
    assert pages.season_page(season.where("gw = 1"))["accuracy"] is None
    assert pages.season_page(season.limit(0)) == {"summary": None, "gameweeks": [], "accuracy": None}
    plan = lambda n: spark.createDataFrame([(i, i, i + 50, 1.0, 0.0) for i in range(n, 0, -1)], "step int, sell long, buy long, net double, hit double")
    both = pages.approval_plans(plan(1), plan(3), 2)
    assert len(pages.chosen_plan(both, F.lit("five_gw")).first().transfers) == 3
    silent = pages.chosen_plan(both, F.lit(None).cast("string")).first()
    assert [t.step for t in silent.transfers] == [1] and silent.free_transfers == 2
    lab = pages.lab_page(spark.createDataFrame([(0.3,)], "r2 double"), spark.createDataFrame([("form", 0.1), ("price", 0.29)], "group string, r2 double")).collect()
    assert [r.group for r in lab] == ["form", "price"] and lab[0].delta == pytest.approx(-0.2)
    assert pages.teams_of(spark.createDataFrame([("g", "b"), ("g", "a"), ("g", "b")], "group string, team string")).first().teams == ["a", "b"]


def test_pages_are_bounded(spark):
    assert pages.shown(spark.range(3).orderBy("id")) == [{"id": 0}, {"id": 1}, {"id": 2}]
    with pytest.raises(ValueError, match="at most"):
        pages.shown(spark.range(pages.PAGE_ROWS + 1))
