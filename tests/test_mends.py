"""Cases of the survey's edge rules: overrides, unknown kick-offs, finished flags, unknown ids, missing anchors."""

import datetime
import random

from pyspark.sql import functions as F

from scoreloom.functions.text import normal, token_sort_ratio
from scoreloom.operators import decisions, matching, teams, windows
from scoreloom.plans import payloads
from scoreloom.sources import archive
from scoreloom.streaming import incremental


def test_overrides_meet_in_normal_form_and_the_last_holds(spark):
    raw = spark.createDataFrame([("JOSÉ Unknownname", None, 1)], "raw_name string, club string, seq int")
    directory = spark.createDataFrame([(1, "x", "y", "z")], "code long, full_name string, web_name string, team string")
    over = spark.createDataFrame([("jose unknownname", 7), ("Jose Unknownname ", 8)], "raw_name string, code long").coalesce(1)
    assert [(r.code, r["pass"]) for r in matching.match_names(raw, directory, over).collect()] == [(8, "override")]


def test_blocks_lose_no_pair(spark):
    rng = random.Random(3)
    letters = "abcde "
    full = ["".join(rng.choices(letters, k=rng.randrange(3, 22))).strip() or "a" for _ in range(60)]
    raw = []
    for t in full:
        s = list(t)
        for _ in range(rng.randrange(0, 4)):
            p = rng.randrange(len(s) + 1)
            s[p : p + rng.randrange(2)] = rng.choice(letters) if rng.random() < 0.5 else ""
        raw.append("".join(s))
    names = spark.createDataFrame([(r, normal(r)) for r in set(raw)], "raw_name string, n string")
    people = spark.createDataFrame([(normal(t), i) for i, t in enumerate(full)], "full_n string, code long")
    got = {(r.raw_name, r.code) for r in matching._by_blocks(names, people, 90.0).collect()}
    want = {(r, i) for r in set(raw) if normal(r) for i, t in enumerate(full) if token_sort_ratio(normal(r), normal(t)) >= 90}
    assert want <= got and len(want) > 30 and len(got) < 60 * 60 / 2


FIXTURES = "k int, home int, away int, kickoff timestamp, home_score int, away_score int, finished boolean"


def fixtures(spark):
    day = lambda n: f"2024-01-{n:02d} 12:00:00"
    rows = [(i, 1, 2, day(i), i, 0, True) for i in range(1, 8)] + [(8, 2, 1, None, 5, 50, True), (9, 1, 3, day(9), 3, None, True), (10, 3, 1, day(20), None, None, False), (11, 2, 3, None, None, None, False), (12, 2, 1, day(25), 1, 1, False)]
    return spark.createDataFrame([(*r[:3], None, *r[4:], r[3]) for r in rows], FIXTURES + ", t string").withColumn("kickoff", F.to_timestamp("t")).drop("t")


def test_results_want_a_finished_match_and_the_side_own_score(spark):
    got = {(r.k, r.team) for r in teams.match_results(fixtures(spark), ["k"], finished="finished").collect()}
    assert (9, 1) in got and (9, 3) not in got and not any(k >= 10 for k, _ in got)
    assert {r.k for r in teams.match_results(fixtures(spark), ["k"]).where("k > 9").collect()} == {12}


def test_latest_form_takes_an_unknown_kickoff_as_newest(spark):
    res = teams.match_results(fixtures(spark), ["k"], finished="finished")
    form = teams.latest_form(teams.team_form(res.where("team = 2"), ["team"], ["kickoff", "k"]), ["team"], ["kickoff", "k"]).first()
    # Its own row has the form of the matches before it in the frame's order, where it stands first.
    assert (form.att, form["def"]) == (5.0, 50.0)
    now = {r.team: (r.att, r["def"]) for r in teams.form_now(res, ["team"], ["kickoff", "k"]).collect()}
    assert now[2] == (1.0, (50 + 7 + 6 + 5 + 4) / 5)
    assert now[1] == ((50 + 3 + 7 + 6 + 5) / 5, 5 / 4)


def test_next_fixture_is_the_earliest_with_a_time(spark):
    got = {r.team: (r.opponent, r.is_home, r.kickoff.day) for r in teams.next_fixture(fixtures(spark), ["k"]).collect()}
    assert got == {1: (3, False, 20), 3: (1, True, 20), 2: (1, True, 25)}


def test_unknown_ids_have_no_code(spark):
    rows = spark.createDataFrame([("s", 1), ("s", 2)], "season string, element int")
    ids = spark.createDataFrame([("s", 1, 100)], "season string, id int, code int")
    got = {r.element: r.code for r in archive.to_codes(rows, ids, "element").collect()}
    assert got == {1: 100, 2: None}
    assert archive.known_only(archive.to_codes(rows, ids, "element"), "code").count() == 1


def test_no_predicted_week_means_one_fixture(spark):
    players = spark.createDataFrame([(1, 5.0, None), (2, None, None)], "player_code int, predicted_points double, predicted_gw int")
    fx = spark.createDataFrame([(1, 0.5)], "player int, score double")
    got = {r.player_code: (r.horizon_points, r.fixtures) for r in payloads.recommendation(players, fx, 5).collect()}
    assert got == {1: (5.0, 1), 2: (0.0, 1)}
    anchored = payloads.recommendation(players.withColumn("predicted_gw", F.lit(3)), fx, 5).collect()
    assert {r.player_code: (r.horizon_points, r.fixtures) for r in anchored} == {1: (4.0, 1), 2: (0.0, 0)}
    assert decisions.horizon_points(players.select(F.col("player_code").alias("player"), F.lit(2.0).alias("predicted")), fx.limit(0), 3).first().fixtures == 3


def test_manager_comparison_takes_what_was_known_on_the_day(spark):
    picks = spark.createDataFrame([(9, "s", 1, 5, 2), (9, "s", 1, 6, 1), (9, "s", 1, 7, 0)], "entry_id int, season string, event_id int, player_code int, multiplier int")
    pred = spark.createDataFrame([("s", 1, 5, 3.0, "2024-01-01", 1), ("s", 1, 5, 4.0, "2024-01-02", 1)], "season string, event_id int, player_code int, predicted_points double, predicted_at string, model_id int")
    off = spark.createDataFrame([("s", 5, "2024-01-01", 1.0), ("s", 5, "2024-01-05", 2.5), ("s", 5, "2024-01-06", 9.0), ("s", 6, "2024-01-09", 9.0), ("s", 6, "2024-01-03", None)], "season string, player_code int, d string, ep_next double").select("season", "player_code", F.to_date("d").alias("snapshot_date"), "ep_next")
    deadline = spark.createDataFrame([("s", 1, "2024-01-05 18:00:00")], "season string, event_id int, t string").select("season", "event_id", F.to_timestamp("t").alias("deadline_time"))
    weeks = spark.createDataFrame([(9, "s", 1, 50), (9, "s", 2, 40)], "entry_id int, season string, event_id int, points int")
    got = {r.event_id: r for r in payloads.manager_comparison(picks, pred, off, deadline, weeks).collect()}
    assert (got[1].model_points, got[1].model_matched, got[1].official_points, got[1].official_matched) == (8.0, 1, 5.0, 1)
    assert got[2].model_points is None


def test_free_moves_over_many_slices(spark):
    rng = random.Random(5)
    used = [rng.choice([0, 0, 1, 2, 7]) for _ in range(500)]
    df = spark.createDataFrame([("a", g, u) for g, u in enumerate(used, 1)] + [("b", 1, 4)], "k string, gw int, made long")
    want = 1
    for u in used[1:]:
        want = min(5, max(0, want - u) + 1)
    for width in (7, 1024):
        assert {r.k: r.free_moves for r in windows.capped_fold(df, ["k"], "gw", "made", width=width).collect()} == {"a": want, "b": 1}


def test_upsert_stream_rewrites_only_what_changed(spark, tmp_path):
    source, target, at = (str(tmp_path / n) for n in ("in", "out", "at"))
    schema = "id int, seq int, x string"

    def load(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        incremental.upsert_stream(spark, source, schema, target, ["id"], "seq", at, buckets=8).awaitTermination()

    load([(i, 1, "a") for i in range(40)])
    load([(3, 2, "b"), (99, 1, "c")])
    rows = lambda n: {r.id: r.x for r in incremental.read_version(spark, target, n).collect()}
    assert rows(0) == {i: "a" for i in range(40)}
    assert rows(1) == {**{i: "a" for i in range(40)}, 3: "b", 99: "c"}
    assert 1 <= len(list((tmp_path / "out").glob("bucket=*/v=1"))) <= 2
    assert incremental.read_version(spark, target, -1) is None
    load([(3, 3, "d")])
    before = len(list((tmp_path / "out").glob("bucket=*/v=*")))
    gone = incremental.expire(spark, target, keep=1)
    assert rows(2) == {**{i: "a" for i in range(40)}, 3: "d", 99: "c"}
    assert len(list((tmp_path / "out").glob("bucket=*/v=*"))) == 8 == before - sum("/bucket=" in g for g in gone) and incremental.read_version(spark, target, 1) is None
    load([(5, 9, "e")])
    assert rows(3)[5] == "e" and rows(3)[3] == "d" and len(rows(3)) == 41


def test_stream_lands_what_changed_and_the_last_row_holds(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "ts timestamp, k string"
    day = lambda n: datetime.datetime(2024, 1, n)

    def load(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        counts = incremental.windowed_counts(spark.readStream.schema(schema).parquet(source), "ts", ["k"])
        return {(r.start.day, r.k): r.n for r in incremental.run_to_table(counts, ["start", "k"], out).collect()}

    assert load([(day(1), "a"), (day(9), "a"), (day(9), None)]) == {(1, "a"): 1, (9, "a"): 1, (9, None): 1}
    # Eight days late is beyond the watermark, one isn't.
    assert load([(day(1), "a"), (day(8), "a"), (day(9), "a")]) == {(1, "a"): 1, (8, "a"): 1, (9, "a"): 2, (9, None): 1}
