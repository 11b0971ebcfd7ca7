"""Page payloads: the last small frames as documents. Public builders take no manager; private ones do."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators.asof import latest_at
from scoreloom.operators.bands import fixture_grade, run_rating
from scoreloom.operators.decisions import best_line_up, horizon_points


def players_page(rankings: DataFrame) -> DataFrame:
    """Available players with a prediction of 0 or more, best first; nulls stay null."""
    ok = rankings.where((F.col("status") == "a") & (F.col("predicted_points") >= 0))
    return ok.select(
        "player_code", "web_name", "position", "team", F.bround("predicted_points", 1).alias("predicted"), F.bround("price", 1).alias("price"),
        F.bround(F.col("haul_probability") * 100, 0).cast("int").alias("haul"), F.bround(F.col("predicted_points") / F.nullif(F.col("price"), F.lit(0)), 2).alias("value"),
    ).orderBy(F.col("predicted").desc_nulls_last(), "player_code")


def browse(rankings: DataFrame, position: str | None = None, least: float | None = None, most_owned: float | None = None, available: bool = False, sort: str = "predicted_points", top: int = 25) -> DataFrame:
    """The players browser: composable filters and a top-k."""
    out = rankings
    if position:
        out = out.where(F.col("position") == position)
    if least is not None:
        out = out.where(F.col("predicted_points") >= least)
    if most_owned is not None:
        out = out.where(F.col("ownership") < most_owned)
    if available:
        out = out.where("status = 'a'")
    return out.orderBy(F.col(sort).desc_nulls_last(), "player_code").limit(top)


def fixture_grid(fixtures: DataFrame, start: int, horizon: int) -> DataFrame:
    """A row a team: its weeks in order (no fixture is a blank), the mean difficulty and the run's rating; easiest first.

    ``fixtures`` has team, opponent, is_home, gw and score.
    """
    inside = fixtures.where((F.col("gw") >= start) & (F.col("gw") < start + horizon))
    cells = inside.groupBy("team", "gw").agg(F.avg("score").alias("mean"), F.sort_array(F.collect_list(F.struct("opponent", "is_home", fixture_grade(F.col("score")).alias("grade")))).alias("parts"))
    cells = cells.withColumn("grade", fixture_grade(F.col("mean")))
    weeks = inside.select("team").distinct().withColumn("gw", F.explode(F.sequence(F.lit(start), F.lit(start + horizon - 1))))
    grid = weeks.join(cells, ["team", "gw"], "left").groupBy("team").agg(F.sort_array(F.collect_list(F.struct("gw", "grade", "mean", "parts"))).alias("cells"))
    avg = inside.groupBy("team").agg(F.avg("score").alias("avg"))
    return grid.join(avg, "team").withColumn("run", run_rating(F.col("avg"))).orderBy("avg", "team")


def season_summary(weeks: DataFrame) -> DataFrame:
    """Total, best week (the first of equals), bench points and the average of a manager's season."""
    return weeks.agg(
        F.sum("points").alias("total"), F.max_by("gw", F.struct("points", -F.col("gw"))).alias("best_gw"), F.max("points").alias("best_points"), F.sum("bench_points").alias("bench"), F.bround(F.avg("points"), 1).alias("average")
    )


def season_accuracy(weeks: DataFrame) -> DataFrame:
    """Over weeks with both predictions: how often ours is nearer, mean errors, and the largest under-estimate."""
    both = weeks.where("model_points is not null and official_points is not null and points is not null")
    ours, theirs = F.abs(F.col("points") - F.col("model_points")), F.abs(F.col("points") - F.col("official_points"))
    gap = F.col("points") - F.col("model_points")
    return both.agg(
        F.count("*").alias("weeks"), F.sum((ours < theirs).cast("int")).alias("beats"), F.bround(F.avg(ours), 1).alias("model_error"), F.bround(F.avg(theirs), 1).alias("official_error"),
        F.max_by("gw", F.struct(gap, -F.col("gw"))).alias("miss_gw"), F.max(gap).alias("miss_gap"),
    )


def lineup_plan(squad: DataFrame, value: str = "predicted_points") -> DataFrame:
    """A squad with its formation, who starts, the captain and vice-captain, and the bench order (keeper first)."""
    s = squad.withColumn("__k", F.lit(1))
    best = best_line_up(s, ["__k"], "position", value, ["player_code"]).withColumn("__f", F.split("formation", "-").cast("array<int>"))
    line = Window.partitionBy("position").orderBy(F.col(value).desc(), "player_code")
    need = F.when(F.col("position") == "GKP", 1).when(F.col("position") == "DEF", F.col("__f")[0]).when(F.col("position") == "MID", F.col("__f")[1]).otherwise(F.col("__f")[2])
    out = s.join(F.broadcast(best), "__k").withColumn("starts", F.row_number().over(line) <= need)
    rank = F.row_number().over(Window.partitionBy("starts").orderBy(F.col(value).desc(), "player_code"))
    bench = F.row_number().over(Window.partitionBy("starts").orderBy((F.col("position") != "GKP").cast("int"), F.col(value).desc(), "player_code"))
    return out.withColumns(
        {
            "role": F.when(~F.col("starts"), "bench").when(rank == 1, "captain").when(rank == 2, "vice").otherwise("starter"),
            "bench_order": F.when(~F.col("starts"), bench),
        }
    ).drop("__k", "__f")


def captain_change(squad: DataFrame) -> DataFrame:
    """The better captain among the starters, and what it gains over the one in place."""
    xi = squad.where("multiplier > 0")
    top = xi.agg(F.max_by("player_code", F.struct("predicted_points", -F.col("player_code"))).alias("best"), F.max("predicted_points").alias("best_points"), F.max(F.when(F.col("is_captain"), F.col("predicted_points"))).alias("held_points"), F.max(F.when(F.col("is_captain"), F.col("player_code"))).alias("held"))
    return top.withColumns({"done": F.col("best") == F.col("held"), "gain": F.col("best_points") - F.col("held_points")})


def lineup_changes(squad: DataFrame) -> DataFrame:
    """Who comes in and who goes out against the best line-up: anti-joins of two player sets."""
    best = lineup_plan(squad).where("starts").select("player_code")
    now = squad.where("multiplier > 0").select("player_code")
    return best.join(now, "player_code", "left_anti").withColumn("change", F.lit("in")).unionByName(now.join(best, "player_code", "left_anti").withColumn("change", F.lit("out")))


def recommendation(rankings: DataFrame, fixtures: DataFrame, horizon: int) -> DataFrame:
    """Rankings with points over the horizon; a missing prediction counts as 0."""
    players = rankings.withColumns({"predicted": F.coalesce("predicted_points", F.lit(0.0)), "player": F.col("player_code")})
    return horizon_points(players, fixtures, horizon, week="predicted_gw" if "predicted_gw" in rankings.columns else None).drop("player", "predicted")


def due_tiers(hours_left: DataFrame, log: DataFrame, tiers: tuple[int, ...] = (24, 6, 2)) -> DataFrame:
    """Reminders that are due: 0 <= hours left <= tier, and not in the log. ``hours_left`` has season, event_id, hours."""
    wanted = hours_left.withColumn("tier", F.explode(F.array(*[F.lit(t) for t in tiers]))).where((F.col("hours") >= 0) & (F.col("hours") <= F.col("tier")))
    return wanted.join(log.select("season", "event_id", "tier"), ["season", "event_id", "tier"], "left_anti")


def manager_comparison(picks: DataFrame, predictions: DataFrame, official: DataFrame, deadlines: DataFrame, weeks: DataFrame) -> DataFrame:
    """A manager's weeks with the model's and the official expectation of the eleven.

    The newest prediction of each player and week, and the newest official
    figure dated no later than the deadline's day; sums are by multiplier.
    """
    keys = ["season", "event_id", "player_code"]
    xi = picks.where("multiplier >= 1")
    newest = predictions.groupBy(*keys).agg(F.max_by("predicted_points", F.struct("predicted_at", "model_id")).alias("pred"))
    day = deadlines.select("season", "event_id", F.to_date("deadline_time").alias("day"))
    asked = xi.select(*keys).distinct().join(day, ["season", "event_id"])
    known = official.where("ep_next is not null").select("season", "player_code", "snapshot_date", F.col("ep_next").alias("ep"))
    seen = latest_at(asked, known, ["season", "player_code"], "day", "snapshot_date", ["ep"], ["ep"], ["event_id"])
    sums = xi.join(newest, keys, "left").join(seen, keys, "left").groupBy("entry_id", "season", "event_id").agg(
        F.sum(F.col("pred") * F.col("multiplier")).alias("model_points"), F.count("pred").alias("model_matched"), F.sum(F.col("ep") * F.col("multiplier")).alias("official_points"), F.count("ep").alias("official_matched")
    )
    return weeks.join(sums, ["entry_id", "season", "event_id"], "left")
