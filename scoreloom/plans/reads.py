"""Named reads over the keyed tables: season totals, rolling form, rankings, squads, calendars, reports.

Frames have the columns of the tables they are named after: ``stats``
(season, player_code, event_id and measures), ``players`` (player_code,
web_name), ``player_seasons`` (season, player_code, element_type, team_code),
``teams`` (team_code, short_name), ``prices`` (season, player_code,
snapshot_date and the rest), ``predictions``, ``squad_picks``, ``gameweeks``.
"Newest" rows are maxima over structs, and a season's last week is one row
that is joined to all, so nothing but the keys is shuffled. Players and their
seasons are joined by merges: Spark would take them for small by the bytes of
the files they come from, and send all players' seasons through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.semantics import latest_by, safe_div

# Positions by element type.
POSITIONS = {1: "GKP", 2: "DEF", 3: "MID", 4: "FWD"}
SUMS = {
    "total_minutes": "minutes", "total_points": "total_points", "goals": "goals_scored", "assists": "assists", "clean_sheets": "clean_sheets", "bonus": "bonus",
    "bps": "bps", "defensive_contribution": "defensive_contribution", "expected_goals": "expected_goals", "expected_assists": "expected_assists",
}
PREDICTED = ["predicted_points", "p_return_6plus", "p_haul_10plus", "floor_points", "median_points", "ceiling_points"]
KEY = ["season", "player_code"]


def position(element_type: str = "element_type") -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in POSITIONS.items() for x in kv]), F.col(element_type))


def _exact(c: Column) -> Column:
    return c.cast("decimal(20,4)")


def _names(players: DataFrame, name: str = "web_name") -> DataFrame:
    return players.select("player_code", F.col("web_name").alias(name)).hint("merge")


def _seasons(player_seasons: DataFrame, *columns: str) -> DataFrame:
    return player_seasons.select(*columns).hint("merge")


def latest_prices(prices: DataFrame) -> DataFrame:
    """The newest snapshot of each player and season."""
    return latest_by(prices, KEY, ["snapshot_date"], [c for c in prices.columns if c not in KEY])


def player_totals(stats: DataFrame, players: DataFrame, player_seasons: DataFrame, prices: DataFrame) -> DataFrame:
    """Season totals of ten measures, rates per game, per 90 and per million at two places, and the newest price.

    Players without a price, a name or a season row are left out. Rates are
    null where their divisor is 0.
    """
    t = stats.groupBy(*KEY).agg(F.count_if(F.col("minutes") > 0).alias("games_played"), *[F.sum(c).alias(name) for name, c in SUMS.items()])
    now = latest_prices(prices).select(*KEY, "now_cost", "selected_by_percent", "status")
    t = t.join(now, KEY).join(_seasons(player_seasons, *KEY, "element_type", "team_code"), KEY).join(_names(players), "player_code")

    def rate(top: Column, below: Column, times: int = 1) -> Column:
        # Exact decimals: halves are then rounded as such.
        return F.round(safe_div(_exact(top) * times, _exact(below)), 2).cast("double")

    minutes = F.col("total_minutes")
    return t.withColumns(
        {
            "points_per_game": rate(F.col("total_points"), F.col("games_played")),
            "points_per_90": rate(F.col("total_points"), minutes, 90),
            "goals_per_90": rate(F.col("goals"), minutes, 90),
            "assists_per_90": rate(F.col("assists"), minutes, 90),
            "returns_per_90": rate(F.col("goals") + F.col("assists"), minutes, 90),
            "points_per_million": rate(F.col("total_points"), F.col("now_cost"), 10),
        }
    )


def rolling_view(stats: DataFrame) -> DataFrame:
    """Each week with the means of the last 3 and 5 weeks and of the season so far, at the view's places."""
    w = Window.partitionBy(*KEY).orderBy("event_id")
    three, five = w.rowsBetween(-2, 0), w.rowsBetween(-4, 0)
    mean = lambda c, over, digits: F.round(F.avg(F.col(c).cast("decimal(20,6)")).over(over), digits).cast("double")
    return stats.select(
        "season", "event_id", "player_code", "total_points", "minutes",
        mean("total_points", three, 2).alias("points_avg_3gw"), mean("total_points", five, 2).alias("points_avg_5gw"), mean("minutes", three, 1).alias("minutes_avg_3gw"),
        mean("minutes", five, 1).alias("minutes_avg_5gw"), mean("goals_scored", three, 2).alias("goals_avg_3gw"), mean("assists", three, 2).alias("assists_avg_3gw"),
        mean("bps", three, 1).alias("bps_avg_3gw"), mean("expected_goals", three, 3).alias("xg_avg_3gw"), mean("expected_assists", three, 3).alias("xa_avg_3gw"),
        mean("total_points", w, 2).alias("points_avg_season"),
    )


def ownership_movers(prices: DataFrame, players: DataFrame, player_seasons: DataFrame) -> DataFrame:
    """The newest snapshot of each player with names and net transfers."""
    rows = latest_prices(prices).join(_seasons(player_seasons, *KEY, "element_type", "team_code"), KEY).join(_names(players), "player_code")
    return rows.withColumn("net_transfers_event", F.col("transfers_in_event") - F.col("transfers_out_event"))


def last_predictions(predictions: DataFrame) -> DataFrame:
    """The predictions of each season's last predicted week, with predicted_gw."""
    last = predictions.groupBy("season").agg(F.max("event_id").alias("event_id"))  # a row a season
    return predictions.join(F.broadcast(last), ["season", "event_id"]).withColumnRenamed("event_id", "predicted_gw")


def player_rankings(totals: DataFrame, teams: DataFrame, predictions: DataFrame, season: str) -> DataFrame:
    """A season's totals with team names, positions, prices and what is predicted for the last predicted week."""
    told = last_predictions(predictions.where(F.col("season") == season)).select("player_code", "predicted_gw", *PREDICTED)
    rows = totals.where(F.col("season") == season).join(teams.select("team_code", F.col("short_name").alias("team")), "team_code").join(told, "player_code", "left")
    rows = rows.select(
        "player_code", "web_name", "element_type", "team", "now_cost", "total_points", "games_played", "points_per_90", "points_per_million", "selected_by_percent", "status", "predicted_gw", *PREDICTED
    )
    price = F.col("now_cost") / 10
    return rows.withColumns({"position": position(), "price": price, "predicted_value": safe_div(F.col("predicted_points"), price)})


def plan_rankings(rankings: DataFrame) -> DataFrame:
    """Rankings as a plan reads them: fewer columns, no prediction counts as 0."""
    return rankings.select("player_code", "web_name", "element_type", "team", "now_cost", "status", F.coalesce("predicted_points", F.lit(0.0)).alias("predicted_points"), "predicted_gw", "position", "price")


def squad(picks: DataFrame, players: DataFrame, player_seasons: DataFrame, teams: DataFrame, prices: DataFrame, predictions: DataFrame, season: str, entry_id: int) -> DataFrame:
    """A manager's picks of their last week with names, newest prices and last predictions, by squad position.

    Picks without a name, a season row, a team or a price are left out.
    """
    own = picks.where((F.col("entry_id") == entry_id) & (F.col("season") == season))
    own = own.join(F.broadcast(own.agg(F.max("event_id").alias("event_id"))), "event_id")
    # A week's picks are some dozen, so Spark sends them to the prices by itself; more of them shuffle.
    who = own.select("player_code").distinct()
    now = latest_prices(prices.where(F.col("season") == season).join(who, "player_code", "left_semi")).select("player_code", "now_cost")
    told = last_predictions(predictions.where(F.col("season") == season)).select("player_code", *PREDICTED)
    rows = (
        own.join(_names(players), "player_code")
        .join(_seasons(player_seasons.where(F.col("season") == season), "player_code", "element_type", "team_code"), "player_code")
        .join(teams.select("team_code", F.col("short_name").alias("team")), "team_code")
        .join(now, "player_code")
        .join(told, "player_code", "left")
    )
    return rows.select(
        "player_code", "squad_position", "multiplier", "is_captain", "is_vice_captain", "web_name", "element_type", "team", "now_cost", *PREDICTED, position().alias("position"), (F.col("now_cost") / 10).alias("price")
    ).orderBy("squad_position")


def plan_squad(rows: DataFrame) -> DataFrame:
    """A squad as a plan reads it: no prediction counts as 0."""
    return rows.select("player_code", "multiplier", "web_name", "element_type", "team", "now_cost", F.coalesce("predicted_points", F.lit(0.0)).alias("predicted_points"), "position", "price")


def manager_history(weeks: DataFrame, season: str, entry_id: int, newest_first: bool = True) -> DataFrame:
    """All weeks of a manager, in order."""
    mine = weeks.where((F.col("entry_id") == entry_id) & (F.col("season") == season))
    return mine.orderBy(F.col("event_id").desc() if newest_first else F.col("event_id"))


def last_ingested_week(stats: DataFrame, season: str) -> DataFrame:
    """One row: the last week with stats, or null."""
    return stats.where(F.col("season") == season).agg(F.max("event_id").alias("gw"))


def next_deadline(gameweeks: DataFrame, season: str, now: Column) -> DataFrame:
    """The unfinished week with the earliest deadline after ``now``; no row where there is none."""
    open_ = gameweeks.where((F.col("season") == season) & ~F.col("finished") & (F.col("deadline_time") > now))
    return open_.select("event_id", "name", "deadline_time").orderBy("deadline_time", "event_id").limit(1)


def season_fixtures(fixtures: DataFrame, season: str) -> DataFrame:
    return fixtures.where(F.col("season") == season).select(
        F.col("fpl_fixture_id").alias("fixture"), "event_id", "kickoff_time", "team_h_code", "team_a_code", "team_h_score", "team_a_score", "finished_provisional"
    )


def fixture_window(difficulty: DataFrame, player_seasons: DataFrame, season: str, start: int, horizon: int) -> DataFrame:
    """A row for each player and fixture of their team in the weeks [start, start + horizon)."""
    inside = difficulty.where((F.col("season") == season) & (F.col("event_id") >= start) & (F.col("event_id") < start + horizon))
    return player_seasons.where(F.col("season") == season).select("player_code", "team_code").join(inside.select("team_code", "event_id", "fixture_difficulty_score"), "team_code").drop("team_code")


def fixture_grid_rows(difficulty: DataFrame, teams: DataFrame, season: str, start: int, horizon: int) -> DataFrame:
    """The window with both teams' names, by team and week."""
    inside = difficulty.where((F.col("season") == season) & (F.col("event_id") >= start) & (F.col("event_id") < start + horizon))
    own, other = (teams.select(F.col("team_code").alias(c), F.col("short_name").alias(n)) for c, n in (("team_code", "team"), ("opponent_code", "opponent")))
    return inside.join(own, "team_code").join(other, "opponent_code").select("team", "opponent", "is_home", "event_id", "fixture_difficulty_score").orderBy("team", "event_id", "opponent")


def live_rows(stats: DataFrame, players: DataFrame, player_seasons: DataFrame, prices: DataFrame, season: str) -> DataFrame:
    """A season's stats in the shape of the archives: element, code, GW, name, position, value and availability flags."""
    now = latest_prices(prices.where(F.col("season") == season)).select("player_code", F.col("now_cost").alias("value"))
    who = _seasons(player_seasons.where(F.col("season") == season), "player_code", "element_type")
    rows = stats.where(F.col("season") == season).join(_names(players, "name"), "player_code").join(who, "player_code").join(now, "player_code")
    return rows.withColumn("code", F.col("player_code")).withColumns({"position": position(), "xg_data_available": F.lit(1), "dc_data_available": F.lit(1)}).withColumnsRenamed({"player_code": "element", "event_id": "GW"})


def experiment_ledger(registry: DataFrame, target: str, top: int = 50) -> DataFrame:
    """The newest experiments on a target: number of features, metrics and the gap between train and test."""
    rows = registry.where(F.col("is_experiment") & (F.col("target") == target)).orderBy(F.col("trained_at").desc(), "model_type").limit(top)
    return rows.select("trained_at", "model_type", F.size("features").alias("feature_count"), "r2", "mae", "rmse", F.get_json_object("diagnostics", "$.overfit_gap").try_cast("double").alias("overfit_gap"))


def newest_models(registry: DataFrame, like: str = "%", order: tuple[str, ...] = ("trained_at",)) -> DataFrame:
    """The newest row of each model type and target, of the types that match."""
    rows = registry.where(F.col("model_type").like(like))
    return latest_by(rows, ["model_type", "target"], list(order), [c for c in rows.columns if c not in ("model_type", "target")])


def top(rows: DataFrame, by: Column, n: int, tie: str, least: Column | None = None) -> DataFrame:
    """The first n rows by a figure, greatest first, without those that miss a condition or the figure."""
    kept = rows.where(by.isNotNull()) if least is None else rows.where(least & by.isNotNull())
    return kept.orderBy(by.desc(), tie).limit(n)


def form_leaders(rolling: DataFrame, weighted: DataFrame, n: int = 10) -> DataFrame:
    """The last week's rolling and weighted form side by side, best weighted form first."""
    last = rolling.groupBy("season").agg(F.max("event_id").alias("event_id"))
    both = rolling.join(F.broadcast(last), ["season", "event_id"]).join(weighted, ["season", "player_code"])
    return both.orderBy(F.col("weighted_form").desc_nulls_last(), "player_code").limit(n)


def codes_of(names: DataFrame, players: DataFrame) -> DataFrame:
    """web_name and player_code of names that belong to exactly one player; others have a null code."""
    one = players.groupBy("web_name").agg(F.count("*").alias("n"), F.min("player_code").alias("code"))
    return names.select("web_name").distinct().join(one, "web_name", "left").select("web_name", F.when(F.col("n") == 1, F.col("code")).alias("player_code"))


def worst_misses(scored: DataFrame, y: str, predicted: str, tie: str, n: int = 15) -> DataFrame:
    """The rows with the largest residuals."""
    return scored.withColumn("residual", F.col(y) - F.col(predicted)).orderBy(F.abs(F.col("residual")).desc(), tie).limit(n)


def naive_points(season_p90: str = "season_p90", season_minutes: str = "season_minutes_avg") -> Column:
    """The naive prediction: season rate times season minutes; what is unknown counts as 0."""
    zero = F.lit(0.0)
    return F.coalesce(season_p90, zero) * F.coalesce(season_minutes, zero) / 90


def decomposed_points(p90: str, minutes: str) -> Column:
    """A rate model's and a minutes model's predictions together; minutes stay within a match."""
    return F.col(p90) * F.least(F.lit(90.0), F.greatest(F.lit(0.0), F.col(minutes))) / 90


