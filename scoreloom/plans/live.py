"""The design columns of the models by name, for past weeks and for the coming one, and its scoring in one flow."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.text import season_before
from scoreloom.models import boosting
from scoreloom.models.metrics import sorted_quantiles
from scoreloom.models.registry import risk_interaction, team_state
from scoreloom.models.training import design
from scoreloom.operators.bands import MUSCLE_WORDS, contains_any
from scoreloom.operators.merge import replace_slice
from scoreloom.plans.features import attach_context, injury_features, one_hot, weekly
from scoreloom.semantics import positive_div
from scoreloom.sources.archive import DC_COLUMNS, STATS, XG_COLUMNS

# Names of the design columns, and the statistics whose form is taken over windows of 3 and 5 weeks.
PLAIN = [
    "price", "dc_data_available", "xg_data_available",
    "season_points_per90_avg", "season_minutes_avg",
    "had_prior_season", "prev_season_points_per90", "prev_season_minutes_avg", "prev_season_total_points",
    "was_home", "own_attack_form", "own_defense_form", "opp_attack_form", "opp_defense_form",
    "days_since_last_match", "matches_last_14d", "is_congested",
    "days_since_last_injury", "injuries_last_365d", "is_returning_from_injury", "injury_data_available",
    "muscle_injuries_last_365d", "injury_congestion_risk",
]
PER_90 = {"points_per90": "total_points", "goals_per90": "goals_scored", "assists_per90": "assists", "xg_per90": "expected_goals", "xa_per90": "expected_assists", "xgc_per90": "expected_goals_conceded"}
MEANS = {"minutes": "minutes", "bps": "bps", "ict_index": "ict_index", "dc": "defensive_contribution", "starts_rate": "starts", "threat": "threat", "creativity": "creativity"}
WINDOWS = (3, 5)
DESIGN = PLAIN + [f"{name}_roll{n}" for n in WINDOWS for name in [*PER_90, *MEANS]]
POSITIONS = ("DEF", "FWD", "GKP", "MID")
#: What needs a family of columns that came later, and is 0 before.
GATES = {"xg_data_available": ("xg_per90", "xa_per90", "xgc_per90", "starts_rate"), "dc_data_available": ("dc",)}
TARGETS = ("target_total_points", "target_minutes", "target_points_per90")
IDS = ["season", "element", "GW"]
#: Days without a match played, and without an injury on record.
IDLE_DAYS, NO_INJURY_DAYS = 14.0, 9999.0


def rolling(panel: DataFrame) -> DataFrame:
    """Form columns of a weekly panel, from the weeks before each; columns whose family isn't there yet are 0."""
    w = Window.partitionBy("season", "element").orderBy("GW")
    season = w.rowsBetween(Window.unboundedPreceding, -1)

    def rate(c: str, frame) -> Column:
        return positive_div(F.sum(c).over(frame) * 90.0, F.sum("minutes").over(frame))

    out = {}
    for n in WINDOWS:
        past = w.rowsBetween(-n, -1)
        out |= {f"{name}_roll{n}": rate(c, past) for name, c in PER_90.items()}
        out |= {f"{name}_roll{n}": F.avg(c).over(past) for name, c in MEANS.items()}
    for flag, names in GATES.items():
        for c in [f"{name}_roll{n}" for n in WINDOWS for name in names]:
            out[c] = F.when(F.col(flag) == 0, 0.0).otherwise(F.coalesce(out[c], F.lit(0.0)))
    return panel.withColumns(out | {"season_points_per90_avg": rate("total_points", season), "season_minutes_avg": F.avg("minutes").over(season), "price": F.col("value")})


def season_summaries(rows: DataFrame) -> DataFrame:
    """Each code's whole seasons: points per 90 (0 without minutes), minutes a week, points."""
    s = rows.where("code is not null").groupBy("season", "code").agg(F.sum("total_points").alias("p"), F.sum("minutes").alias("m"), F.countDistinct("GW").alias("g"))
    return s.select(
        "season", "code", F.coalesce(positive_div(F.col("p") * 90.0, F.col("m")), F.lit(0.0)).alias("prev_season_points_per90"),
        (F.col("m") / F.greatest("g", F.lit(1))).alias("prev_season_minutes_avg"), F.col("p").cast("double").alias("prev_season_total_points"),
    )


def with_previous(panel: DataFrame, summaries: DataFrame) -> DataFrame:
    """A panel with the season before of each code; zeros and no flag where there is none."""
    before = summaries.withColumnRenamed("season", "__before").withColumn("had_prior_season", F.lit(1))
    out = panel.withColumn("__before", season_before(F.col("season"))).join(before, ["__before", "code"], "left").drop("__before")
    return out.fillna(0, ["had_prior_season", *[c for c in summaries.columns if c.startswith("prev_")]])


def with_injuries(panel: DataFrame, injuries: DataFrame) -> DataFrame:
    """A panel with its injury columns as of kickoff_time, of all injuries and of those to muscles and tendons.

    ``injuries`` has code, injury_type, injury_from and injury_until. Rows
    without a code or a time have no history.
    """
    dated = panel.where("code is not null and kickoff_time is not null")
    keys = ["code", *IDS]
    every = injury_features(dated, injuries).select(
        *keys, F.col("days_since_injury").alias("days_since_last_injury"), F.col("injuries_365d").alias("injuries_last_365d"), F.col("returning").alias("is_returning_from_injury"), "injury_data_available"
    )
    muscle = injury_features(dated, injuries.where(contains_any(F.col("injury_type"), MUSCLE_WORDS))).select(*keys, F.col("injuries_365d").alias("muscle_injuries_last_365d"))
    out = panel.join(every, keys, "left").join(muscle, keys, "left").fillna(NO_INJURY_DAYS, ["days_since_last_injury"])
    out = out.fillna(0, ["injuries_last_365d", "is_returning_from_injury", "injury_data_available", "muscle_injuries_last_365d"])
    return out.withColumn("injury_congestion_risk", risk_interaction("muscle_injuries_last_365d", "is_congested"))


def _aligned(panel: DataFrame) -> DataFrame:
    """The design columns as doubles (missing columns are 0), position flags, and what tells rows apart."""
    flagged = one_hot(panel)
    known = set(flagged.columns)
    x = [F.col(c).cast("double").alias(c) if c in known else F.lit(0.0).alias(c) for c in [*DESIGN, *[f"pos_{p}" for p in POSITIONS]]]
    return flagged.select(*[c for c in [*IDS, "code", "name", "position", "kickoff_time", *TARGETS] if c in known], *x)


def design_frame(rows: DataFrame, injuries: DataFrame) -> DataFrame:
    """Past weeks of :func:`scoreloom.sources.archive.seasons` (with code and opponent) with the 49 design columns, position flags and targets.

    One row a season, player and week; its own week is in none of its columns.
    """
    context = {"own_form_goals_for": "own_attack_form", "own_form_goals_against": "own_defense_form", "opp_form_goals_for": "opp_attack_form", "opp_form_goals_against": "opp_defense_form", "days_since": "days_since_last_match", "matches_14d": "matches_last_14d", "is_congested": "is_congested"}
    panel = rolling(weekly(attach_context(rows), list(context))).withColumnsRenamed({k: v for k, v in context.items() if k != v})
    panel = with_injuries(with_previous(panel, season_summaries(rows)), injuries)
    targets = {"target_total_points": F.col("total_points"), "target_minutes": F.col("minutes"), "target_points_per90": positive_div(F.col("total_points") * 90.0, F.col("minutes"))}
    return _aligned(panel.withColumns(targets))


def coming_frame(rows: DataFrame, earlier: DataFrame, fixtures: DataFrame, injuries: DataFrame, now: Column | None = None) -> DataFrame:
    """One row a player of ``rows`` (one season so far): the design columns before the coming week.

    Each player's last week is repeated one week on with empty stats, so that
    the forms see all weeks played. Team, opponent, place, rest and congestion
    come from the team's next fixture in ``fixtures`` (home, away, scores,
    kickoff, finished); without one, injuries are as of ``now``. ``earlier``
    has the rows of seasons before.
    """
    panel = weekly(rows, [])
    last = panel.groupBy("season", "element").agg(F.max_by(F.struct(*[c for c in panel.columns if c not in ("season", "element")]), "GW").alias("r"))
    empty = {c: F.lit(0.0) for c in STATS + XG_COLUMNS + DC_COLUMNS}
    coming = last.select("season", "element", "r.*").withColumns({"GW": F.col("GW") + 1, **empty, "__coming": F.lit(True)})
    # withColumns puts new columns last, names decide.
    both = panel.withColumn("__coming", F.lit(False)).unionByName(coming)
    formed = rolling(both).where("__coming").drop("__coming", "opponent", "was_home", "kickoff_time")
    state = team_state(fixtures, [c for c in fixtures.columns if c not in ("home", "away", "home_score", "away_score", "kickoff", "finished")])
    names = {"own_attack": "own_attack_form", "own_defense": "own_defense_form", "opp_attack": "opp_attack_form", "opp_defense": "opp_defense_form", "days_since": "days_since_last_match", "matches_14d": "matches_last_14d"}
    told = state.withColumnsRenamed(names).select("team", *names.values(), "is_congested", F.col("is_home").cast("double").alias("was_home"), F.col("kickoff").cast("timestamp").alias("kickoff_time"))
    out = formed.join(told, "team", "left").fillna(IDLE_DAYS, ["days_since_last_match"])
    out = out.withColumn("kickoff_time", F.coalesce("kickoff_time", now if now is not None else F.current_timestamp()))
    return _aligned(with_injuries(with_previous(out, season_summaries(earlier)), injuries))


def predictions(frame: DataFrame, model_id: str, points: PipelineModel, features: list[str], hauls: dict[str, PipelineModel] | None = None, quantiles: boosting.Boosted | None = None) -> DataFrame:
    """season, event_id, player_code, model_id and the predictions of each row of a design frame.

    predicted_points has three places, the probabilities of ``hauls`` (6 and
    10 points, by names p_return_6plus and p_haul_10plus) four, and floor,
    median and ceiling three, in order. What has no model is null; features
    that the frame lacks count as 0.
    """
    full = frame.withColumns({c: F.lit(0.0) for c in features if c not in frame.columns}).withColumn("__label", F.lit(0.0))
    scored = points.transform(design(full, features, "__label")).withColumn("predicted_points", F.round("prediction", 3))
    scored = scored.drop("prediction", "features")
    for name in ("p_return_6plus", "p_haul_10plus"):
        model = (hauls or {}).get(name)
        if model is None:
            scored = scored.withColumn(name, F.lit(None).cast("double"))
        else:
            told = model.transform(scored).withColumn(name, F.round(vector_to_array("probability")[1], 4))
            scored = told.select(*scored.columns, name)
    rows = scored.select("season", F.col("GW").alias("event_id"), F.col("code").alias("player_code"), F.lit(model_id).alias("model_id"), "predicted_points", "p_return_6plus", "p_haul_10plus", *[f"`{c}`" for c in (quantiles.features if quantiles else [])])
    bounds = ["floor_points", "median_points", "ceiling_points"]
    kept = ["season", "event_id", "player_code", "model_id", "predicted_points", "p_return_6plus", "p_haul_10plus"]
    if quantiles is None:
        return rows.select(*kept, *[F.lit(None).cast("double").alias(c) for c in bounds])
    ordered = boosting.predict(rows, quantiles, bounds).select(*kept, *sorted_quantiles(*bounds))
    return ordered.select(*kept, *[F.round(c, 3).alias(c) for c in bounds])


def publish(rows: DataFrame, path: str) -> None:
    """Put predictions in place of all that the table has for their season and week; other weeks stay."""
    replace_slice(rows, path, ["season", "event_id"])
