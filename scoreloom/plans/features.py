"""Leak-free features of a season archive: fixture context, collapse of double weeks, rolling form, prior season.

The steps are window and join expressions; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.functions.text import season_before
from scoreloom.operators.aggregates import collapse
from scoreloom.operators.windows import congestion
from scoreloom.semantics import positive_div
from scoreloom.sources.archive import DC_COLUMNS, STATS, XG_COLUMNS

WINDOWS = (3, 5)
ROLLED = ["total_points", "minutes", "goals_scored", "assists", "bps", "bonus", "clean_sheets", "influence", "creativity", "threat", "ict_index", "expected_goals", "expected_assists"]
PER_90 = ["total_points", "goals_scored", "assists", "expected_goals", "expected_assists", "expected_goals_conceded"]
VOLATILE = ["total_points", "minutes", "bps", "ict_index", "threat"]
IDLE_DAYS = 14.0


def fixture_results(rows: DataFrame) -> DataFrame:
    """One row a team and fixture: goals and expected goals for and against."""
    own, other = F.when(F.col("was_home"), F.col("team_h_score")).otherwise(F.col("team_a_score")), F.when(F.col("was_home"), F.col("team_a_score")).otherwise(F.col("team_h_score"))
    return rows.groupBy("season", "fixture", "team", "opponent").agg(
        F.first("kickoff_time").alias("kickoff_time"), F.first("was_home").alias("was_home"), F.first(own).alias("goals_for"), F.first(other).alias("goals_against"),
        F.sum(F.coalesce("expected_goals", F.lit(0.0))).alias("xg_for"), F.max(F.coalesce("expected_goals_conceded", F.lit(0.0))).alias("xg_against"), F.max("xg_data_available").alias("has_xg"),
    )


def team_context(results: DataFrame, n: int = 5) -> DataFrame:
    """Form before each fixture (the season's mean on the first), and congestion."""
    w = Window.partitionBy("season", "team").orderBy("kickoff_time", "fixture").rowsBetween(-n, -1)
    season = Window.partitionBy("season")
    out = {}
    for c in ("goals_for", "goals_against", "xg_for", "xg_against"):
        form = F.coalesce(F.avg(c).over(w), F.avg(c).over(season))
        out[f"form_{c}"] = F.when(F.col("has_xg") == 0, 0.0).otherwise(form) if c.startswith("xg") else form
    return congestion(results.withColumns(out), ["season", "team"], "kickoff_time", ["fixture"], 14, idle=IDLE_DAYS)


def attach_context(rows: DataFrame) -> DataFrame:
    """Player rows with their team's context and the opponent's form; teams a season are few, so this side is small."""
    ctx = team_context(fixture_results(rows))
    forms = [f"form_{c}" for c in ("goals_for", "goals_against", "xg_for", "xg_against")]
    own = ctx.select("season", "fixture", "team", *[F.col(c).alias(f"own_{c}") for c in forms], "days_since", F.col("recent_count").alias("matches_14d"), "is_congested")
    opp = ctx.select("season", "fixture", F.col("team").alias("opponent"), *[F.col(c).alias(f"opp_{c}") for c in forms])
    return rows.join(own, ["season", "fixture", "team"], "left").join(opp, ["season", "fixture", "opponent"], "left")


def injury_features(rows: DataFrame, injuries: DataFrame, returning_days: int = 14) -> DataFrame:
    """History of injuries strictly before each row: days since the last end, count in a year, returning, any history.

    Both sides lie on one time line by code; ends count by the latest seen so
    far, and the yearly count is a RANGE frame. Codes without any record have
    9999 days and zeros.
    """
    from scoreloom.semantics import DAY_US, micros

    q = rows.select("code", micros("kickoff_time").alias("us"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("until"), F.struct("season", "element", "GW").alias("q"))
    none = F.lit(None).cast(q.schema["q"].dataType)
    e = injuries.select("code", micros("injury_from").alias("us"), F.lit(1).alias("kind"), micros(F.coalesce("injury_until", F.date_add("injury_from", 9999))).alias("until"), none.alias("q"))
    line = q.unionByName(e)
    before = Window.partitionBy("code").orderBy("us", "kind").rowsBetween(Window.unboundedPreceding, -1)
    year = Window.partitionBy("code").orderBy("us").rangeBetween(-365 * DAY_US, -1)
    line = line.withColumns(
        {
            "last_until": F.max("until").over(before),
            "injuries_365d": F.count("until").over(year),
            "injury_data_available": (F.count("until").over(Window.partitionBy("code")) > 0).cast("int"),
        }
    ).where("kind = 0")
    days = F.when(F.col("last_until").isNotNull(), F.greatest(F.lit(0.0), (F.col("us") - F.col("last_until")) / DAY_US)).otherwise(9999.0)
    return line.select("code", "q.*", days.alias("days_since_injury"), "injuries_365d", (days <= returning_days).cast("int").alias("returning"), "injury_data_available")


def weekly(rows: DataFrame, context: list[str]) -> DataFrame:
    """One row a player and week: stats added up, attributes of the first fixture, context averaged."""
    firsts = ["code", "name", "position", "team", "opponent", "was_home", "kickoff_time", "value", "selected", "xg_data_available", "dc_data_available"]
    return collapse(rows, ["season", "element", "GW"], STATS + XG_COLUMNS + DC_COLUMNS, [c for c in firsts if c in rows.columns], context, ["kickoff_time", "fixture"])


def rolling_features(panel: DataFrame) -> DataFrame:
    """Form of the weeks before, season to date, volatility, trends and the three targets; never the row's own week."""
    w = Window.partitionBy("season", "element").orderBy("GW")
    past = {n: w.rowsBetween(-n, -1) for n in WINDOWS}
    season = w.rowsBetween(Window.unboundedPreceding, -1)
    out = {f"{c}_roll{n}": F.avg(c).over(past[n]) for n in WINDOWS for c in ROLLED}
    out |= {f"{c}_p90_roll{n}": positive_div(F.sum(c).over(past[n]) * 90.0, F.sum("minutes").over(past[n])) for n in WINDOWS for c in PER_90}
    out |= {f"{c}_std5": F.stddev_samp(c).over(past[5]) for c in VOLATILE}
    out |= {
        "points_max5": F.max("total_points").over(past[5]),
        "season_p90": positive_div(F.sum("total_points").over(season) * 90.0, F.sum("minutes").over(season)),
        "season_minutes_avg": F.avg("minutes").over(season),
        "season_points_baseline": F.avg("total_points").over(season),
    }
    panel = panel.withColumns(out)
    gated = {c: F.when(F.col("xg_data_available") == 0, 0.0).otherwise(F.coalesce(c, F.lit(0.0))) for c in panel.columns if c.startswith("expected_") and "_roll" in c}
    panel = panel.withColumns(gated)
    return panel.withColumns(
        {
            "points_trend": F.col("total_points_roll3") - F.col("total_points_roll5"),
            "minutes_trend": F.col("minutes_roll3") - F.col("minutes_roll5"),
            "goals_over_xg": F.col("goals_scored_roll5") - F.col("expected_goals_roll5"),
            "target_minutes": F.col("minutes"),
            "target_points_per90": positive_div(F.col("total_points") * 90.0, F.col("minutes")),
            "target_total_points": F.col("total_points"),
        }
    )


def prior_season(rows: DataFrame) -> DataFrame:
    """Each code's season before: points per 90 and per week; zeros and a flag where there is none."""
    s = rows.where("code is not null").groupBy("season", "code").agg(F.sum("total_points").alias("p"), F.sum("minutes").alias("m"), F.countDistinct("GW").alias("g"))
    return s.select("season", "code", F.coalesce(positive_div(F.col("p") * 90.0, F.col("m")), F.lit(0.0)).alias("prior_p90"), (F.col("p") / F.greatest("g", F.lit(1))).alias("prior_points_per_gw"))


def with_prior(panel: DataFrame, summary: DataFrame) -> DataFrame:
    before = summary.withColumnRenamed("season", "__before").withColumn("had_prior_season", F.lit(1))
    out = panel.withColumn("__before", season_before(F.col("season"))).join(before, ["__before", "code"], "left").drop("__before")
    return out.fillna(0, ["prior_p90", "prior_points_per_gw", "had_prior_season"])


def one_hot(df: DataFrame, column: str = "position", values: tuple[str, ...] = ("DEF", "FWD", "GKP", "MID"), prefix: str = "pos") -> DataFrame:
    """A fixed vocabulary, so that every season has the same columns."""
    return df.withColumns({f"{prefix}_{v}": F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for v in values})


def training_frame(rows: DataFrame) -> DataFrame:
    """Rows of :func:`scoreloom.sources.archive.seasons` with code and opponent (a name) to the design frame."""
    context = [f"{side}_form_{c}" for side in ("own", "opp") for c in ("goals_for", "goals_against", "xg_for", "xg_against")] + ["days_since", "matches_14d", "is_congested"]
    panel = rolling_features(weekly(attach_context(rows), context))
    return one_hot(with_prior(panel, prior_season(rows)))


def feature_columns(df: DataFrame) -> list[str]:
    """Design columns by family: rolling form, season to date, context, prior season, position. Volatility and trends stay out."""
    keep = [c for c in df.columns if c.endswith(("_roll3", "_roll5")) or c.startswith(("own_form", "opp_form", "pos_", "prior_"))]
    return keep + ["season_p90", "season_minutes_avg", "days_since", "matches_14d", "is_congested", "had_prior_season", "value", "xg_data_available"]


def next_week_rows(panel: DataFrame) -> DataFrame:
    """Each player's last week again, one week on and with empty stats: what is known before the next one."""
    last = panel.groupBy("season", "element").agg(F.max_by(F.struct(*[c for c in panel.columns if c not in ("season", "element")]), "GW").alias("r"))
    rows = last.select("season", "element", "r.*").withColumns({"GW": F.col("GW") + 1, **{c: F.lit(0.0) for c in STATS + XG_COLUMNS + DC_COLUMNS if c in panel.columns}})
    return panel.unionByName(rows.select(*panel.columns))
