"""Model artefacts and their registry, feature-subset evaluation, scoring of the next week."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.models.metrics import bootstrap, regression
from scoreloom.models.training import assembler, design, regressors
from scoreloom.operators.asof import latest_at
from scoreloom.operators.teams import match_results, next_fixture

REGISTRY = "run_id string, model_type string, target string, features array<string>, params string, mae double, rmse double, r2 double, diagnostics string, artifact_path string, is_experiment boolean, trained_at timestamp"
LEAGUE_GOALS = 1.3
IDLE_DAYS = 14.0
CONGESTED_DAYS = 4.0


def save_model(model: PipelineModel, root: str, run_id: str, kind: str) -> str:
    """Write a fitted pipeline under a name of its own run; the name, not the path, goes to the registry."""
    name = f"{kind}-{run_id}"
    model.write().save(f"{root}/{name}")
    return name


def load_model(root: str, name: str) -> PipelineModel:
    return PipelineModel.load(f"{root}/{name}")


def register(spark: SparkSession, path: str, row: dict) -> None:
    """Append a run to the registry; what a run doesn't tell is null, params and diagnostics are JSON."""
    known = {**row, **{c: json.dumps(row[c], sort_keys=True) for c in ("params", "diagnostics") if row.get(c) is not None}}
    names = spark.createDataFrame([], REGISTRY).columns
    unknown = set(known) - set(names)
    if unknown:
        raise ValueError(f"the registry has no {sorted(unknown)}")
    spark.createDataFrame([tuple(known.get(c) for c in names)], REGISTRY).write.mode("append").parquet(path)


def evaluate_features(df: DataFrame, features: list[str], label: str, is_train: Column, row_id: str, kind: str = "linear_regression", fraction: float | None = None, draws: int = 1000, kinds: dict | None = None) -> DataFrame:
    """One row: test metrics and R2 interval of a model on a list of features, its train R2 and the gap between.

    ``fraction`` takes a share of the training rows by a hash of their id, for
    a quicker look; the test rows are always all.
    """
    data = design(df, features, label)
    train, test = data.where(is_train), data.where(~is_train)
    if fraction is not None:
        train = train.where(F.pmod(F.xxhash64(F.col(row_id)), F.lit(1_000_000)) < int(fraction * 1_000_000))
    model = Pipeline(stages=[assembler(features), (kinds or regressors(label))[kind]]).fit(train)
    scored = model.transform(test)
    ours = scored.agg(*regression(label, "prediction"))
    seen = model.transform(train).agg(*regression(label, "prediction")).select(F.col("r2").alias("train_r2"))
    interval = bootstrap(scored.withColumn("__flat", F.lit(0.0)), row_id, label, "prediction", "__flat", draws=draws).select("low", "high")
    out = ours.join(seen).join(interval)
    return out.withColumns({"overfit_gap": F.col("train_r2") - F.col("r2"), "model": F.lit(kind), "n_features": F.lit(len(features))})


def team_state(fixtures: DataFrame, keys: list[str], finished: str = "finished", n: int = 5) -> DataFrame:
    """Each team before its next fixture: opponent, place and time, form over the last n results, rest and congestion.

    Form without results is the league's mean of goals, or 1.3 before any.
    Rest without a match played is 14 days.
    """
    from pyspark.sql import Window

    coming = next_fixture(fixtures, keys, finished)
    played = match_results(fixtures, keys, finished=finished)
    w = Window.partitionBy("team").orderBy(F.col("kickoff").desc_nulls_first(), *[F.col(k).desc() for k in keys])
    form = played.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).groupBy("team").agg(F.avg("scored").alias("attack_form"), F.avg("conceded").alias("defense_form"))
    mean = F.broadcast(played.agg(F.coalesce(F.avg("scored"), F.lit(LEAGUE_GOALS)).alias("mean")))
    dated = played.where("kickoff is not null")
    last = latest_at(coming, dated, ["team"], "kickoff", "kickoff", ["kickoff"], ["kickoff"], ["opponent"]).select("team", F.col("kickoff").alias("last"))
    near = dated.select("team", F.col("kickoff").alias("at")).join(coming.select("team", "kickoff"), "team").where(F.col("at") >= F.col("kickoff") - F.expr("interval 14 days")).groupBy("team").agg(F.count("*").alias("matches_14d"))
    own = form.select("team", F.col("attack_form").alias("own_attack"), F.col("defense_form").alias("own_defense"))
    opp = form.select(F.col("team").alias("opponent"), F.col("attack_form").alias("opp_attack"), F.col("defense_form").alias("opp_defense"))
    rest = (F.col("kickoff").cast("timestamp").cast("double") - F.col("last").cast("timestamp").cast("double")) / 86400
    days = F.when(F.col("last").isNull(), IDLE_DAYS).otherwise(F.greatest(F.lit(0.0), rest))
    rows = coming.join(own, "team", "left").join(opp, "opponent", "left").join(last, "team", "left").join(near, "team", "left").join(mean)
    filled = {c: F.coalesce(c, "mean") for c in ("own_attack", "own_defense", "opp_attack", "opp_defense")}
    return rows.withColumns({**filled, "days_since": days, "matches_14d": F.coalesce("matches_14d", F.lit(0)), "is_congested": (days <= CONGESTED_DAYS).cast("double")}).drop("mean", "last")


def risk_interaction(injuries: str = "muscle_injuries_365d", congested: str = "is_congested") -> Column:
    """Muscle injuries of the last year, where the next match comes soon."""
    return F.col(injuries) * F.col(congested)


def score_next(model: PipelineModel, rows: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Predictions for rows of the next week: features the frame lacks count as 0, and none is below 0."""
    full = rows.withColumns({c: F.lit(0.0) for c in features if c not in rows.columns}).withColumn("__label", F.lit(0.0))
    scored = model.transform(design(full, features, "__label"))
    return scored.select(*keep, F.greatest(F.lit(0.0), F.col("prediction")).alias("predicted_points"))
