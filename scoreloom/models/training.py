"""Training, selection and scoring of models with Spark ML."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.models.metrics import auc_brier, pinball, regression

SEED = 42


def regressors(label: str, trees: int = 200, rounds: int = 300) -> dict[str, object]:
    """The three model kinds, with the settings of the reference figures."""
    common = {"labelCol": label, "featuresCol": "features", "predictionCol": "prediction"}
    return {
        "linear_regression": LinearRegression(solver="normal", **common),
        "random_forest": RandomForestRegressor(numTrees=trees, maxDepth=6, minInstancesPerNode=10, featureSubsetStrategy="all", seed=SEED, **common),
        "boosted": GBTRegressor(maxIter=rounds, maxDepth=5, stepSize=0.05, seed=SEED, **common),
    }


def classifiers(label: str, trees: int = 200, rounds: int = 100) -> dict[str, object]:
    common = {"labelCol": label, "featuresCol": "features"}
    return {
        "logistic": LogisticRegression(maxIter=1000, weightCol="weight", **common),
        "random_forest": RandomForestClassifier(numTrees=trees, maxDepth=6, minInstancesPerNode=10, weightCol="weight", seed=SEED, **common),
        "boosted": GBTClassifier(maxIter=rounds, maxDepth=5, stepSize=0.05, seed=SEED, **common),
    }


def design(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """Rows with a label, missing features as 0."""
    return df.where(F.col(label).isNotNull()).select("*", *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"__x_{i}") for i, c in enumerate(features)])


def assembler(features: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=[f"__x_{i}" for i in range(len(features))], outputCol="features")


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Weight n / (2 * n of the class), from a two-row aggregate."""
    n = F.broadcast(df.groupBy(label).agg(F.count("*").alias("__n")))
    total = F.broadcast(df.agg(F.count("*").alias("__t")))
    return df.join(n, label).join(total).withColumn("weight", F.col("__t") / (2 * F.col("__n"))).drop("__n", "__t")


def _told(metrics: DataFrame, model: str) -> DataFrame:
    """One row of metrics, computed now, so that what it was computed from may go."""
    return metrics.sparkSession.createDataFrame(metrics.collect(), metrics.schema).withColumn("model", F.lit(model))


def fit_regressors(df: DataFrame, features: list[str], label: str, baseline: str, is_train: F.Column, kinds: dict | None = None) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Models, and their test metrics with those of the baseline (its gaps filled with the train mean)."""
    data = design(df, features, label).withColumn("__train", is_train)
    train, test = data.where("__train").persist(), data.where("not __train").persist()
    mean = train.agg(F.avg(baseline)).first()[0] or 0.0
    out = [_told(test.withColumn("p", F.coalesce(baseline, F.lit(mean))).agg(*regression(label, "p")), "baseline")]
    models = {}
    for name, kind in (kinds or regressors(label)).items():
        models[name] = Pipeline(stages=[assembler(features), kind]).fit(train)
        out.append(_told(models[name].transform(test).agg(*regression(label, "prediction")), name))
    train.unpersist()
    test.unpersist()
    return models, reduce(DataFrame.unionByName, out)


def fit_classifiers(df: DataFrame, features: list[str], points: str, least: float, is_train: F.Column, kinds: dict | None = None) -> DataFrame:
    """AUC, Brier score and base rate of the models that tell who reaches ``least`` points."""
    data = design(df, features, points).withColumns({"label": (F.col(points) >= least).cast("double"), "__train": is_train})
    train, test = balanced(data.where("__train"), "label").persist(), data.where("not __train").persist()
    out = []
    for name, kind in (kinds or classifiers("label")).items():
        scored = Pipeline(stages=[assembler(features), kind]).fit(train).transform(test).withColumn("score", vector_to_array("probability")[1])
        out.append(_told(auc_brier(scored, "label", "score"), name))
    train.unpersist()
    test.unpersist()
    return reduce(DataFrame.unionByName, out)


def quantile_forest(train: DataFrame, test: DataFrame, features: list[str], label: str, row_id: str, quantiles=(0.1, 0.5, 0.9), trees: int = 50) -> DataFrame:
    """Quantiles of the training labels that share leaves with each test row (Meinshausen 2006).

    The other way to quantiles, beside :mod:`scoreloom.models.boosting`: a
    forest's leaves serve as neighbourhoods, labels are counted per (tree, leaf, value), and a test row
    adds up its trees' shares of each value.
    """
    forest = RandomForestRegressor(numTrees=trees, maxDepth=6, minInstancesPerNode=20, seed=SEED, labelCol=label, featuresCol="features", leafCol="leaves")
    model = Pipeline(stages=[assembler(features), forest]).fit(design(train, features, label))

    def leaves(df: DataFrame, *keep: str) -> DataFrame:
        told = model.transform(design(df, features, label))
        return told.select(*keep, F.posexplode(vector_to_array("leaves")).alias("tree", "leaf"))

    counts = leaves(train, label).groupBy("tree", "leaf", F.col(label).alias("__y")).agg(F.count("*").alias("n"))
    share = counts.withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy("tree", "leaf"))).select("tree", "leaf", "__y", "w")
    mass = leaves(test, row_id, label).join(share, ["tree", "leaf"]).groupBy(row_id, label, "__y").agg((F.sum("w") / trees).alias("w"))
    upto = F.sum("w").over(Window.partitionBy(row_id).orderBy("__y"))
    ranked = mass.withColumn("upto", upto)
    return ranked.groupBy(row_id, label).agg(*[F.min(F.when(F.col("upto") >= q - 1e-9, F.col("__y"))).alias(f"q{round(q * 100)}") for q in quantiles])


def quantile_scores(df: DataFrame, label: str, quantiles=(0.1, 0.5, 0.9)) -> DataFrame:
    return df.agg(*[pinball(label, f"q{round(q * 100)}", q).alias(f"pinball_{round(q * 100)}") for q in quantiles])


def walk_forward(df: DataFrame, season: str, folds: list[tuple[list[str], str]], fit) -> DataFrame:
    """Expanding folds: ``fit(train_or_test_frame, is_train)`` gives metrics of each; a row a fold and model."""
    out = None
    for k, (train, test) in enumerate(folds, 1):
        rows = fit(df.where(F.col(season).isin(*train, test)), F.col(season).isin(*train)).withColumn("fold", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return out


def best_model(registry: DataFrame, target: str, metric: str) -> DataFrame:
    """The registry row with the lowest metric, the newest of equals, with an artefact."""
    rows = registry.where((F.col("target") == target) & F.col("artifact_path").isNotNull())
    return rows.orderBy(F.col(metric).asc_nulls_last(), F.col("trained_at").desc()).limit(1)
