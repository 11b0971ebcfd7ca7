"""Feature experiments: diagnostics, permutation importance, leaving groups out, backward elimination."""

from __future__ import annotations

import math
import random
from collections.abc import Callable

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.models.gram import gram
from scoreloom.models.metrics import bootstrap, regression
from scoreloom.models.training import assembler, design


def ols_diagnostics(df: DataFrame, features: list[str], label: str) -> dict:
    """Coefficients with p-values and 95 % intervals, R2 and the F test of an ordinary least-squares fit."""
    fit = gram(df, features, label).fit()
    return {"r2": fit.r2, "f_p_value": fit.f_p_value, "terms": fit.terms()}


#: Slices of a hashed order in which rows are numbered.
ORDER_SLICES = 1_024


def numbered(df: DataFrame, row_id: str, seed: int, name: str = "__i") -> DataFrame:
    """Rows numbered from 0 in a hashed order of their ids: numbers within slices of the order, and one offset a slice."""
    h = F.xxhash64(F.lit(seed), F.col(row_id))
    # Leading bits, so that slices follow one another in the order.
    rows = df.withColumns({"__h": h, "__s": F.shiftright(h, 54)})
    sizes = rows.groupBy("__s").agg(F.count("*").alias("__n"))
    offsets = sizes.select(F.col("__s").alias("__slice"), (F.sum("__n").over(Window.orderBy("__s")) - F.col("__n")).alias("__offset"))
    at = F.row_number().over(Window.partitionBy("__s").orderBy("__h", row_id)) - 1
    # At most ORDER_SLICES rows.
    return rows.withColumn("__at", at).join(F.broadcast(offsets), F.col("__s") == F.col("__slice")).withColumn(name, F.col("__offset") + F.col("__at")).drop("__h", "__s", "__n", "__slice", "__offset", "__at")


def deals(n: int, n_features: int, repeats: int, seed: int) -> list[tuple[int, int, int, int]]:
    """(feature, repeat, a, b) of the moves i -> (a * i + b) mod n, each a permutation, since a has no divisor of n."""
    rng = random.Random(seed)
    out = []
    for f in range(n_features):
        for r in range(repeats):
            a = 1
            while n > 2:
                a = rng.randrange(1, min(n, 2**31))
                if math.gcd(a, n) == 1 and (a > 1 or n < 5):
                    break
            out.append((f, r, a, rng.randrange(n) if n else 0))
    return out


def _gathered(sent: DataFrame, repeats: int) -> DataFrame:
    """What each row was sent, as a list with one value for each feature and repeat (in one number k on the way).

    Rows are spread before they are grouped: a task seldom has two values for
    one target, so lists made before the shuffle would only add their own size.
    """
    f, r = F.floor(F.col("k") / repeats).cast("long").alias("f"), (F.col("k") % repeats).cast("long").alias("r")
    return sent.repartition("__to").groupBy("__to").agg(F.collect_list(F.struct(f, r, "v")).alias("dealt"))


def permutation_importance(model, test: DataFrame, features: list[str], label: str, row_id: str, repeats: int = 10, seed: int = 42) -> DataFrame:
    """Loss of R2 when one feature's values are dealt out anew; mean and deviation over repeats, for all features in one job.

    Rows are numbered in a hashed order. For each feature and repeat a row
    sends its value to the row that a permutation of the numbers names; a row
    joins what it was sent, becomes one row for each feature and repeat, and
    is scored in the same stage. What remains of a feature and repeat is one
    sum of squares.
    """
    base = design(test, features, label)
    n = base.count()
    if not n:
        return test.sparkSession.createDataFrame([], "feature string, mean double, std double")
    rows = numbered(base, row_id, seed)
    moves = F.array(*[F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip("frab", d)]) for d in deals(n, len(features), repeats, seed)])
    x = F.array(*[F.col(f"__x_{i}") for i in range(len(features))])
    sent = rows.select("__i", x.alias("__x"), F.explode(moves).alias("d")).select(
        F.pmod(F.col("d.a") * F.col("__i") + F.col("d.b"), F.lit(n)).alias("__to"), F.col("d.f").alias("f"), F.col("d.r").alias("r"), F.get("__x", F.col("d.f").cast("int")).alias("v")
    ).select("__to", (F.col("f") * repeats + F.col("r")).cast("int").alias("k"), "v")
    got = _gathered(sent, repeats)
    plain = F.array(F.struct(F.lit(-1).cast("long").alias("f"), F.lit(0).cast("long").alias("r"), F.lit(0.0).alias("v")))
    each = rows.join(got, F.col("__i") == F.col("__to")).select(F.col(label).alias("__y"), *[f"__x_{i}" for i in range(len(features))], F.explode(F.concat(plain, "dealt")).alias("d"))
    changed = {f"__x_{i}": F.when(F.col("d.f") == i, F.col("d.v")).otherwise(F.col(f"__x_{i}")) for i in range(len(features))}
    squares = (F.col("__y") - F.col("prediction")) * (F.col("__y") - F.col("prediction"))
    told = model.transform(each.withColumns(changed)).groupBy(F.col("d.f").alias("f"), F.col("d.r").alias("r")).agg(F.sum(squares).alias("sse"), (F.var_pop("__y") * F.count("*")).alias("sst"))
    whole = told.where("f = -1").select(F.col("sse").alias("whole"))
    names = F.array(*map(F.lit, features))
    loss = told.where("f >= 0").join(F.broadcast(whole)).select(F.get(names, F.col("f").cast("int")).alias("feature"), ((F.col("sse") - F.col("whole")) / F.col("sst")).alias("loss"))
    return loss.groupBy("feature").agg(F.avg("loss").alias("mean"), F.coalesce(F.stddev_samp("loss"), F.lit(0.0)).alias("std"))


def impurity_importances(model, features: list[str]) -> list[tuple[str, float]]:
    """(feature, importance) of a fitted pipeline of trees, the greatest first; importances add up to 1."""
    told = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, told)), key=lambda x: (-x[1], x[0]))


def group_features(features: list[str]) -> dict[str, list[str]]:
    """Every feature in one group, by suffix and prefix; what fits none is other."""
    rules: list[tuple[str, Callable[[str], bool]]] = [
        ("form_3", lambda c: c.endswith("_roll3")),
        ("form_5", lambda c: c.endswith("_roll5")),
        ("position", lambda c: c.startswith("pos_")),
        ("prior_season", lambda c: c.startswith(("prior_", "had_prior"))),
        ("fixture", lambda c: c.startswith(("own_form", "opp_form"))),
    ]
    out: dict[str, list[str]] = {}
    for f in features:
        out.setdefault(next((g for g, ok in rules if ok(f)), "other"), []).append(f)
    return out


def leave_groups_out(df: DataFrame, features: list[str], label: str, row_id: str, is_train: F.Column, kind: Callable[[], object], draws: int = 1000) -> DataFrame:
    """A reference fit, and one without each group: R2, its change, and the paired p-value of the change."""
    data = df.withColumn("__train", is_train)

    def predict(columns: list[str], name: str) -> DataFrame:
        d = design(data, columns, label)
        model = Pipeline(stages=[assembler(columns), kind()]).fit(d.where("__train"))
        return model.transform(d.where("not __train")).select(row_id, label, F.col("prediction").alias(name))

    reference = predict(features, "reference").persist()
    base = reference.agg(*regression(label, "reference")).first()["r2"]
    out = [("all", base, 0.0, None)]
    for group, columns in group_features(features).items():
        rest = [f for f in features if f not in columns]
        if rest:
            both = reference.join(predict(rest, "without").drop(label), row_id).persist()
            r2 = both.agg(*regression(label, "without")).first()["r2"]
            out.append((group, r2, r2 - base, bootstrap(both, row_id, label, "without", "reference", draws).first()["p_value"]))
            both.unpersist()
    reference.unpersist()
    return df.sparkSession.createDataFrame(out, "left_out string, r2 double, delta double, p_value double")


def backward_elimination(fit: Callable[[list[str]], tuple[float, dict[str, float]]], features: list[str], drop: int = 4, least: int = 8) -> list[tuple[list[str], float]]:
    """Rounds of (features, validation R2): the least important are dropped until ``least`` remain.

    ``fit`` trains on some features and gives the validation R2 and importances.
    """
    rounds, now = [], list(features)
    while True:
        r2, importance = fit(now)
        rounds.append((list(now), r2))
        if len(now) <= least:
            return rounds
        weakest = sorted(now, key=lambda f: (importance.get(f, 0.0), f))[: min(drop, len(now) - least)]
        now = [f for f in now if f not in weakest]
