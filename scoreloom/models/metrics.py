"""Model metrics as aggregates: one pass, no collected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators.selection import percentiles
from scoreloom.semantics import hash_uniform


def _err(y: str, p: str) -> Column:
    return F.col(y) - F.col(p)


def regression(y: str, p: str) -> list[Column]:
    """n, r2, mae and rmse as aggregate columns; r2 is null where y doesn't vary."""
    n = F.count(_err(y, p))
    sse = F.sum(_err(y, p) * _err(y, p))
    sst = F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y) / n
    return [n.alias("n"), F.when(sst > 0, 1 - sse / sst).alias("r2"), F.avg(F.abs(_err(y, p))).alias("mae"), F.sqrt(F.avg(_err(y, p) * _err(y, p))).alias("rmse")]


def by_period(df: DataFrame, period: str, y: str, p: str, least: int = 20) -> DataFrame:
    """Regression metrics of each period that has enough rows."""
    return df.groupBy(period).agg(*regression(y, p)).where(F.col("n") >= least)


def residuals(df: DataFrame, by: str, y: str, p: str) -> DataFrame:
    """Count, means, bias and MAE of each group."""
    return df.groupBy(by).agg(
        F.count("*").alias("n"), F.avg(y).alias("mean_actual"), F.avg(p).alias("mean_predicted"), F.avg(F.col(p) - F.col(y)).alias("bias"), F.avg(F.abs(_err(y, p))).alias("mae")
    )


def pinball(y: str, p: str, q: float) -> Column:
    return F.avg(F.greatest(q * _err(y, p), (q - 1) * _err(y, p)))


def calibration(y: str, p: str) -> Column:
    """Share of rows at or below the predicted quantile."""
    return F.avg((F.col(y) <= F.col(p)).cast("double"))


def crossing(low: str, mid: str, high: str) -> Column:
    return F.avg(((F.col(low) > F.col(mid)) | (F.col(mid) > F.col(high))).cast("double"))


def sorted_quantiles(*cols: str) -> list[Column]:
    """The predictions of independent quantile models, put in order."""
    s = F.array_sort(F.array(*cols))
    return [s[i].alias(c) for i, c in enumerate(cols)]


def auc_brier(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC AUC with ties at half, the Brier score and the base rate.

    Counts of each distinct score come first, so the running count is over
    scores in slices: each slice's total precedes it as an offset, and no task
    orders all scores.
    """
    s = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    s = s.withColumn("neg", F.col("n") - F.col("pos")).withColumn("slice", F.floor(F.col("s") * 1024))
    totals = s.groupBy("slice").agg(F.sum("neg").alias("t"))
    offsets = totals.withColumn("offset", F.coalesce(F.sum("t").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("slice", "offset")
    w = Window.partitionBy("slice").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = s.join(offsets, "slice").withColumn("below", F.col("offset") + F.coalesce(F.sum("neg").over(w), F.lit(0)))
    brier = df.agg(F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))).alias("brier"), F.avg(F.col(label).cast("double")).alias("base_rate"))
    area = ranked.agg((F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))
    return area.join(F.broadcast(brier))


def poisson_cuts() -> list[float]:
    """Shares of Poisson(1) draws of at most 0, 1, ... 7."""
    out, mass, total = [], 0.36787944117144233, 0.0
    for k in range(8):
        total += mass
        out.append(total)
        mass /= k + 1
    return out


def replicate_weight(seed: int, replicate: Column, row_id: Column) -> Column:
    """A Poisson(1) count (8 at most) for a row in a bootstrap replicate, from a hash: the same under any partitioning."""
    u = hash_uniform(seed, row_id, replicate)
    out = F.lit(8)
    for k, cut in reversed(list(enumerate(poisson_cuts()))):
        out = F.when(u < cut, k).otherwise(out)
    return out


def bootstrap(df: DataFrame, row_id: str, y: str, a: str, b: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """R2 of model a with its 95 % interval, and the paired two-sided p-value of a against b, at most 1.

    Every row meets every replicate with a hashed Poisson count and only five
    sums a replicate remain. Row ids are whole numbers.
    """
    r = df.select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("__r"))
    w = replicate_weight(seed, F.col("__r"), F.col(row_id)).cast("double")
    ea, eb = _err(y, a), _err(y, b)
    sums = r.withColumn("__w", w).groupBy("__r").agg(
        F.sum("__w").alias("n"), F.sum(F.col("__w") * F.col(y)).alias("sy"), F.sum(F.col("__w") * F.col(y) * F.col(y)).alias("syy"),
        F.sum(F.col("__w") * ea * ea).alias("sa"), F.sum(F.col("__w") * eb * eb).alias("sb"),
    )
    sst = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    each = sums.select((1 - F.col("sa") / sst).alias("r2"), ((F.col("sb") - F.col("sa")) / F.col("n")).alias("gain"))
    ci = F.percentile("r2", F.array(F.lit(0.025), F.lit(0.975)))
    below, above = F.avg((F.col("gain") <= 0).cast("double")), F.avg((F.col("gain") >= 0).cast("double"))
    return each.agg(F.avg("r2").alias("r2"), ci[0].alias("low"), ci[1].alias("high"), F.least(F.lit(1.0), 2 * F.least(below, above)).alias("p_value"))


def calibration_curve(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Mean score and share of positives in bins between score quantiles; equal edges merge."""
    edges = [e for e in percentiles(df, score, [i / bins for i in range(1, bins)]) if e is not None]
    at = F.size(F.filter(F.array(*map(F.lit, edges)).cast("array<double>"), lambda e: e < F.col(score)))
    return df.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("positive_rate"))


def calibration_by_segment(df: DataFrame, y: str, p: str, minutes: str, least: float = 75.0) -> DataFrame:
    """Share of rows at or below the predicted quantile, for regular starters and the others (unknown minutes among them)."""
    return df.groupBy(F.when(F.col(minutes) >= least, "starter").otherwise("other").alias("segment")).agg(F.count("*").alias("n"), calibration(y, p).alias("rate"))
