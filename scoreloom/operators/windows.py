"""Rolling, lagged and running features of keyed, ordered panels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators.slices import BEFORE, UP_TO, Line, count_before
from scoreloom.semantics import DAY_US, micros, positive_div

#: Weights of the last five rows, most recent first.
FORM_WEIGHTS = (0.40, 0.25, 0.15, 0.12, 0.08)


def _w(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def _exact(value: str, exact: int | None) -> Column:
    """The value; with so many exact decimals a sum doesn't depend on the order of addition."""
    return F.col(value) if exact is None else F.col(value).cast(f"decimal(18,{exact})")


def _total(c: Column, exact: int | None) -> Column:
    return c if exact is None else c.cast("double")


def _mean(value: str, w: Window, exact: int | None) -> Column:
    if exact is None:
        return F.avg(value).over(w)
    return _total(F.sum(_exact(value, exact)).over(w), exact) / F.nullif(F.count(value).over(w), F.lit(0))


def _running(value: str, exact: int | None) -> dict[str, tuple[str, Column]]:
    return {"__sum": ("sum", _exact(value, exact)), "__count": ("count", F.col(value))}


def rolling_form(df: DataFrame, keys: list[str], order: list, value: str, windows: tuple[int, ...] = (3, 5), exact: int | None = None) -> DataFrame:
    """Means of the last n rows with the current one, and the running mean of the key."""
    line = Line(df, keys, order).rows(max(windows) - 1, lambda w: {f"form_{n}": _mean(value, w.rowsBetween(1 - n, 0), exact) for n in windows})
    out = line.running(lambda w: w, _running(value, exact)).done()
    return out.withColumn("form_all", _total(F.col("__sum"), exact) / F.nullif(F.col("__count"), F.lit(0))).drop("__sum", "__count")


def leakfree_form(df: DataFrame, keys: list[str], order: list, value: str, windows: tuple[int, ...] = (3, 5), exact: int | None = None) -> DataFrame:
    """Features of the rows before the current one only: means, deviation, maximum, running sum and mean."""

    def near(w: Window) -> dict[str, Column]:
        five = w.rowsBetween(-5, -1)
        out = {f"prior_mean_{n}": _mean(value, w.rowsBetween(-n, -1), exact) for n in windows}
        return out | {"prior_std_5": F.stddev_samp(value).over(five), "prior_max_5": F.max(value).over(five)}

    out = Line(df, keys, order).rows(max(5, *windows), near).running(BEFORE, _running(value, exact)).done()
    total = _total(F.col("__sum"), exact)
    return out.withColumns({"prior_sum": total, "prior_mean": total / F.nullif(F.col("__count"), F.lit(0))}).drop("__sum", "__count")


def prior_rate(df: DataFrame, keys: list[str], order: list, value: str, per: str, name: str, n: int = 5, unit: float = 90.0) -> DataFrame:
    """Sum of value by sum of ``per`` over the n rows before, times ``unit``; null unless the divisor is positive."""

    def rate(w: Window) -> dict[str, Column]:
        before = w.rowsBetween(-n, -1)
        return {name: positive_div(F.sum(value).over(before) * F.lit(unit), F.sum(per).over(before))}

    return Line(df, keys, order).rows(n, rate).done()


def weighted_form(df: DataFrame, keys: list[str], order: list, value: str, weights: tuple[float, ...] = FORM_WEIGHTS) -> DataFrame:
    """Recency-weighted mean of the last rows with the current one; weights of rows that aren't there drop out.

    A row counts if it exists, so a null value takes its weight and adds nothing.
    """

    def weighted(w: Window) -> dict[str, Column]:
        num, den = F.lit(0.0), F.lit(0.0)
        for k, x in enumerate(weights):
            num = num + F.coalesce(F.lag(value, k).over(w), F.lit(0.0)) * x
            den = den + F.when(F.lag(F.lit(1), k).over(w) == 1, x).otherwise(0.0)
        return {"weighted_form": num / den}

    return Line(df, keys, order).rows(len(weights) - 1, weighted).done()


def deltas(df: DataFrame, keys: list[str], order: list, values: list[str]) -> DataFrame:
    """Change against the row before; null on the first."""
    return Line(df, keys, order).rows(1, lambda w: {f"{v}_change": F.col(v) - F.lag(v).over(w) for v in values}).done()


def congestion(df: DataFrame, keys: list[str], ts: str, tie: list, days: int, idle: float | None = None, short: float = 4.0) -> DataFrame:
    """Days since the key's row before (fractions), rows in the days before, and whether the gap is short.

    The count is of earlier rows in order that are at most ``days`` old. A
    first row has ``idle`` days (null if not given), and its count is 0, as is
    that of a row without time.
    """
    line = Line(df.withColumn("__us", micros(ts)), keys, ["__us", *tie])
    gap = lambda w: {"days_since": F.coalesce((F.col("__us") - F.lag("__us").over(w)) / F.lit(float(DAY_US)), F.lit(idle).cast("double"))}
    out = line.rows(1, gap).done()
    # Of rows at the same instant, only those earlier in order count.
    same = Window.partitionBy(*keys, "__us")
    out = out.withColumn("__here", F.count("*").over(same) - F.row_number().over(same.orderBy(*tie)) + 1)
    if line.cut:
        out = count_before(out, keys, "__us", F.lit(True), days * DAY_US, "__near", closed=True)
    else:
        out = out.withColumn("__near", F.count("*").over(Window.partitionBy(*keys).orderBy("__us").rangeBetween(-days * DAY_US, 0)))
    out = out.withColumns({"recent_count": F.when(F.col("__us").isNotNull(), F.col("__near") - F.col("__here")).otherwise(0), "is_congested": (F.col("days_since") <= short).cast("int")})
    return out.drop("__us", "__near", "__here")


def running_total(df: DataFrame, keys: list[str], order: list, value: str | Column, name: str = "running") -> DataFrame:
    return Line(df, keys, order).running(UP_TO, {name: ("sum", F.col(value) if isinstance(value, str) else value)}).done()


def first_then_mean(df: DataFrame, keys: list[str], order: list, value: str, season: list[str], n: int = 5) -> Column:
    """Mean of the n rows before; the first row of a key takes the mean of its whole season."""
    w = _w(keys, order).rowsBetween(-n, -1)
    return F.coalesce(F.avg(value).over(w), F.avg(value).over(Window.partitionBy(*season)))


def form_or_mean(df: DataFrame, keys: list[str], order: list, value: str, season: list[str], name: str, n: int = 5) -> DataFrame:
    """``df`` with :func:`first_then_mean` as a column, where a season has too many rows for a window: its mean is one row that is joined."""
    means = df.groupBy(*[F.col(c).alias(f"__{c}") for c in season]).agg(F.avg(value).alias("__mean"))  # a row a season
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in season])
    told = df.withColumn("__form", F.avg(value).over(_w(keys, order).rowsBetween(-n, -1))).join(F.broadcast(means), same)
    return told.select(*df.columns, F.coalesce("__form", "__mean").alias(name))


def capped_fold(df: DataFrame, keys: list[str], step: str, used: str, cap: int = 5, first: int = 1, width: int = 1024) -> DataFrame:
    """Free moves left after a fold over the steps of each key.

    It starts at 1; every step from the second on takes what it used and adds
    one, never below 0 before or above ``cap`` after. A step is a shift and a
    clamp, and a run of such maps is one of their kind, so slices of ``width``
    step numbers become one map each, and no array holds a key's whole history.
    """
    kind = "struct<s:long, lo:long, hi:long>"
    same = F.struct(F.lit(0).alias("s"), F.lit(-(1 << 40)).alias("lo"), F.lit(1 << 40).alias("hi")).cast(kind)

    def then(a, b):
        """The map that applies a, then b."""
        held = lambda x: F.least(b["hi"], F.greatest(b["lo"], x + b["s"]))
        return F.struct((a["s"] + b["s"]).alias("s"), held(a["lo"]).alias("lo"), held(a["hi"]).alias("hi")).cast(kind)

    def folded(at: str):
        return F.aggregate(F.array_sort(F.collect_list(F.struct(at, "m"))), same, lambda a, x: then(a, x["m"]))

    one = F.struct((1 - F.col(used)).alias("s"), F.lit(1).alias("lo"), F.lit(cap).alias("hi")).cast(kind)
    steps = df.withColumns({"m": F.when(F.col(step) > first, one).otherwise(same), "__slice": F.floor(F.col(step) / width)})
    slices = steps.groupBy(*keys, "__slice").agg(folded(step).alias("m"))
    whole = slices.groupBy(*keys).agg(folded("__slice").alias("m"))
    return whole.select(*keys, F.least("m.hi", F.greatest("m.lo", F.lit(1) + F.col("m.s"))).alias("free_moves"))
