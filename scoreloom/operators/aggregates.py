"""Group summaries: totals with guarded ratios, collapses, shares, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators.selection import percentiles
from scoreloom.semantics import safe_div


def season_totals(facts: DataFrame, keys: list[str], value: str, when: Column, price: str, latest: list[str]) -> DataFrame:
    """Per key: rows, rows that meet ``when``, the sum, ratios per row and per latest price.

    Facts are reduced before anything is joined; the latest price is a maximum
    over a struct, not a correlated lookup.
    """
    totals = facts.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.count(F.when(when, 1)).alias("n_played"), F.sum(value).alias("total"), F.max_by(price, F.struct(*latest)).alias("price")
    )
    return totals.withColumns({"per_played": safe_div(F.col("total"), F.col("n_played")), "per_price": safe_div(F.col("total"), F.col("price"))})


def collapse(df: DataFrame, keys: list[str], sums: list[str], firsts: list[str], means: list[str], order: list[str]) -> DataFrame:
    """One row a key: sums of additive columns (null as 0), the first non-null attribute in order, means of context."""
    at = F.struct(*order)
    out = [F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in sums]
    out += [F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in firsts]
    out += [F.avg(c).alias(c) for c in means]
    return df.groupBy(*keys).agg(*out)


def prior_period(df: DataFrame, keys: list[str], period: str, measures: list[str]) -> DataFrame:
    """Each (key, period) with the measures of the period before; zeros and had_prior 0 where there is none."""
    before = df.select(*keys, (F.col(period) + 1).alias(period), *[F.col(m).alias(f"prior_{m}") for m in measures], F.lit(1).alias("had_prior"))
    out = df.join(before, [*keys, period], "left")
    return out.fillna(0, [f"prior_{m}" for m in measures] + ["had_prior"])


def histogram(df: DataFrame, value: str, bins: int = 36) -> DataFrame:
    """Equal bins over [min, max], the last one closed; empty bins are told as 0.

    The edges are one row, so joining them costs nothing.
    """
    edges = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / width))).otherwise(0)
    counts = df.where(F.col(value).isNotNull()).join(F.broadcast(edges)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = edges.select("lo", width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("start"), F.coalesce("n", F.lit(0)).alias("n"))


def simulation_summary(df: DataFrame, value: str) -> DataFrame:
    """Mean, 10/50/90 percentiles (interpolated) and the shares of 60 and 80 or more; the percentiles are selected by passes of their own."""
    p = [F.lit(v).cast("double") for v in percentiles(df, value, [0.1, 0.5, 0.9])]
    return df.agg(
        F.avg(value).alias("mean"), p[0].alias("p10"), p[1].alias("p50"), p[2].alias("p90"),
        F.avg((F.col(value) >= 60).cast("double")).alias("p_ge_60"), F.avg((F.col(value) >= 80).cast("double")).alias("p_ge_80"),
    )


def correlation_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair of columns over the rows where both are present, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    told = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(told).alias("p")).select("p.*")


def cumulative_by_step(df: DataFrame, keys: list[str], step: str, value: str) -> DataFrame:
    """Totals of each step, and their running total within the key."""
    w = Window.partitionBy(*keys).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    return df.groupBy(*keys, step).agg(F.sum(value).alias("total")).withColumn("cumulative", F.sum("total").over(w))


def within_limit(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Group counts and whether they stay within a limit."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("ok", F.col("n") <= limit)


def squad_problems(squads: DataFrame, shape: dict[str, int], budget: float, limit: int = 3) -> DataFrame:
    """group and problems of squads (group, player, position, team, price): sizes by position, price, players of one team, repeats.

    Problems are texts in a fixed order; a squad without any has an empty list.
    """
    by_team = squads.groupBy("group", "team").agg(F.count("*").alias("n")).groupBy("group").agg(F.max("n").alias("most"))
    told = squads.groupBy("group").agg(
        *[F.count_if(F.col("position") == p).alias(f"n_{p}") for p in shape],
        F.count("*").alias("n"), F.count_distinct("player").alias("players"), F.sum(F.col("price").cast("decimal(18,4)")).alias("cost"),
    ).join(by_team, "group")
    size = sum(shape.values())
    checks = [F.when(F.col("n") != size, F.format_string(f"%d players, not {size}", "n"))]
    checks += [F.when(F.col(f"n_{p}") != k, F.format_string(f"%d {p}, not {k}", f"n_{p}")) for p, k in shape.items()]
    checks += [
        F.when(F.col("players") < F.col("n"), F.lit("a player more than once")),
        F.when(F.col("most") > limit, F.format_string(f"%d players of one team, more than {limit}", "most")),
        F.when(F.col("cost") > budget, F.format_string("costs %s, more than %s", F.col("cost").cast("decimal(18,1)").cast("string"), F.lit(budget).cast("string"))),
    ]
    return told.select("group", F.filter(F.array(*checks), lambda c: c.isNotNull()).alias("problems"))
