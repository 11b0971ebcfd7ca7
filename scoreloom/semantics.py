"""Rules that every operator shares: guarded division, missing values, total orders, time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_US = 86_400_000_000


def safe_div(num: Column, den: Column) -> Column:
    """num / den, null where den is 0 or null."""
    return num / F.nullif(den, F.lit(0))


def positive_div(num: Column, den: Column) -> Column:
    """num / den, null unless den is above 0."""
    return F.when(den > 0, num / den)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is missing in the source data; here missing is null."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch, UTC; RANGE frames over it take any distance."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def exact_mean(c: str | Column, digits: int) -> Column:
    """A mean that is rounded half away from zero on exact decimals."""
    return F.round(F.avg(F.col(c).cast("decimal(28,10)") if isinstance(c, str) else c.cast("decimal(28,10)")), digits)


def top_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def latest_by(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The columns of the row with the greatest order of each key.

    A maximum over one struct, so rows are reduced before the shuffle; null
    orders count as smallest.
    """
    at = F.max_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(at.alias("__r")).select(*keys, "__r.*")


#: A prime, factors of the two ids, and what each of three squarings adds: the draws of :func:`hash_uniform`.
PRIME = 2_147_483_647
FACTORS = (48_271, 69_621)
STEPS = (1_013_904_223, 1_664_525, 22_695_477)


def hash_uniform(seed: int, a: Column, b: Column) -> Column:
    """A uniform in [0, 1) from two whole numbers: the same under any partitioning, and in plain SQL arithmetic.

    A line modulo a prime, squared three times over, which takes away the
    lattice that a line alone would leave between neighbouring ids.
    """
    x = F.pmod(F.pmod(a.cast("long"), F.lit(PRIME)) * FACTORS[0] + F.pmod(b.cast("long"), F.lit(PRIME)) * FACTORS[1] + seed, F.lit(PRIME))
    for step in STEPS:
        x = (x * x + step) % PRIME
    return x / F.lit(float(PRIME))


def uniform_sql(seed: int, a: str, b: str) -> str:
    """:func:`hash_uniform` as SQL, for ids from 0 up."""
    x = f"(CAST({a} AS BIGINT) % {PRIME} * {FACTORS[0]} + CAST({b} AS BIGINT) % {PRIME} * {FACTORS[1]} + {seed}) % {PRIME}"
    for step in STEPS:
        x = f"(({x}) * ({x}) + {step}) % {PRIME}"
    return f"({x}) / {float(PRIME)}"
