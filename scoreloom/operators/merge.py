"""Keyed writes on immutable tables: upserts, inserts of what is absent, slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.semantics import latest_by


def upsert(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The newest row of each key by ``seq``; of equal ones the new side wins.

    A maximum over a struct: one shuffle, reduced on the map side.
    """
    both = old.withColumn("__side", F.lit(0)).unionByName(new.withColumn("__side", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return latest_by(both, keys, [seq, "__side"], rest).select(*old.columns)


def upsert_keeping(old: DataFrame, new: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """New rows replace old ones, but a column in ``kept`` that has a value keeps it."""
    rest = [c for c in old.columns if c not in keys]
    o = old.select(*keys, *[F.col(c).alias(f"__o_{c}") for c in rest], F.lit(True).alias("__old"))
    n = new.select(*keys, *[F.col(c).alias(f"__n_{c}") for c in rest], F.lit(True).alias("__new"))
    both = o.join(n, keys, "full_outer")

    def pick(c: str):
        a, b = F.col(f"__o_{c}"), F.col(f"__n_{c}")
        return (F.coalesce(a, b) if c in kept else F.when(F.col("__new"), b).otherwise(a)).alias(c)

    return both.select(*keys, *[pick(c) for c in rest]).select(*old.columns)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Old rows, and new rows of keys that aren't there; of several the first in order."""
    rest = [c for c in old.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*").select(*old.columns)
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def replace_slice(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Write the partitions that ``df`` has, and leave the others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def claim(state: DataFrame, keys: list[str], wanted: DataFrame, before: str, after: str) -> DataFrame:
    """Guarded transition: rows of the wanted keys move on only from the status ``before``."""
    hit = wanted.select(*keys).distinct().withColumn("__hit", F.lit(True))
    return state.join(hit, keys, "left").withColumn("status", F.when(F.col("__hit") & (F.col("status") == before), after).otherwise(F.col("status"))).drop("__hit").select(*state.columns)
