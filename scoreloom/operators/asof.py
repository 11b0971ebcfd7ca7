"""As-of lookups: what was known just before, or at the latest at, a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreloom.operators.slices import BEFORE, UP_TO, Line, count_before
from scoreloom.semantics import micros


def strict_history(queries: DataFrame, events: DataFrame, keys: list[str], at: str, when: str, query_id: list[str]) -> DataFrame:
    """For each query, the latest event strictly before it and how many there were.

    Both sides are laid on one time line, queries before events of the same
    instant, and one running window answers all: a shuffle by key and no
    pairs; keys with very many rows are cut in slices. Adds last_us (microseconds) and n_before.
    """
    q = queries.select(*keys, micros(at).alias("us"), F.lit(0).alias("kind"), F.struct(*query_id).alias("q"))
    e = events.select(*keys, micros(when).alias("us"), F.lit(1).alias("kind"), F.lit(None).cast(q.schema["q"].dataType).alias("q"))
    is_event = F.col("kind") == 1
    told = {"last_us": ("max", F.when(is_event, F.col("us"))), "n_before": ("count", F.when(is_event, 1))}
    line = Line(q.unionByName(e), keys, ["us", "kind"]).running(BEFORE, told).done()
    return line.where("kind = 0").select(*keys, "us", "q.*", "last_us", "n_before")


def latest_at(queries: DataFrame, events: DataFrame, keys: list[str], at: str, when: str, order: list[str], values: list[str], query_id: list[str]) -> DataFrame:
    """For each query, the values of the latest event at or before it; queries without one are left out."""
    q = queries.select(*keys, micros(at).alias("us"), F.lit(1).alias("kind"), F.struct(*query_id).alias("q"))
    body = events.select(*keys, micros(when).alias("us"), F.lit(0).alias("kind"), F.struct(micros(when).alias("__us"), *dict.fromkeys([*order, *values])).alias("e"))
    q = q.withColumn("e", F.lit(None).cast(body.schema["e"].dataType))
    body = body.withColumn("q", F.lit(None).cast(q.schema["q"].dataType))
    line = Line(q.unionByName(body), keys, ["us", "kind"]).running(UP_TO, {"hit": ("max", F.col("e"))}).done()
    return line.where("kind = 1 and hit is not null").select(*keys, "q.*", *[F.col(f"hit.{v}").alias(v) for v in values])


def count_within(df: DataFrame, keys: list[str], at: str, hit: Column, width_us: int, name: str = "n_within") -> DataFrame:
    """Hits in [t - width, t) of the same key: a RANGE frame, or where a key is cut in slices the difference of two running counts. Rows without time have none."""
    line = Line(df.withColumn("__us", micros(at)), keys, ["__us"])
    if line.cut:
        return count_before(line.done(), keys, "__us", hit, width_us, name, closed=False).drop("__us")
    w = Window.partitionBy(*keys).orderBy("__us").rangeBetween(-width_us, -1)
    return line.done().withColumn(name, F.when(F.col("__us").isNotNull(), F.count(F.when(hit, 1)).over(w)).otherwise(0)).drop("__us")
