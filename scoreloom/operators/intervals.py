"""Interval lookups on one time line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.operators.slices import UP_TO, Line
from scoreloom.semantics import micros

#: Days after its start at which an open interval is taken to end.
OPEN_DAYS = 9999


def closed(intervals: DataFrame, start: str, until: str) -> DataFrame:
    """Open intervals get an end far off."""
    return intervals.withColumn(until, F.coalesce(until, F.date_add(start, OPEN_DAYS)))


def open_intervals(queries: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, until: str, query_id: list[str]) -> DataFrame:
    """How many intervals [start, until) of the key hold each query: +1 at starts, -1 at ends, summed up in time."""
    q = queries.select(*keys, micros(at).alias("us"), F.lit(1).alias("kind"), F.lit(0).alias("step"), F.struct(*query_id).alias("q"))
    none = F.lit(None).cast(q.schema["q"].dataType)
    starts = intervals.select(*keys, micros(start).alias("us"), F.lit(0).alias("kind"), F.lit(1).alias("step"), none.alias("q"))
    ends = intervals.select(*keys, micros(until).alias("us"), F.lit(0).alias("kind"), F.lit(-1).alias("step"), none.alias("q"))
    line = Line(q.unionByName(starts).unionByName(ends), keys, ["us", "kind"]).running(UP_TO, {"n_open": ("sum", F.col("step"))}).done()
    return line.where("kind = 1").select(*keys, "q.*", "n_open")
