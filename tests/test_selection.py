import math
import random

import pytest
from pyspark.sql import functions as F

from scoreloom.models import metrics
from scoreloom.operators import aggregates
from scoreloom.operators.selection import order_statistics, percentiles

PROBS = [0.0, 0.025, 0.1, 0.5, 0.9, 0.999, 1.0]


def builtin(df):
    return df.agg(F.percentile("x", F.array(*[F.lit(p) for p in PROBS]))).first()[0]


CASES = {
    "spread": lambda r: [r.gauss(0, 1) * 10 ** r.randint(-200, 200) for _ in range(4000)],
    "ties": lambda r: [float(r.choice([0, 0, 0, 1, 2])) for _ in range(4000)],
    "one value": lambda r: [7.5] * 3000,
    "infinite": lambda r: [r.choice([math.inf, -math.inf, r.random()]) for _ in range(3000)],
    "few": lambda r: [3.0, 1.0, 2.0],
    "one": lambda r: [4.0],
    "hot middle": lambda r: [r.random() for _ in range(2000)] + [0.5] * 1500,
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("keep", [10])
def test_equals_the_builtin(spark, name, keep):
    values = CASES[name](random.Random(4)) + [None] * 5
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(4)
    got, want = percentiles(df, "x", PROBS, keep), builtin(df)
    for a, b in zip(got, want):
        assert a == pytest.approx(b, rel=1e-12) or (math.isnan(a) and math.isnan(b))


def test_ranks_nulls_and_nan(spark):
    values = [5.0, None, float("nan"), 1.0, 3.0, float("nan"), 1.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for keep in (1, 100):
        got = order_statistics(df, "x", [0, 1, 2, 3, 4, 5, 6, 99, -1], keep)
        assert [got[i] for i in range(4)] == [1.0, 1.0, 3.0, 5.0]
        assert math.isnan(got[4]) and math.isnan(got[5]) and len(got) == 6
    assert percentiles(df.where("false"), "x", [0.1, 0.5]) == [None, None]


def test_passes_on_a_larger_table(spark):
    df = spark.range(300_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7).alias("x"))
    assert percentiles(df, "x", PROBS) == pytest.approx(builtin(df), rel=1e-12)


def test_summaries_use_them(spark):
    df = spark.range(5000).select((F.pmod(F.xxhash64("id"), F.lit(100)) * 1.0).alias("p"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    r = aggregates.simulation_summary(df, "p").first()
    assert (r.p10, r.p50, r.p90) == df.agg(*[F.percentile("p", F.lit(q)) for q in (0.1, 0.5, 0.9)]).first()
    none = aggregates.simulation_summary(df.where("false"), "p").first()
    assert tuple(none) == (None,) * 6
    curve = metrics.calibration_curve(df, "y", "p").collect()
    assert sum(c.n for c in curve) == 5000 and len(curve) == 10
