"""Bands, buckets and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixture_grade(score: Column) -> Column:
    """1 (easiest) to 5: at most -0.35, -0.1, 0.1, 0.35, above; null and NaN have none."""
    s = F.when(~F.isnan(score), score)
    return F.when(s <= -0.35, 1).when(s <= -0.1, 2).when(s <= 0.1, 3).when(s <= 0.35, 4).when(s.isNotNull(), 5)


def run_rating(mean: Column) -> Column:
    """Easy up to -0.2, Brutal from 0.25, else Mixed."""
    return F.when(mean <= -0.2, "Easy").when(mean >= 0.25, "Brutal").when(mean.isNotNull(), "Mixed")


def right_closed(value: Column, edges: list[float], labels: list[str]) -> Column:
    """Label of the bin (lo, hi] that holds the value; null outside all bins."""
    out = F.lit(None).cast("string")
    for lo, hi, label in reversed(list(zip(edges, edges[1:], labels))):
        out = F.when((value > lo) & (value <= hi), label).otherwise(out)
    return out


def fit_flag(train_r2: Column, test_r2: Column, naive_r2: Column) -> Column:
    """overfit if train beats test by more than 0.15, underfit if test doesn't beat the naive model, else ok."""
    return F.when(train_r2 - test_r2 > 0.15, "overfit").when(test_r2 <= naive_r2, "underfit").otherwise("ok")


def verdict(delta: Column, p: Column) -> Column:
    """worse or better where p < 0.05, by the sign of the change; else none."""
    return F.when((p < 0.05) & (delta < 0), "worse").when((p < 0.05) & (delta > 0), "better").otherwise("none")


def difficulty_multiplier(score: Column) -> Column:
    """1 - 0.4 * score, between 0.6 and 1.5."""
    return F.least(F.greatest(1 - 0.4 * score, F.lit(0.6)), F.lit(1.5))


# Words that mark a muscle or tendon injury.
MUSCLE_WORDS = [
    "hamstring", "muscle", "muscular", "thigh", "calf", "groin", "adductor", "strain",
    "dead leg", "tendon", "achilles", "hip flexor", "pubalgia", "cramp", "contracture",
]


def contains_any(text: Column, words: list[str]) -> Column:
    """Whether the lower-cased text contains any of the words; null texts don't."""
    import re

    return F.coalesce(F.lower(text).rlike("|".join(re.escape(w) for w in words)), F.lit(False))
