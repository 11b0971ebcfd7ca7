"""Exact order statistics and interpolated percentiles without one buffer of all values.

Each pass counts, for every rank that is wanted, the values below, at and
between two pivots, and sketches the values between at a grid of shares, from
which the next pivots come. A sketch is merged from bounded parts, so it needs
no shuffle of values; the counts are exact, so the result is, whatever the
sketch's error. What lies between two pivots shrinks some thousandfold a pass,
and the last few thousand values are collected: four passes do for ten
thousand million rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy of a sketch (error of a rank: one by this), and shares of the values in between at which it is read.
ACCURACY = 10_000
GRID = [i / 2_000 for i in range(2_001)]
#: Values between two pivots that are collected.
KEEP = 10_000


@dataclass
class Span:
    """Values strictly between two pivots (None: no bound): how many lie below, and how many between."""

    rank: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    n: int = 0
    found: float | None = None

    def holds(self, x: Column) -> Column:
        out = x.isNotNull()
        if self.low is not None:
            out = out & (x > F.lit(self.low))
        if self.high is not None:
            out = out & (x < F.lit(self.high))
        return out


def _grid(x: Column, span: Span) -> Column:
    # One text in place of thousands of literals.
    shares = F.split(F.lit(",".join(map(str, GRID))), ",").cast("array<double>")
    return F.percentile_approx(F.when(span.holds(x), x), shares, ACCURACY)


def _pivots(grid: list[float], at: float) -> tuple[float, float]:
    """Two values of a grid that should lie around a share."""
    slack = 2 / ACCURACY
    lower = [v for v, s in zip(grid, GRID) if s <= at - slack] or grid[:1]
    upper = [v for v, s in zip(grid, GRID) if s >= at + slack] or grid[-1:]
    return lower[-1], upper[0]


def order_statistics(df: DataFrame, value: str | Column, ranks: list[int] | Callable[[int], list[int]], keep: int = KEEP) -> dict[int, float]:
    """The values at ranks from 0, in ascending order, nulls left out and NaN last; ranks beyond the last value are absent.

    ``ranks`` may be a function of the number of values.
    """
    x = (F.col(f"`{value}`") if isinstance(value, str) else value).cast("double")
    data = df.select(x.alias("x"))
    x = F.col("x")
    first = data.agg(F.count("x").alias("n"), _grid(x, Span(0)).alias("g")).first()
    n = first["n"]
    ranks = ranks(n) if callable(ranks) else ranks
    spans = [Span(r, n=n) for r in sorted(set(ranks)) if 0 <= r < n]
    pivots = {s.rank: _pivots(first["g"], s.rank / max(n - 1, 1)) for s in spans}
    while True:
        wide = [s for s in spans if s.found is None and s.n > keep]
        if not wide:
            break
        # Neighbouring ranks mostly ask for the same counts.
        asked = {(s.low, s.high, *pivots[s.rank]): s for s in wide}
        place = {k: f"r{i}" for i, k in enumerate(asked)}
        told = []
        for k, s in asked.items():
            a, b = (F.lit(float(v)) for v in pivots[s.rank])
            inside = Span(s.rank, *pivots[s.rank])
            told += [
                F.struct(
                    F.count_if(s.holds(x) & (x < a)).alias("below"), F.count_if(x == a).alias("at_low"), F.count_if(inside.holds(x)).alias("between"),
                    F.count_if(x == b).alias("at_high"), _grid(x, inside).alias("g"),
                ).alias(place[k])
            ]
        row = data.agg(*told).first()
        for s in wide:
            t, (a, b) = row[place[s.low, s.high, *pivots[s.rank]]], pivots[s.rank]
            at_high = t["at_high"] if b > a or (math.isnan(b) and not math.isnan(a)) else 0
            steps = [(s.low, a, t["below"]), (a, a, t["at_low"]), (a, b, t["between"]), (b, b, at_high), (b, s.high, None)]
            upto = s.below
            for lo, hi, count in steps:
                count = s.below + s.n - upto if count is None else count
                if s.rank < upto + count:
                    break
                upto += count
            if lo is not None and hi is not None and (lo == hi or (math.isnan(lo) and math.isnan(hi))):
                s.found = lo
                continue
            s.low, s.high, s.below, s.n = lo, hi, upto, count
            if (lo, hi) == (a, b) and t["g"]:
                pivots[s.rank] = _pivots(t["g"], (s.rank - upto) / max(count - 1, 1))
            elif count > keep:
                # The pivots missed the rank, which the sketch's error makes rare: start again from the ends of what is left.
                g = data.agg(_grid(x, s)).first()[0]
                pivots[s.rank] = _pivots(g, (s.rank - upto) / max(count - 1, 1))
    left = [s for s in spans if s.found is None]
    if left:
        asked = {(s.low, s.high): s for s in left}
        place = {k: f"r{i}" for i, k in enumerate(asked)}
        row = data.agg(*[F.sort_array(F.collect_list(F.when(s.holds(x), x))).alias(place[k]) for k, s in asked.items()]).first()
        for s in left:
            s.found = row[place[s.low, s.high]][s.rank - s.below]
    return {s.rank: s.found for s in spans}


def percentiles(df: DataFrame, value: str | Column, probs: list[float], keep: int = KEEP) -> list[float | None]:
    """Percentiles with straight lines between neighbouring values, as ``percentile`` has them; None where there are no values."""
    sizes = []

    def ranks(n: int) -> list[int]:
        sizes.append(n)
        return sorted({r for p in probs for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})

    got = order_statistics(df, value, ranks, keep)
    if not got:
        return [None] * len(probs)
    places = [p * (sizes[0] - 1) for p in probs]
    out = []
    for p in places:
        lo, hi = got[math.floor(p)], got[math.ceil(p)]
        out.append(lo if lo == hi else (math.ceil(p) - p) * lo + (p - math.floor(p)) * hi)
    return out
