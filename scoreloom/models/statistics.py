"""Tails of the F and t distributions."""

from __future__ import annotations

import math

def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return min(1.0, max(0.0, x))
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 300):
        for sign in (1, -1):
            if sign > 0:
                num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            else:
                num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * total


def f_p_value(f: float, d1: int, d2: int) -> float:
    """Upper tail of the F distribution."""
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_p_value(t: float, free: int) -> float:
    """Both tails of Student's distribution; nan without degrees of freedom or for an unknown t."""
    if free < 1 or math.isnan(t):
        return math.nan
    return incomplete_beta(free / 2, 0.5, free / (free + t * t)) if math.isfinite(t) else 0.0


def t_quantile(p: float, free: int) -> float:
    """The value below which a share p (0.5 or more) of Student's distribution lies, by halving."""
    if free < 1:
        return math.nan
    low, high = 0.0, 1.0
    while 1 - t_p_value(high, free) / 2 < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if 1 - t_p_value(mid, free) / 2 < p:
            low = mid
        else:
            high = mid
    return (low + high) / 2
