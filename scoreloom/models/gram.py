"""Many linear fits from one pass: centred cross products of all features and the label.

Tasks reduce their rows to counts, means and centred products, which merge in
a tree without subtracting large sums. Any list of features is then fitted,
tested and scored from sub-matrices, so subsets, groups left out and backward
elimination read no row again; with the products of a test split its R2 comes
from them too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.models.statistics import f_p_value, t_p_value, t_quantile
from scoreloom.models.training import design

#: Levels of the tree in which partitions merge, and rows multiplied at once.
DEPTH = 3
BLOCK_ROWS = 8_192
#: Singular values below this share of the largest count as zero.
RANK = 1e-12


@dataclass(frozen=True)
class Fit:
    """A least-squares fit with an intercept (last in terms), its R2, standard errors, p-values, 95 % intervals and F test."""

    features: list[str]
    coefficients: np.ndarray
    intercept: float
    n: int
    r2: float
    errors: np.ndarray
    p_values: np.ndarray
    low: np.ndarray
    high: np.ndarray
    f_p_value: float

    def terms(self) -> list[dict]:
        values = [*self.coefficients, self.intercept]
        rows = zip([*self.features, "intercept"], values, self.p_values, self.low, self.high)
        return [{"name": a, "coef": float(c), "p_value": float(p), "low": float(lo), "high": float(hi)} for a, c, p, lo, hi in rows]


@dataclass(frozen=True)
class Gram:
    """n, means and centred products of some features and, last, the label."""

    features: list[str]
    n: int
    means: np.ndarray
    products: np.ndarray

    def _places(self, features: list[str]) -> list[int]:
        return [self.features.index(f) for f in features]

    def fit(self, features: list[str] | None = None) -> Fit:
        """The fit on some of the features; of columns that depend on one another the shortest solution is taken."""
        features = list(self.features if features is None else features)
        at, k, n = self._places(features), len(features), self.n
        xx, xy, yy = self.products[np.ix_(at, at)], self.products[at, -1], float(self.products[-1, -1])
        # Columns are scaled alike, so that the rank doesn't hang on their units.
        scale = np.sqrt(np.diag(xx))
        scale = np.where(scale > 0, scale, 1.0)
        inverse = np.linalg.pinv(xx / np.outer(scale, scale), rcond=RANK, hermitian=True) / np.outer(scale, scale)
        b = inverse @ xy
        means = self.means[at]
        rss = max(0.0, yy - float(b @ xy))
        free = n - k - 1
        sigma2 = rss / free if free > 0 else math.nan
        errors = np.sqrt(np.append(np.diag(inverse), 1 / n + means @ inverse @ means if n else math.nan) * sigma2)
        a = float(self.means[-1] - means @ b)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.append(b, a) / errors
        p = np.array([t_p_value(abs(float(v)), free) for v in t])
        width = t_quantile(0.975, free) * errors
        r2 = 1 - rss / yy if yy > 0 else math.nan
        f = (r2 / k) / ((1 - r2) / free) if k and free > 0 and r2 < 1 else math.inf
        return Fit(features, b, a, n, r2, errors, p, np.append(b, a) - width, np.append(b, a) + width, f_p_value(f, k, free) if k and free > 0 else math.nan)

    def scores(self, fit: Fit) -> dict[str, float]:
        """R2 and RMSE of a fit on the rows of this split."""
        at = self._places(fit.features)
        xx, xy, yy = self.products[np.ix_(at, at)], self.products[at, -1], float(self.products[-1, -1])
        b = fit.coefficients
        off = float(self.means[-1] - fit.intercept - self.means[at] @ b)
        rss = max(0.0, yy - 2 * float(b @ xy) + float(b @ xx @ b)) + self.n * off * off
        return {"n": self.n, "r2": 1 - rss / yy if yy > 0 else math.nan, "rmse": math.sqrt(rss / self.n) if self.n else math.nan}


def _merge(a: dict, b: dict) -> dict:
    out = dict(a)
    for k, (n, mean, products) in b.items():
        if k in out:
            m, other, held = out[k]
            apart = mean - other
            out[k] = m + n, other + apart * (n / (m + n)), held + products + np.outer(apart, apart) * (m * n / (m + n))
        else:
            out[k] = n, mean, products
    return out


def grams(df: DataFrame, features: list[str], label: str, split: Column | None = None) -> dict:
    """A :class:`Gram` for each value of ``split`` (one for all rows under None without it), in one pass.

    Rows without label are left out, missing features count as 0. ``split``
    should have few values: each has its own products.
    """
    data = design(df, features, label).withColumn("__split", F.lit(None).cast("string") if split is None else split)
    width = len(features)
    narrow = data.select("__split", *[f"__x_{i}" for i in range(width)], F.col(label).cast("double").alias("__y"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                x = np.column_stack([part[i].to_numpy(zero_copy_only=False) for i in range(1, width + 2)]).astype(np.float64)
                keys = np.array(part["__split"].to_pylist(), object)
                for key in dict.fromkeys(keys.tolist()):
                    mine = x[[k == key for k in keys]]
                    mean = mine.mean(axis=0)
                    off = mine - mean
                    held = _merge(held, {key: (len(mine), mean, off.T @ off)})
        if held:
            rows = [(k, n, m.tobytes(), p.tobytes()) for k, (n, m, p) in held.items()]
            kinds = [part["__split"].type, pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*rows), kinds)], ["split", "n", "means", "products"])

    kind = narrow.schema["__split"].dataType.simpleString()
    told = narrow.mapInArrow(partial, f"split {kind}, n long, means binary, products binary")
    read = lambda r: {r["split"]: (r["n"], np.frombuffer(r["means"]), np.frombuffer(r["products"]).reshape(width + 1, -1))}
    found = told.rdd.map(read).treeAggregate({}, _merge, _merge, DEPTH)
    return {k: Gram(list(features), n, mean, products) for k, (n, mean, products) in found.items()}


def gram(df: DataFrame, features: list[str], label: str) -> Gram:
    """The products of all rows; a table without rows has n 0."""
    width = len(features) + 1
    return grams(df, features, label).get(None) or Gram(list(features), 0, np.zeros(width), np.zeros((width, width)))


def covariances(df: DataFrame, columns: list[str]) -> DataFrame:
    """n, means and sample covariance of each pair of columns (a <= b in the order given), over rows where the last column is there."""
    g = gram(df, columns[:-1], columns[-1])
    rows = [
        (a, b, g.n, float(g.means[i]), float(g.means[j]), float(g.products[i, j] / (g.n - 1)) if g.n > 1 else None)
        for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j
    ]
    return df.sparkSession.createDataFrame(rows, "a string, b string, n long, mean_a double, mean_b double, covariance double")


def subsets(train: Gram, test: Gram, lists: dict[str, list[str]]) -> list[dict]:
    """For each named list of features the train R2, the test scores, their gap and the F test, in the order given."""
    out = []
    for name, features in lists.items():
        fit = train.fit(features)
        seen = test.scores(fit)
        out.append({"name": name, "n_features": len(features), "train_r2": fit.r2, "gap": fit.r2 - seen["r2"], "f_p_value": fit.f_p_value, **seen})
    return out


def eliminate(train: Gram, test: Gram, drop: int = 4, least: int = 8) -> list[dict]:
    """Backward elimination: rounds of features, what each drops, and the scores on ``test``.

    A round drops the ``drop`` features whose leaving costs the least, by the
    partial F test of each (its t squared), until ``least`` remain.
    """
    rounds, now = [], list(train.features)
    while True:
        fit = train.fit(now)
        with np.errstate(divide="ignore", invalid="ignore"):
            f = np.nan_to_num((fit.coefficients / fit.errors[:-1]) ** 2)
        weakest = sorted(range(len(now)), key=lambda i: (f[i], now[i]))[: max(0, min(drop, len(now) - least))]
        rounds.append({"features": list(now), "dropped": [now[i] for i in weakest], "train_r2": fit.r2, **test.scores(fit)})
        if not weakest:
            return rounds
        now = [c for i, c in enumerate(now) if i not in weakest]
