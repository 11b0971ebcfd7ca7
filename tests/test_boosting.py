import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreloom.models import boosting as B
from scoreloom.models import training


def brute(x, y, edges, q, rounds, depth, least, rate):
    """Boosting of one quantile by loops over rows."""
    bins = [[sum(v > e for e in edges[j]) for j, v in enumerate(r)] for r in x]
    ordered = sorted(y)
    f = [next(v for i, v in enumerate(ordered, 1) if i >= q * len(y) * (1 - 1e-12))] * len(y)
    risks = []

    def grow(rows, level):
        g = [q - (y[i] < f[i]) for i in rows]
        best = (1e-12, None)
        if level < depth:
            for j in range(len(edges)):
                for cut in range(max(len(e) for e in edges)):
                    left = [k for k, i in enumerate(rows) if bins[i][j] <= cut]
                    if least <= len(left) <= len(rows) - least:
                        right = [k for k in range(len(rows)) if bins[rows[k]][j] > cut]
                        gain = len(left) * len(right) / len(rows) * (np.mean([g[k] for k in left]) - np.mean([g[k] for k in right])) ** 2
                        if gain > best[0] + 1e-9:
                            best = (gain, (j, cut))
        if best[1] is None:
            off = sorted(y[i] - f[i] for i in rows)
            return {i: next(v for n, v in enumerate(off, 1) if n >= q * len(off) * (1 - 1e-12)) for i in rows}
        j, cut = best[1]
        return grow([i for i in rows if bins[i][j] <= cut], level + 1) | grow([i for i in rows if bins[i][j] > cut], level + 1)

    for _ in range(rounds):
        risks.append(np.mean([max(q * (a - b), (q - 1) * (a - b)) for a, b in zip(y, f)]))
        value = grow(list(range(len(y))), 0)
        f = [b + rate * value[i] for i, b in enumerate(f)]
    return f, risks


def frame(spark, n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b = rng.random(), rng.choice([0.0, 1.0, 2.0])
        rows.append((i, a, b, rng.gauss(0, 1), 3 * a + b + rng.gauss(0, 0.2 + a)))
    return rows, spark.createDataFrame(rows, "i long, a double, b double, c double, y double")


@pytest.mark.parametrize("partitions", [1, 5])
def test_against_brute_force(spark, partitions):
    rows, df = frame(spark, 200)
    model = B.fit(df.repartition(partitions), ["a", "b", "c"], "y", rounds=6, depth=3, least=15, bins=8)
    got = {r.i: (r.q10, r.q50, r.q90) for r in B.predict(df, model).collect()}
    x, y = [r[1:4] for r in rows], [r[4] for r in rows]
    for m, q in enumerate(B.QUANTILES):
        want, risks = brute(x, y, model.edges, q, 6, 3, 15, B.RATE)
        assert [got[i][m] for i in range(200)] == pytest.approx(want)
        assert [r[m] for r in model.risks[:-1]] == pytest.approx(risks)


def test_every_round_lowers_the_risk_and_rounds_cross_a_remaking(spark):
    _, df = frame(spark, 1500, 3)
    model = B.fit(df.repartition(3), ["a", "b", "c"], "y", rounds=B.KEEP_ROUNDS + 5)
    risks = np.array(model.risks)
    assert len(risks) == B.KEEP_ROUNDS + 6 and (np.diff(risks, axis=0) <= 1e-12).all()
    again = B.Boosted.load(model.dump())
    p = B.predict(df, again)
    for m, q in enumerate(B.QUANTILES):
        name = f"q{round(q * 100)}"
        mean = p.agg(F.avg(F.greatest(q * (F.col("y") - F.col(name)), (q - 1) * (F.col("y") - F.col(name))))).first()[0]
        assert mean == pytest.approx(risks[-1, m])


def test_no_worse_than_the_forest(spark):
    _, df = frame(spark, 3000, 7)
    train, test = df.where("i < 2000"), df.where("i >= 2000")
    boosted = training.quantile_scores(B.predict(test, B.fit(train, ["a", "b", "c"], "y", rounds=60)), "y").first()
    forest = training.quantile_scores(training.quantile_forest(train, test, ["a", "b", "c"], "y", "i", trees=10), "y").first()
    assert all(b <= f * 1.02 for b, f in zip(boosted, forest))


def test_summaries_keep_ranks():
    rng = np.random.default_rng(0)
    parts = [rng.normal(size=rng.integers(1, 9000)) for _ in range(20)]
    held = {}
    for p in parts:
        held = B._merge(held, {0: B.thin(p, np.ones(len(p)))})
    every = np.sort(np.concatenate(parts))
    for q in (0.01, 0.1, 0.5, 0.9):
        rank = np.searchsorted(every, B.quantile_of(*held[0], q)) / len(every)
        assert abs(rank - q) < 20 / (2 * B.POINTS)
    assert B.quantile_of(*B.thin(np.array([3.0, 1.0, 2.0]), np.ones(3)), 0.5) == 2.0


def test_missing_values_ties_and_no_rows(spark):
    rows = [(None, 1.0, 5.0), (float("nan"), 2.0, 6.0), (0.0, 1.0, None), (0.0, 1.0, float("nan"))] + [(0.0, 1.0, 4.0)] * 50
    df = spark.createDataFrame(rows, "a double, q10 double, y double")
    model = B.fit(df, ["a", "q10"], "y", rounds=3)
    out = B.predict(df, model)
    assert out.columns == ["a", "y", "q10", "q50", "q90"] and out.count() == 54
    assert {r.q50 for r in out.collect()} == {4.0}
    none = B.fit(df.where("false"), ["a"], "y", rounds=3)
    assert {tuple(r)[-3:] for r in B.predict(df, none).collect()} == {(0.0, 0.0, 0.0)}


def test_cells_with_many_equal_rows(spark):
    """Few cells, equal rows counted once and a cell in several blocks: what each row alone would give."""
    x = [[float(i % 2), float(i % 3 == 0)] for i in range(400)]
    y = [float((i * 37) % 50 if i % 5 else 7) for i in range(400)]
    df = spark.createDataFrame([(*r, v) for r, v in zip(x, y)], "a double, b double, y double")
    rows, least = B.BLOCK_ROWS, B.LEAST_BLOCK
    try:
        B.BLOCK_ROWS, B.LEAST_BLOCK = 40, 30
        model = B.fit(df, ["a", "b"], "y", rounds=4, depth=2, least=15, bins=8)
    finally:
        B.BLOCK_ROWS, B.LEAST_BLOCK = rows, least
    p = model.predict(np.array(x))
    for m, q in enumerate(B.QUANTILES):
        want, risks = brute(x, y, model.edges, q, 4, 2, 15, B.RATE)
        assert list(p[:, m]) == pytest.approx(want)
        assert [r[m] for r in model.risks[:-1]] == pytest.approx(risks)


def test_a_pass_costs_cells():
    """Of 100,000 rows in three cells a search looks at some 17 labels a cell."""
    y = np.sort(np.random.default_rng(1).random(100_000))
    cells = B.Cells(np.array([[0], [1], [2]], np.uint8), np.array([0, 50_000, 50_000, 100_000]), np.concatenate([y[::2], y[1::2]]), None)
    assert cells.below(np.array([0.5, 0.5, 2.0])).tolist() == [(y[::2] < 0.5).sum(), 50_000, 100_000]
    assert cells.below(np.array([-1.0, 0.0, y[1]])).tolist() == [0, 50_000, 50_000]
