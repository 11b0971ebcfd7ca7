import math
from fractions import Fraction

import numpy as np
import pytest

from scoreloom.llm import queries, whitening
from scoreloom.llm.whitening import merge, moments, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=8):
    """Rows by plain numpy: exact sums as Python numbers, covariance of centred rows."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    off = np.array([[float(Fraction(n * r[j] - s[j], n)) for j in range(d)] for r in x])
    values, vectors = np.linalg.eigh(off.T @ off / n)
    out = {}
    for c in range(min(k, d)):
        e, u = values[-1 - c], vectors[:, -1 - c]
        if e <= 1e-10 * values[-1]:
            continue
        u = u * np.sign(u[np.abs(u).argmax()])
        for (i, _), r, o in zip(rows, x, off):
            out[i, c + 1] = (n, sum((n * a - b) ** 2 for a, b in zip(r, s)), float(o @ u) / math.sqrt(e), e / values.sum())
    return out


def check(got, want):
    assert {(r.vec_id, r.component) for r in got} == set(want)
    assert len(got) == len(want)
    for r in got:
        n, deviation, w, explained = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation)
        assert r.whitened == pytest.approx(w, abs=1e-8)
        assert r.explained == pytest.approx(explained, rel=1e-9)
        assert r.identity_error < 1e-9


def cloud(n, d, seed):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, d)) @ np.diag(1.3 ** -np.arange(d)) + rng.normal(size=d)).astype(np.float32)
    return [(i, [float(c) for c in v]) for i, v in enumerate(x)]


def test_merge_is_the_moments_of_both():
    rng = np.random.default_rng(3)
    x = rng.integers(100_000, 100_050, size=(5_000, 7))
    held = moments(x[:1])
    for part in np.array_split(x[1:], 23):
        held = merge(held, moments(part))
    off = x - x.mean(axis=0)
    assert held.n == len(x) and (held.sums == x.sum(axis=0)).all()
    assert np.allclose(held.scatter, off.T @ off, rtol=1e-12, atol=1e-6)


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_against_brute_force(spark, partitions):
    rows = cloud(300, 12, 1)
    bad = [(1000, None, 0), (1001, [None] + [0.0] * 11, 0), (1002, [float("nan")] * 12, 0), (1003, [float("-inf")] + [1.0] * 11, 0), (1004, [], 0), (1005, [1.0] * 5, 0), (1006, [1e30] * 12, 0)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows] + bad, SCHEMA).repartition(partitions)
    check(whiten(df).collect(), brute(rows))


def test_fewer_components_than_eight(spark):
    rows = [(i, [float(a), float(b), float(a + b)]) for i, (a, b) in enumerate([(0, 0), (1, 5), (2, 3), (7, 1)])]
    check(whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect(), brute(rows))


def test_repeated_rows_and_null_ids(spark):
    rows = cloud(50, 4, 2)
    df = spark.createDataFrame([(i, v, 0) for i, v in rows] + [(7, rows[7][1], 0), (None, rows[8][1], 0)], SCHEMA)
    want = brute(rows + [(7.5, rows[7][1]), (-1, rows[8][1])])
    got = {}
    for r in whiten(df).collect():
        got.setdefault((r.vec_id, r.component), []).append(r)
    assert len(got) == 51 * 4 and {len(v) for (i, _), v in got.items() if i == 7} == {2}
    for (i, c), rs in got.items():
        n, deviation, w, _ = want[-1 if i is None else i, c]
        assert all((r.n, r.deviation) == (n, deviation) and r.whitened == pytest.approx(w, abs=1e-8) for r in rs)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], [(1, None, 0)], [(1, [], 0)]])
def test_nothing_to_tell_apart(spark, rows):
    out = whiten(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.collect() == []


def test_exact_beyond_longs(spark):
    rows = [(0, [2.0**39, 0.0]), (1, [-(2.0**39), 1.0]), (2, [5.0, -3.0])]
    got = whiten(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect()
    want = brute(rows)
    for r in got:
        d = want[r.vec_id, r.component][1]
        assert r.deviation == (d if d < 2**63 else None)
    assert {r.deviation is None for r in got} == {True, False}


def test_clashing_names(spark):
    rows = cloud(30, 3, 4)
    df = spark.createDataFrame([(v, i, "x") for i, v in rows], "whitened array<float>, deviation long, note string")
    out, found, error = whitening.whitened(df, "whitened")
    assert sorted(out.columns) == ["__vector", "deviation", "note", "whitened"] and error < 1e-9
    assert out.count() == 30 and len(found.values) == 3


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(queries.op11_whitening(spark, sf).collect(), brute(rows))
