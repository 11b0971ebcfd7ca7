"""Whitening of embeddings: moments by Chan's merge formula, a small eigenproblem, a pass that verifies.

Each partition reduces its vectors to a count, their mean and their centred
scatter; two such summaries merge into that of both sets without subtracting
large sums,

    M = M_a + M_b + (m_b - m_a)(m_b - m_a)' * n_a * n_b / (n_a + n_b)

(Chan, Golub, LeVeque 1979). Spark merges the summaries in a tree, the driver
gets one of them and solves for the eigenvectors, and a second pass merges
the moments of the whitened vectors and tells how far their covariance is
from the identity. A summary has d * d numbers, whatever the number of rows.

Entries become whole numbers, floor(1024 c) + 100000, whose sums are kept
beside the means and are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from scoreloom.llm.common import fresh, slices

SCALE = 1024
SHIFT = 100_000
COMPONENTS = 8
#: Entries of this size or above count as non-finite: beyond, their whole numbers are no longer exact.
MAX_ENTRY = 2.0**40
#: Components with less than this share of the largest eigenvalue can't be told from rounding and are left out.
LEAST = 1e-10
#: Levels of the tree that merges the summaries of partitions.
DEPTH = 3
LONG = 2**63


@dataclass(frozen=True)
class Moments:
    """Count, exact sums (whole numbers only, else None), mean and centred scatter of a set of vectors."""

    n: int
    sums: np.ndarray | None
    mean: np.ndarray
    scatter: np.ndarray


def moments(x: np.ndarray) -> Moments:
    mean = x.mean(axis=0)
    off = x - mean
    # What rounding left in the mean is taken off the scatter.
    rest = off.sum(axis=0)
    scatter = off.T @ off - np.outer(rest, rest) / len(x)
    return Moments(len(x), x.sum(axis=0) if x.dtype == np.int64 else None, mean, scatter)


def merge(a: Moments, b: Moments) -> Moments:
    n = a.n + b.n
    apart = b.mean - a.mean
    sums = a.sums + b.sums if a.sums is not None and b.sums is not None else None
    return Moments(n, sums, a.mean + apart * (b.n / n), a.scatter + b.scatter + np.outer(apart, apart) * (a.n * b.n / n))


def whole(column: pa.Array, d: int) -> np.ndarray:
    """Lists of d numbers as rows of whole numbers."""
    c = np.asarray(column.flatten(), np.float64).reshape(-1, d)
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def reduced(df: DataFrame, vector: str, numbers: Callable[[pa.Array], np.ndarray]) -> Moments | None:
    """The moments of a column of lists over all rows; None where there are none."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in slices(batches, 2_048):
            m = moments(numbers(b[vector]))
            held = merge(held, m) if held else m
        if held:
            sums = None if held.sums is None else held.sums.tobytes()
            row = [[held.n], [sums], [held.mean.tobytes()], [held.scatter.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, [pa.int64(), *[pa.binary()] * 3])], ["n", "sums", "mean", "scatter"])

    def read(r) -> Moments:
        mean = np.frombuffer(r["mean"])
        return Moments(r["n"], None if r["sums"] is None else np.frombuffer(r["sums"], np.int64), mean, np.frombuffer(r["scatter"]).reshape(len(mean), -1))

    told = df.select(vector).mapInArrow(partial, "n long, sums binary, mean binary, scatter binary")
    # A partition without rows tells nothing; None stands for it, so that an empty table is no error.
    both = lambda a, b: a if b is None else b if a is None else merge(a, b)
    return told.rdd.map(read).treeAggregate(None, both, both, DEPTH)


def usable(vector: str) -> F.Column:
    """Whether a list is there and holds finite numbers only."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < MAX_ENTRY), F.lit(False)))


@dataclass(frozen=True)
class Whitening:
    """What a fit has found: rows, sums, and the components' unit vectors (columns), variances and shares of the trace."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def apply(self, x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        """Whitened rows, and the sum of the squares of n * x - S of each, exact (None beyond a long)."""
        d = x.shape[1]
        most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + int(np.abs(self.sums).max(initial=0)) // self.n + 1
        if d * (2 * self.n * most) ** 2 < LONG:
            off = self.n * x - self.sums
            deviation = (off * off).sum(axis=1).tolist()
            off = off.astype(np.float64)
        else:
            exact = x.astype(object) * self.n - self.sums.astype(object)
            deviation = [int(v) if v < LONG else None for v in (exact * exact).sum(axis=1)]
            off = exact.astype(np.float64)
        return (off / self.n) @ (self.vectors / np.sqrt(self.values)), deviation


def fit(df: DataFrame, vector: str, k: int = COMPONENTS) -> tuple[DataFrame, Whitening | None]:
    """The usable rows of ``df``, and the whitening of their lists ``vector``, up to k components; None without any.

    Lists must be of one length: the commonest counts (the longer on a tie),
    rows with others are left out as unusable ones are.
    """
    good = df.where(usable(vector))
    length = good.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if not length or not length["d"]:
        return good.limit(0), None
    d = length["d"]
    good = good.where(F.size(vector) == d)
    m = reduced(good, vector, lambda c: whole(c, d))
    values, vectors = np.linalg.eigh(m.scatter / m.n)
    order = np.argsort(-values, kind="stable")[:k]
    order = order[values[order] > LEAST * max(values[-1], 0.0)]
    if m.n < 2 or not len(order):
        return good, None
    chosen = vectors[:, order]
    chosen = chosen * np.sign(chosen[np.abs(chosen).argmax(axis=0), np.arange(len(order))])
    return good, Whitening(m.n, m.sums, chosen, values[order], values[order] / np.trace(m.scatter / m.n))


def whitened(df: DataFrame, vector: str, k: int = COMPONENTS) -> tuple[DataFrame, Whitening | None, float | None]:
    """The usable rows of ``df`` with columns whitened (list of doubles) and deviation (long), the fit, and the identity error.

    Columns of those two names are replaced. Rows whose list is null or holds
    a null or non-finite entry, or one of 2**40 or more, are left out, and so
    are lists of another than the commonest length. Repeated rows and null
    ids count like others. Where the vectors don't vary (one row, or all
    equal) there is no component, and no row comes back; so with an empty table.
    The error is the largest absolute entry of the whitened rows' covariance
    minus the identity, from a pass of its own.
    """
    extra = [StructField("whitened", ArrayType(DoubleType())), StructField("deviation", LongType())]
    good, found = fit(df, vector, k)
    names = [c for c in good.columns if c.lower() not in ("whitened", "deviation") or c == vector]
    held = fresh(names, "__vector") if vector.lower() in ("whitened", "deviation") else vector
    good = good.select(*[F.col(f"`{c}`").alias(held if c == vector else c) for c in names])
    if found is None:
        return good.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in extra]).limit(0), None, None
    d = len(found.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2_048):
            w, deviation = found.apply(whole(b[held], d))
            ends = pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(w.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(deviation, pa.int64())], [*b.schema.names, "whitened", "deviation"])

    out = good.mapInArrow(run, StructType([*good.schema.fields, *extra]))
    k = len(found.values)
    again = reduced(out, "whitened", lambda c: np.asarray(c.flatten()).reshape(-1, k))
    return out, found, float(np.abs(again.scatter / again.n - np.eye(k)).max())


def whiten(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """One row for each usable vector and component, as :func:`whitened` has them.

    Returns the id, component (from 1, by falling variance), n, deviation,
    whitened, explained and identity_error; other columns are ignored.
    """
    out, found, error = whitened(df.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("embedding")), "embedding", k)
    shares = F.array(*[F.lit(float(s)) for s in (found.explained if found else [])]).cast("array<double>")
    return out.select("vec_id", F.posexplode("whitened").alias("at", "whitened"), "deviation").select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(found.n if found else None).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
