"""Boosted trees with pinball loss: one ensemble for each quantile, grown side by side.

Each round fits a shallow tree to the signs of the residuals and gives every
leaf the quantile of its residuals, of which a tenth is added (Friedman 2001).
Features are binned once, and rows of the same bins (a cell) have the same
prediction at all times. So labels are sorted within cells once, a cell's rows
below its prediction are a search, and a level of all trees of a round is one
pass that counts rows and rows below their prediction by (quantile, node,
feature, bin) at the cost of its cells; a last pass summarises the residuals
of each leaf. Both are sums or merges that Spark takes in a tree, and what
reaches the driver depends on features, bins and leaves, not on rows.

Rows are held as numpy blocks in the order of cells and labels, a cell with
many labels in several blocks, with each cell's predictions so far. Blocks are
made anew from their predecessors every few rounds, so a lost block costs a
replay of some rounds' trees.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from scoreloom.session import materialise

QUANTILES = (0.1, 0.5, 0.9)
ROUNDS = 200
DEPTH = 4
LEAST_ROWS = 20
RATE = 0.1
#: Bins of a feature, and the rank error of their edges.
BINS = 64
EDGE_ERROR = 0.001
#: Rounds between two makings of the blocks, distinct rows of a block at most, and below which a block of its own isn't worth a task.
KEEP_ROUNDS = 10
BLOCK_ROWS = 1 << 20
LEAST_BLOCK = 32_768
#: Partitions whose counts the driver adds up without a tree.
FEW_PARTS = 32
#: Points of a summary of residuals. Up to twice as many are held as they are, so leaves of that many rows are exact.
POINTS = 2_048


@dataclass(frozen=True)
class Tree:
    """Nodes by level from the root: the children of i are 2i + 1 and 2i + 2. A feature of -1 ends the way there."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def places(self, bins: np.ndarray, depth: int = DEPTH) -> np.ndarray:
        at, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
        for _ in range(depth):
            f = self.feature[at]
            at = np.where(f < 0, at, 2 * at + 1 + (bins[rows, np.maximum(f, 0)] > self.cut[at]))
        return at


@dataclass
class Boosted:
    """Edges of the bins by feature, and by quantile the first value and the trees; risks are the mean losses before each round and at the end."""

    features: list[str]
    quantiles: tuple[float, ...]
    edges: list[np.ndarray]
    first: np.ndarray
    trees: list[list[Tree]] = field(default_factory=list)
    risks: list[list[float]] = field(default_factory=list)
    rate: float = RATE

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)]).astype(np.uint8)

    def add(self, bins: np.ndarray, held: np.ndarray, start: int, end: int) -> np.ndarray:
        """Predictions (rows by quantiles) with the trees of some rounds added."""
        out = held.copy()
        for trees in self.trees[start:end]:
            for m, t in enumerate(trees):
                out[:, m] += self.rate * t.value[t.places(bins)]
        return out

    def since(self, start: int) -> Boosted:
        """The trees from a round on and no more: what tasks need beside predictions that have the others."""
        return Boosted([], self.quantiles, [], self.first[:0], self.trees[start:], rate=self.rate)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.add(self.bins(x), np.tile(self.first, (len(x), 1)), 0, len(self.trees))

    def dump(self) -> str:
        trees = [[[t.feature.tolist(), t.cut.tolist(), t.value.tolist()] for t in row] for row in self.trees]
        return json.dumps({"features": self.features, "quantiles": self.quantiles, "edges": [e.tolist() for e in self.edges], "first": self.first.tolist(), "trees": trees, "risks": self.risks, "rate": self.rate})

    @staticmethod
    def load(text: str) -> Boosted:
        d = json.loads(text)
        trees = [[Tree(np.array(f, np.int64), np.array(c, np.int64), np.array(v)) for f, c, v in row] for row in d["trees"]]
        return Boosted(d["features"], tuple(d["quantiles"]), [np.array(e) for e in d["edges"]], np.array(d["first"]), trees, d["risks"], d["rate"])


# --- Summaries of numbers: (values in order, weights) --------------------


def thin(values: np.ndarray, weights: np.ndarray, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """A summary in order; beyond 2 * points only points of equal weight stay, each within 1 / (2 points) of its rank."""
    order = np.argsort(values)
    values, weights = values[order], weights[order]
    if len(values) <= 2 * points:
        return values, weights
    upto = np.cumsum(weights)
    wanted = (np.arange(points) + 0.5) * (upto[-1] / points)
    return values[np.searchsorted(upto, wanted)], np.full(points, upto[-1] / points)


def thin_ones(values: np.ndarray, points: int = POINTS) -> tuple[np.ndarray, np.ndarray]:
    """:func:`thin` of values of weight 1, by a plain sort."""
    values = np.sort(values)
    n = len(values)
    if n <= 2 * points:
        return values, np.ones(n)
    wanted = (np.arange(points) + 0.5) * (n / points)
    return values[np.ceil(wanted).astype(np.int64) - 1], np.full(points, n / points)


def quantile_of(values: np.ndarray, weights: np.ndarray, q: float) -> float:
    """The smallest value that at least a share q of the weight doesn't exceed."""
    upto = np.cumsum(weights)
    return float(values[min(np.searchsorted(upto, q * upto[-1] * (1 - 1e-12)), len(values) - 1)])


def _merge(a: dict, b: dict) -> dict:
    out = dict(a)
    for k, (v, w) in b.items():
        out[k] = thin(np.concatenate([out[k][0], v]), np.concatenate([out[k][1], w])) if k in out else (v, w)
    return out


# --- Passes ---------------------------------------------------------------


@dataclass(frozen=True)
class Cells:
    """Rows in the order of cells and labels: a cell's bins, where its labels start and, last, end, the labels, and how often each occurs (None: once)."""

    bins: np.ndarray
    first: np.ndarray
    y: np.ndarray
    weights: np.ndarray | None

    def upto(self) -> np.ndarray:
        """Rows before each label, and all."""
        return np.arange(len(self.y) + 1) if self.weights is None else np.concatenate([[0], np.cumsum(self.weights)])

    def below(self, p: np.ndarray) -> np.ndarray:
        """The place of each cell's first label that isn't below its p, by halving all cells at once."""
        low, high = self.first[:-1].copy(), self.first[1:].copy()
        while (open_ := low < high).any():
            mid = np.minimum((low + high) >> 1, len(self.y) - 1)
            under = self.y[mid] < p
            low = np.where(open_ & under, mid + 1, low)
            high = np.where(open_ & ~under, mid, high)
        return low

    def losses(self, p: np.ndarray, quantiles) -> np.ndarray:
        """Pinball losses summed over rows, by quantile; p is cells by quantiles."""
        off, q = self.y[:, None] - np.repeat(p, np.diff(self.first), axis=0), np.array(quantiles)
        each = np.maximum(q * off, (q - 1) * off)
        return each.sum(axis=0) if self.weights is None else self.weights @ each


def _blocks(data: DataFrame, model: Boosted) -> RDD:
    """(cells, predictions) of so many rows each."""
    n = len(model.features)

    def bin_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = model.bins(np.column_stack([b[i].to_numpy(zero_copy_only=False) for i in range(n)]))
            ends = np.arange(0, bins.size + 1, n, dtype=np.int32)
            cell = pa.Array.from_buffers(pa.binary(), len(bins), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(bins))])
            yield pa.RecordBatch.from_arrays([cell, b[n].cast(pa.float64())], ["cell", "y"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= BLOCK_ROWS:
                yield block(held)
                held, rows = [], 0
        if rows:
            yield block(held)

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        # Every cell has n bytes, so they are one matrix.
        bins = np.frombuffer(b"".join(b"".join(b["cell"].to_pylist()) for b in held), np.uint8).reshape(-1, n)
        y, w = (np.concatenate([b[c].to_numpy(zero_copy_only=False) for b in held]) for c in ("y", "n"))
        new = np.flatnonzero(np.concatenate([[True], (bins[1:] != bins[:-1]).any(axis=1)]))
        first = np.append(new, len(y)).astype(np.int64)
        parts = [bins[new].tobytes(), first.tobytes(), y.tobytes(), None if (w == 1).all() else w.astype(np.int64).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in parts], ["bins", "first", "y", "weights"])

    def unpack(r):
        bins = np.frombuffer(r["bins"], np.uint8).reshape(-1, n)
        cells = Cells(bins, np.frombuffer(r["first"], np.int64), np.frombuffer(r["y"]), None if r["weights"] is None else np.frombuffer(r["weights"], np.int64))
        return cells, np.tile(model.first, (len(bins), 1))

    # Equal rows are one row with a count, so that none of them fills a range; a cell with many labels lies in several.
    rows = materialise(data.mapInArrow(bin_, "cell binary, y double").groupBy("cell", "y").agg(F.count("*").alias("n")), "boosting")
    count, tasks = rows.count(), data.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(tasks, -(-count // LEAST_BLOCK)), -(-count // BLOCK_ROWS))
    ordered = rows.repartitionByRange(parts, "cell", "y").sortWithinPartitions("cell", "y")
    return ordered.mapInArrow(pack, "bins binary, first binary, y binary, weights binary").rdd.map(unpack)


def _deep(rdd: RDD) -> int:
    return 1 if rdd.getNumPartitions() <= FEW_PARTS else 2


def _levels(rdd: RDD, model: Boosted, start: int, grown: list[Tree], level: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows, and rows below their prediction, by (quantile, node of the level, feature, bin); the losses, at the root's level only; all rows."""
    n_models, n_features, nodes = len(model.quantiles), len(model.features), 1 << level
    width = max(len(e) for e in model.edges) + 1
    recent, quantiles = model.since(start), model.quantiles

    def count(block):
        cells, held = block
        p = recent.add(cells.bins, held, 0, len(recent.trees))
        out = np.zeros((n_models, 2, nodes * n_features * width), np.int64)
        column = cells.bins.astype(np.int64) + np.arange(n_features) * width
        upto = cells.upto()
        start, n = upto[cells.first[:-1]], np.diff(upto[cells.first])
        for m in range(n_models):
            at = grown[m].places(cells.bins, level) - (nodes - 1) if level else np.zeros(len(n), np.int64)
            here = at >= 0
            slot = (at[here, None] * (n_features * width) + column[here]).reshape(-1)
            low = upto[cells.below(p[:, m])] - start
            # Whole numbers far below 2^53.
            for i, rows in enumerate((n, low)):
                out[m, i] = np.bincount(slot, np.repeat(rows[here], n_features), out.shape[2])
        return out, cells.losses(p, quantiles) if level == 0 else 0.0, int(n.sum())

    counts, losses, n = rdd.map(count).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2]), _deep(rdd))
    return counts.reshape(n_models, 2, nodes, n_features, width), losses, n


def best_split(n: np.ndarray, low: np.ndarray, q: float, least: int) -> tuple[int, int]:
    """(feature, last bin of the left side) with the largest fall in squares of a node's signs, or (-1, 0)."""
    left, left_low = np.cumsum(n, axis=1)[:, :-1], np.cumsum(low, axis=1)[:, :-1]
    total, total_low = n[0].sum(), low[0].sum()
    right, right_low = total - left, total_low - left_low
    # A row counts q, less 1 if it lies below its prediction; constants don't change the fall.
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left * (right / total) * (left_low / left - right_low / right) ** 2
    gain = np.where((left >= least) & (right >= least), gain, -1.0)
    if not gain.size or gain.max() <= 1e-12:
        return -1, 0
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return int(f), int(b)


def _leaf_values(rdd: RDD, model: Boosted, start: int, grown: list[Tree]) -> list[Tree]:
    recent = model.since(start)

    def summarise(block):
        cells, held = block
        p = recent.add(cells.bins, held, 0, len(recent.trees))
        sizes, out = np.diff(cells.first), {}
        for m, t in enumerate(grown):
            at, off = t.places(cells.bins), cells.y - np.repeat(p[:, m], sizes)
            rows = np.repeat(at, sizes)
            for leaf in np.unique(at):
                mine = rows == leaf
                out[m, int(leaf)] = thin_ones(off[mine]) if cells.weights is None else thin(off[mine], cells.weights[mine].astype(np.float64))
        return out

    told = rdd.map(summarise).treeReduce(_merge)
    for (m, leaf), (v, w) in told.items():
        grown[m].value[leaf] = quantile_of(v, w, model.quantiles[m])
    return grown


def fit(df: DataFrame, features: list[str], label: str, quantiles=QUANTILES, rounds: int = ROUNDS, depth: int = DEPTH, least: int = LEAST_ROWS, rate: float = RATE, bins: int = BINS) -> Boosted:
    """An ensemble of ``rounds`` trees for each quantile of ``label``.

    Rows without label are left out, missing features (null or NaN) count as
    0. Bin edges are values of the data within ``EDGE_ERROR`` of their rank,
    the same for all ensembles. A leaf value is exact for leaves of up to
    2 * ``POINTS`` rows, and within 1 / (2 * ``POINTS``) of its rank for each
    merge of larger ones. Without rows the result predicts 0.
    """
    x = [F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(features)]
    y = F.col(f"`{label}`").cast("double")
    data = df.where(y.isNotNull() & ~F.isnan(y)).select(*x, y.alias("y"))
    names = [f"x{i}" for i in range(len(features))]
    told = data.approxQuantile([*names, "y"], [i / bins for i in range(1, bins)] + list(quantiles), EDGE_ERROR)
    if not told[-1]:
        return Boosted(list(features), tuple(quantiles), [np.zeros(0)] * len(features), np.zeros(len(quantiles)), rate=rate)
    model = Boosted(list(features), tuple(quantiles), [np.unique(t[: bins - 1]) for t in told[:-1]], np.array(told[-1][bins - 1 :]), rate=rate)
    held = _blocks(data, model).persist(StorageLevel.MEMORY_AND_DISK)
    start = 0
    for r in range(rounds + 1):
        if r - start == KEEP_ROUNDS:
            recent = model.since(start)
            advanced = held.map(lambda b, m=recent: (b[0], m.add(b[0].bins, b[1], 0, len(m.trees)))).persist(StorageLevel.MEMORY_AND_DISK)
            advanced.count()
            held.unpersist()
            held, start = advanced, r
        size = (2 << depth) - 1
        grown = [Tree(np.full(size, -1, np.int64), np.zeros(size, np.int64), np.zeros(size)) for _ in quantiles]
        for level in range(depth):
            counts, losses, n = _levels(held, model, start, grown, level)
            if level == 0:
                model.risks.append((losses / n).tolist())
                if r == rounds:
                    break
            base, split = (1 << level) - 1, False
            for m, q in enumerate(quantiles):
                for node in range(1 << level):
                    f, cut = best_split(*counts[m, :, node], q, least)
                    grown[m].feature[base + node], grown[m].cut[base + node] = f, cut
                    split = split or f >= 0
            if not split:
                break
        if r < rounds:
            model.trees.append(_leaf_values(held, model, start, grown))
    held.unpersist()
    return model


def predict(df: DataFrame, model: Boosted, names: list[str] | None = None) -> DataFrame:
    """``df`` with a column for each quantile (``q10``, ``q50``, ... unless named); columns of those names are replaced."""
    names = names or [f"q{round(q * 100)}" for q in model.quantiles]
    taken = {n.lower() for n in names}
    kept = [c for c in df.columns if c.lower() not in taken]
    x = [F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"__x{i}") for i, c in enumerate(model.features)]
    shown = df.select(*[f"`{c}`" for c in kept], *x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(kept)
            p = model.predict(np.column_stack([b[n + i].to_numpy(zero_copy_only=False) for i in range(len(model.features))]))
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *[pa.array(p[:, m]) for m in range(len(names))]], [*kept, *names])

    return shown.mapInArrow(run, StructType([*shown.schema.fields[: len(kept)], *[StructField(n, DoubleType()) for n in names]]))
