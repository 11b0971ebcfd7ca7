"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts and unlabelled texts train linear classifiers in numpy.
With class prior pi, loss l and score f the risk estimator is

    pi * E_p[l(f)] + max(0, E_u[l(-f)] - pi * E_p[l(-f)])

(Kiryo et al. 2017): the unlabelled texts stand for the negatives once the
share of hidden positives is taken off, and where that difference turns
negative, which is over-fitting, its gradient is stepped back instead.

Features are the distinct words of a whole text, and for the beginnings of its
words how many distinct words share them, in powers of two: rare words give
their evidence together. Features are screened by counts that Spark sums, so
the driver holds only what the classifiers learn from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from scoreloom.llm.common import drop_scratch, fresh, held_out, materialise, slices
from scoreloom.llm.labelled import bounded, class_sizes, order_key, sigmoid, training_labels, with_texts
from scoreloom.llm.words import words

#: Bounds of the training sample, in documents of any length.
POSITIVES = 4_000
UNLABELLED = 12_000
#: A feature is kept if so many documents of the sample have it, and if its share among the
#: confirmed texts is so many standard errors from its share among the unlabelled ones.
MIN_DOCS = 3
MIN_SIGMA = 3.0
#: Lengths of the word beginnings.
BEGINNINGS = (4, 6)
#: Weight of the squared weights, for one confirmed text; it shrinks as these grow in number.
RIDGE = 0.4
MODELS = 3
ROUNDS = 150
SEED = 11

_EDGE = re.compile(r"^\W+|\W+$")
#: Words whose ids a worker keeps; a full table starts afresh.
CACHE_WORDS = 100_000
_row: dict[bytes, int] = {}
_table = np.zeros((CACHE_WORDS, 1 + len(BEGINNINGS)), np.uint32)


def _word_ids(word: bytes) -> list[int]:
    """Ids of a word without case and edge punctuation, and of its beginnings (0 where it is no longer than these)."""
    core = _EDGE.sub("", word.decode("utf-8", "replace").casefold())
    parts = [core] + [core[:n] + "\0" if len(core) > n else "" for n in BEGINNINGS]
    return [xxhash.xxh32_intdigest(p.encode("utf-8", "replace")) if p else 0 for p in parts]


def feature_ids(text: str | None) -> np.ndarray:
    """Sorted distinct 32-bit ids of the features of a text."""
    distinct = set(words(text))
    new = [w for w in distinct if w not in _row]
    if len(_row) + len(new) > CACHE_WORDS:
        _row.clear()
        new = distinct
    if len(new) > CACHE_WORDS:
        ids = np.array([_word_ids(w) for w in new], np.uint32)
    else:
        for w in new:
            _table[len(_row)] = _word_ids(w)
            _row[w] = len(_row)
        ids = _table[np.fromiter(map(_row.__getitem__, distinct), np.int64, len(distinct))]
    _, first = np.unique(ids[:, 0], return_index=True)
    ids = ids[first]
    ids = ids[ids[:, 0] != 0]
    out = [ids[:, 0]]
    begun, n = np.unique(ids[:, 1:], return_counts=True)
    begun, n = begun[begun != 0], n[begun != 0]
    level, least = 0, 1
    while len(begun):
        out.append((begun + np.uint32(level * 0x9E3779B1 % 2**32)) * np.uint32(0x85EBCA6B))
        level, least = level + 1, least * 2
        begun, n = begun[n >= least], n[n >= least]
    return np.unique(np.concatenate(out))


@dataclass(frozen=True)
class Model:
    """Weights of the ensemble's mean classifier over sorted feature ids."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, features: np.ndarray) -> float:
        if len(self.ids) == 0 or len(features) == 0:
            return float(sigmoid(np.float64(self.bias)))
        at = np.searchsorted(self.ids, features)
        at[at == len(self.ids)] = 0
        hit = self.ids[at] == features
        return float(sigmoid(np.float64(self.bias + self.weights[at[hit]].sum())))


class _Rows:
    """Sparse 0/1 rows."""

    def __init__(self, rows: list[np.ndarray]):
        self.n = len(rows)
        self.col = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.col, g[self.row], width)


def risk(w: np.ndarray, b: float, p: _Rows, u: _Rows, prior: float) -> tuple[float, float, np.ndarray, float]:
    """The two parts of the non-negative risk, positive and hidden negative, and the gradient that a step follows.

    Where the hidden negative part is below 0 the step goes against its
    gradient, and the positive part is left alone.
    """
    fp, fu = p.dot(w) + b, u.dot(w) + b
    sp, su = sigmoid(fp), sigmoid(fu)
    positive = prior * float(np.mean(np.logaddexp(0, -fp)))
    hidden = float(np.mean(np.logaddexp(0, fu)) - prior * np.mean(np.logaddexp(0, fp)))
    gp, gu = -prior * sp / p.n, su / u.n
    if hidden >= 0:
        gp = gp + prior * (sp - 1) / p.n
    else:
        gp, gu = -gp, -gu
    return positive, hidden, p.back(gp, len(w)) + u.back(gu, len(w)), float(gp.sum() + gu.sum())


def nn_pu(pos: list[np.ndarray], unl: list[np.ndarray], width: int, prior: float, seed: int, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias of one classifier, by Adam on the non-negative risk with logistic loss.

    Each classifier of an ensemble sees its own bootstrap of both samples.
    """
    rng = np.random.default_rng(seed)
    p = _Rows([pos[i] for i in rng.integers(0, len(pos), len(pos))])
    u = _Rows([unl[i] for i in rng.integers(0, len(unl), len(unl))])
    ridge = RIDGE / p.n
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, rounds + 1):
        _, _, grad_w, grad_b = risk(w, b, p, u, prior)
        grad = np.append(grad_w + ridge * w, grad_b)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def telling(features: DataFrame, n_pos: int, n_unl: int) -> np.ndarray:
    """Sorted ids of the features whose document shares differ between the two samples beyond chance."""
    pooled = F.col("n") / (n_pos + n_unl)
    error = F.sqrt(pooled * (1 - pooled) * (1 / n_pos + 1 / n_unl)) + 1e-9
    sigma = F.abs(F.col("n_pos") / n_pos - (F.col("n") - F.col("n_pos")) / n_unl) / error
    counts = features.select("positive", F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n"), F.count_if("positive").alias("n_pos"))
    kept = counts.where((F.col("n") >= MIN_DOCS) & (sigma >= MIN_SIGMA)).select("id").toArrow()["id"].to_numpy()
    return np.sort(kept.astype(np.int32).view(np.uint32))


def train(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> Model:
    """Fit the ensemble on a bounded sample of ``docs`` and ``labels`` (doc_id, toxic).

    At most ``POSITIVES`` confirmed texts and ``UNLABELLED`` texts drawn from
    all that may teach, confirmed or not: the risk estimator wants a sample
    with the share of positives that the prior says, which is that of the
    labels. An id counts once, however many rows it has. Of these texts only the ids of the kept features reach the
    driver. Without a confirmed text, or without any text, the model says the
    class prior, or 0.001 where that is unknown.
    """
    known = training_labels(labels, "toxic").persist()
    sizes = class_sizes(known)
    total = sum(sizes.values())
    prior = min(0.9, max(1e-3, sizes.get(1, 0) / total)) if total else 1e-3
    toxic = bounded(known.where("label = 1").select("doc_id"), POSITIVES, seed)
    n = docs.where(~held_out()).agg(F.approx_count_distinct("doc_id", 0.02)).first()[0]
    share = min(1.0, 1.5 * UNLABELLED / max(n, 1))
    cut = min(int((share - 0.5) * 2**64), 2**63 - 1)
    some = bounded(docs.where(~held_out() & (order_key(seed + 1) <= F.lit(cut))).select("doc_id").distinct(), UNLABELLED, seed + 1)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [feature_ids(t).view(np.int32) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["positive"], pa.array(rows, pa.list_(pa.int32()))], ["positive", "ids"])

    ids = toxic.withColumn("positive", F.lit(True)).unionByName(some.withColumn("positive", F.lit(False)))
    shape = "positive boolean, ids array<int>"
    # An id may be in both samples; with the flag as a column each has its row.
    sample = materialise(with_texts(docs, ids).select("positive", "text").mapInArrow(features, shape), "toxicity-sample")
    known.unpersist()
    n_pos, n_unl = sample.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first()
    if not n_pos or not n_unl:
        return Model(np.zeros(0, np.uint32), np.zeros(0), float(np.log(prior / (1 - prior))))
    kept = telling(sample, n_pos, n_unl)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids = [np.asarray(r.values, np.int32).view(np.uint32) if r.is_valid else kept[:0] for r in b["ids"]]
            rows = [np.searchsorted(kept, np.intersect1d(i, kept)).astype(np.int32) for i in ids]
            yield pa.RecordBatch.from_arrays([b["positive"], pa.array(rows, pa.list_(pa.int32()))], ["positive", "ids"])

    got = sample.mapInArrow(places, shape).toArrow().combine_chunks()
    drop_scratch(sample)
    positive, lists = got["positive"].to_numpy(zero_copy_only=False), got["ids"].combine_chunks()
    ends, at = lists.offsets.to_numpy(), lists.values.to_numpy().astype(np.int64)
    rows = [at[lo:hi] for lo, hi in zip(ends, ends[1:])]
    order = sorted(range(len(rows)), key=lambda i: (len(rows[i]), rows[i].tolist()))  # whatever order they came in
    pos = [rows[i] for i in order if positive[i]]
    unl = [rows[i] for i in order if not positive[i]]
    fits = [nn_pu(pos, unl, len(kept), prior, seed + i) for i in range(MODELS)]
    return Model(kept, np.mean([f[0] for f in fits], axis=0), float(np.mean([f[1] for f in fits])))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score as column ``name``, which must be new; a null text counts as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = pa.array([sent.value.score(feature_ids(t)) for t in b["text"].to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], [*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text of ``docs``.

    Scores depend on the text alone. Null texts and empty texts get the
    score of a text without words. Repeated rows and null ids keep their
    rows; a null id counts as held out. Other columns are ignored.
    """
    model = train(docs, labels, seed)
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold, columns unchanged."""
    name = fresh(docs.columns, "toxicity")
    return score(docs, train(docs, labels, seed), name).where(F.col(name) < threshold).drop(name)
