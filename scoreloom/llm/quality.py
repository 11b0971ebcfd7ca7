"""Quality by compression: how much better the dictionary of good text fits than that of bad text.

Two zstandard dictionaries are built from labelled good and bad texts, each
line of a class once. A text is compressed piece by piece with each, and once
without any. Its score rests on one number, the normalised difference of the
two sizes,

    (bytes with the bad one - bytes with the good one) * plain bytes / bytes of text ** 2,

which is the difference a byte of text, less where the text repeats itself:
what a text says again compresses to nothing under either dictionary and
speaks for none. A rising curve, fitted on labelled texts that made no
dictionary, turns the number into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from scoreloom.llm.common import drop_scratch, fresh, held_out, materialise, slices
from scoreloom.llm.labelled import bounded, class_sizes, fold, order_key, training_labels, with_texts

#: Bounds of the training sample: labelled rows a class for the dictionaries and for the curve. For the
#: dictionaries, rows whose whole texts would bring their class over so many bytes are passed over as well.
DICTIONARY_DOCS = 2_000
CURVE_DOCS = 3_000
SAMPLE_BYTES = 64_000_000
DICTIONARY_BYTES = 500_000
#: Texts are compressed in pieces of this many bytes, so that what a long text repeats doesn't drown the dictionary.
PIECE_BYTES = 2_048
LEVEL = 3
SEED = 23

_made: dict[bytes, zstandard.ZstdCompressor] = {}


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    if dictionary not in _made:
        if len(_made) > 8:
            _made.clear()
        opts = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        if dictionary:
            d = zstandard.ZstdCompressionDict(dictionary)
            d.precompute_compress(level=LEVEL)
            opts["dict_data"] = d
        _made[dictionary] = zstandard.ZstdCompressor(**opts)
    return _made[dictionary]


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def cut(raw: bytes) -> list[bytes]:
    return [raw[i : i + PIECE_BYTES] for i in range(0, len(raw), PIECE_BYTES)]


def within(rows: list[tuple[int, int, int]], most: int = SAMPLE_BYTES) -> list[int]:
    """Ids of the (id, label, bytes) that stay within so many bytes a label, in the order given; a row that doesn't fit is passed over."""
    used, out = {}, []
    for i, label, n in rows:
        if used.get(label, 0) + n <= most:
            used[label] = used.get(label, 0) + n
            out.append(i)
    return out


def once(texts: list[str]) -> list[bytes]:
    """Pieces of texts without the lines that the ones before have already: what is said often shall not fill a dictionary."""
    seen: set[bytes] = set()
    out = []
    for t in texts:
        lines = [x for x in dict.fromkeys(encoded(t).split(b"\n")) if x not in seen]
        seen.update(lines)
        out += cut(b"\n".join(lines))
    return out


def build_dictionary(pieces: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of pieces of text; their bytes as they are where there are too few to train one."""
    total = sum(map(len, pieces))
    if total == 0:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, total // 8)), pieces, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


def sizes(text: str | None, good: bytes, bad: bytes) -> tuple[float, float, float]:
    """Compressed bytes a byte of text with the good, the bad and no dictionary; slightly damped for tiny texts."""
    raw = encoded(text)
    n = len(raw) + 32
    return tuple(sum(len(c.compress(p)) for p in cut(raw)) / n for c in (_compressor(good), _compressor(bad), _compressor(b"")))


def difference(s: np.ndarray) -> np.ndarray:
    """The normalised difference, from rows of sizes (good, bad, plain)."""
    return (s[:, 1] - s[:, 0]) * s[:, 2]


@dataclass(frozen=True)
class Model:
    """The dictionaries, and the curve: probabilities at rising differences, straight lines between them."""

    good: bytes
    bad: bytes
    at: np.ndarray
    probability: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return np.interp(difference(np.array([sizes(t, self.good, self.bad) for t in texts])), self.at, self.probability)


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points (x, probability) of a rising curve: the steps nearest to y in weighted squares, joined up.

    Steps come from pooling adjacent violators. Each counts one more
    observation of the overall share, so that none says 0 or 1 and a step of
    few says little. A step rises by a tenth of the way to its neighbours
    from its first x to its last, so that texts on one step keep their order.
    """
    blocks: list[list[float]] = []
    for v in np.unique(x):
        same = x == v
        blocks.append([v, v, float((weight * y)[same].sum()), float(weight[same].sum())])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, hi, sy, n = blocks.pop()
            blocks[-1] = [blocks[-1][0], hi, blocks[-1][2] + sy, blocks[-1][3] + n]
    share = float((weight * y).sum() / weight.sum())
    lo, hi, sy, n = np.array(blocks).T
    p = np.maximum.accumulate((sy + share) / (n + 1))
    around = np.concatenate([[0.0], p, [1.0]])
    at = np.column_stack([lo, hi]).reshape(-1)
    value = np.column_stack([p - (p - around[:-2]) / 10, p + (around[2:] - p) / 10]).reshape(-1)
    value[::2][lo == hi] = value[1::2][lo == hi] = p[lo == hi]
    at, first = np.unique(at, return_index=True)
    return at, value[first]


def train(docs: DataFrame, labels: DataFrame, seed: int = SEED) -> Model:
    """Build the dictionaries and the curve from a bounded sample of ``docs`` and ``labels`` (doc_id, quality).

    Folds 1 and 2 of the labelled rows make dictionaries, folds 3 and 4 the
    curve, where each class is weighted back to its share. Texts of the
    first and sizes of the second reach the driver; an id counts once, however
    many rows it has. Where a class has no
    texts, the model says the share of label 1 (1 if there is no label).
    """
    spark = docs.sparkSession
    known = training_labels(labels, "quality").withColumn("dictionary", fold() <= 2).persist()
    share = class_sizes(known)

    def sample(dictionary: bool, n: int) -> DataFrame:
        mine = known.where(F.col("dictionary") == dictionary)
        ids = bounded(mine.where("label = 0"), n, seed).unionByName(bounded(mine.where("label = 1"), n, seed))
        return with_texts(docs, ids.select("doc_id", "label"))

    texts = materialise(sample(True, DICTIONARY_DOCS), "quality-sample")
    sizes_ = texts.select("doc_id", "label", F.octet_length("text").alias("n")).orderBy(order_key(seed), "doc_id").collect()
    taken = spark.createDataFrame([(i,) for i in within([tuple(r) for r in sizes_])], texts.select("doc_id").schema)
    rows = sorted(map(tuple, texts.join(F.broadcast(taken), "doc_id").select("label", "text").collect()))  # whatever order they came in
    drop_scratch(texts)
    good, bad = (build_dictionary(once([t for label, t in rows if label == k])) for k in (1, 0))
    sent = spark.sparkContext.broadcast((good, bad))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            d = difference(np.array([sizes(t, *sent.value) for t in b["text"].to_pylist()]).reshape(-1, 3))
            yield pa.RecordBatch.from_arrays([b["label"], pa.array(d, pa.float64())], ["label", "difference"])

    got = sample(False, CURVE_DOCS).select("label", "text").mapInArrow(measure, "label int, difference double").toArrow()
    known.unpersist()
    sent.destroy()
    x, y = got["difference"].to_numpy(), got["label"].to_numpy().astype(float)
    total = share.get(0, 0) + share.get(1, 0)
    if len(set(y)) < 2 or not good or not bad:
        p = min(max(share.get(1, 0) / total if total else 1.0, 1e-6), 1 - 1e-6)
        return Model(good, bad, np.zeros(1), np.full(1, p))
    weight = np.where(y == 1, share[1] / total / (y == 1).mean(), share[0] / total / (y == 0).mean())
    return Model(good, bad, *fit_curve(x, y, weight))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score as column ``name``, which must be new; a null text counts as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            s = pa.array(sent.value.scores(b["text"].to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], [*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, seed: int = SEED) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text of ``docs``.

    Scores depend on the text alone; null and empty texts get the score of
    size nought. Repeated rows and null ids keep their rows; a null id counts
    as held out. Other columns are ignored.
    """
    return score(docs.select("doc_id", "text"), train(docs, labels, seed)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, columns unchanged."""
    name = fresh(docs.columns, "quality")
    return score(docs, train(docs, labels, seed), name).where(F.col(name) >= threshold).drop(name)
