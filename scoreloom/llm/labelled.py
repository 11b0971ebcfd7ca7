"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import fold, held_out


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """doc_id and label (0 or 1) of the rows that may teach.

    Rows in the held-out fold, without id or without label are left out; of
    repeated rows for one id the largest label counts.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & ~held_out())
        .groupBy("doc_id")
        .agg(F.max(F.col(column).cast("int")).alias("label"))
        .where("label in (0, 1)")
    )


def order_key(seed: int) -> F.Column:
    """A seeded pseudo-random order of documents that no partitioning changes."""
    return F.xxhash64(F.lit(seed).cast("long"), F.col("doc_id").cast("string"))


def bounded(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """At most n rows of ``ids``, whose ids must be distinct, by the seeded order."""
    return ids.orderBy(order_key(seed), "doc_id").limit(n)


def class_sizes(known: DataFrame) -> dict[int, int]:
    return {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}


def with_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` (distinct doc_id and other columns) with a text each, where ``docs`` has one.

    The list is bounded, so it is broadcast, and only texts that it names are
    shuffled. Of several rows of one id the text with the smallest hash
    counts, so a sample has no more rows than ids.
    """
    named = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    one = F.min_by("text", F.xxhash64("text")).alias("text")
    return named.groupBy(*ids.columns).agg(one)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


__all__ = ["bounded", "class_sizes", "fold", "order_key", "sigmoid", "training_labels", "with_texts"]
