"""From raw documents to a training mixture, stage by stage.

Each stage takes what its predecessor kept, as Parquet in the shared folder.
Documents that the quality classifier rejects go, then documents judged
toxic; of each group of near copies one document stays; documents that hold a
benchmark item go; the mixture is drawn from the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scoreloom.llm.common import scratch
from scoreloom.llm.decontaminate import without_leaks
from scoreloom.llm.jaccard_join import keep_one
from scoreloom.llm.mixing import SHARE, domain_of, mix, target_weights
from scoreloom.llm.quality import keep_good
from scoreloom.llm.toxicity import drop_toxic


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.3, judged by their whole text, row by row.

    A null text counts as empty and gets the score of an empty text; rows
    without id are judged like others, repeated rows each; extra columns pass.
    """
    return keep_good(docs, _table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5, judged by their whole text, row by row; edges as in the quality stage."""
    return drop_toxic(docs, _table(spark, sf_dir, "labels"))


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5 words, 0.8): that with the smallest id, one row of it.

    Rows without id, and rows of ids without any words, are in no group and all stay.
    """
    return keep_one(docs, k=5, t=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none and stay."""
    return without_leaks(docs, _table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows by target weights, once for each epoch that takes them, with domain, epoch, tokens and leaf_budget.

    Null languages and sources are levels of their own; columns of those four names are replaced.
    """
    return mix(docs, domain_of(), SHARE, target_weights(spark))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_copies", near_copies_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: The first stages are trained models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
