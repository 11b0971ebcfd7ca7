"""Shared helpers: the shared folder, table materialisation, folds, components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, from ``spark.checkpoint.dir``.

    Where the setting is absent and Spark runs in this process (tests, a
    laptop), a temporary folder is set and used for the rest of the session.
    On a cluster that is an error: executors don't see one another's disks.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    held = sc.getCheckpointDir()
    if not held:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="scoreloom-"))
        held = sc.getCheckpointDir()
    return held.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/scoreloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(*frames: DataFrame) -> None:
    """Delete the files behind materialised frames that nothing reads any more."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark._jvm
        conf = spark._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/scoreloom/" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that a worker holds few texts as Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
        # A worker keeps no buffers of batches that are done.
        pa.default_memory_pool().release_unused()


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores in front until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fold(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, mod 5; fold 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of frames that nothing refers to any more.

    It does so when the driver collects its garbage, which on an idle driver
    may be long after a step is over.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a row is in the held-out fold; a null id counts as held out, so it never teaches."""
    return F.coalesce(fold(doc_id) == 0, F.lit(True))


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Smallest reachable id for every vertex of an undirected edge list.

    ``edges`` has long columns ``a`` and ``b``; the result has ``v`` and
    ``c``. Labels travel over edges and then jump to their label's label, so
    the number of rounds follows the logarithm of the longest path. Every
    join has one row a key on the label side and every aggregate is a
    minimum that is taken before the shuffle, so a hub is no hot key.
    Self-loops and nulls are ignored.
    """
    e = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = materialise(e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = materialise(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("c")), f"{name}-labels")
    while True:
        heard = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("c").alias("heard"))
        told = labels.join(heard, labels.v == heard.a, "left").select(
            "v", F.col("c").alias("old"), F.least("c", F.coalesce("heard", "c")).alias("near")
        )
        roots = labels.select(F.col("v").alias("r"), F.col("c").alias("far"))
        moved = told.join(roots, told.near == roots.r, "left").select(
            "v", F.least("near", F.coalesce("far", "near")).alias("c"), "old"
        )
        nxt = materialise(moved, f"{name}-labels")
        changed = nxt.where("c <> old").limit(1).count()
        drop_scratch(labels)
        labels = nxt.select("v", "c")
        if not changed:
            drop_scratch(both)
            return labels


