"""Incremental loads: new files through the batch operators, and windowed counts with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from scoreloom.operators.merge import upsert


def upsert_stream(spark: SparkSession, source: str, schema, target: str, keys: list[str], seq: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Merge whatever files are new in ``source`` into the table below ``target``, then stop.

    Rows lie in buckets of their keys' hash. A batch writes the buckets it
    touches as versions named by its number, so one that is run again after a
    failure writes the same ones; the other buckets keep their last version.
    A manifest of each batch says which version of each bucket is its table,
    so nobody lists the files of other versions; see :func:`expire`.
    """
    def merge(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("bucket", F.pmod(F.hash(*keys), F.lit(buckets)))
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        held = manifest(spark, target, number - 1)
        old = _read(spark, target, {b: v for b, v in held.items() if b in touched})
        rows = upsert(new.limit(0) if old is None else old, new, keys, seq).withColumn("v", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "v").parquet(target)
        now = [(b, v) for b, v in (held | dict.fromkeys(touched, number)).items()]
        spark.createDataFrame(now, "bucket int, v int").coalesce(1).write.mode("overwrite").json(_place(target, number))

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _place(target: str, number: int | None = None) -> str:
    """The folder of a batch's manifest, or of all; its name keeps it out of reads of the table."""
    return f"{target}/_manifests" + ("" if number is None else f"/{number}")


def _folders(spark: SparkSession, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def manifest(spark: SparkSession, target: str, number: int) -> dict[int, int]:
    """The version of each bucket after a batch: a row a bucket, from the last manifest up to it."""
    known = [int(n) for n in _folders(spark, _place(target)) if int(n) <= number]
    if not known:
        return {}
    return {r["bucket"]: r["v"] for r in spark.read.schema("bucket int, v int").json(_place(target, max(known))).collect()}


def _read(spark: SparkSession, target: str, versions: dict[int, int]) -> DataFrame | None:
    if not versions:
        return None
    return spark.read.option("basePath", target).parquet(*[f"{target}/bucket={b}/v={v}" for b, v in sorted(versions.items())]).drop("v")


def expire(spark: SparkSession, target: str, keep: int = 10) -> list[str]:
    """Delete the versions that none of the last ``keep`` manifests names, and the older manifests; the folders that went.

    Tables after older batches can then no longer be read.
    """
    numbers = sorted(int(n) for n in _folders(spark, _place(target)))
    kept = numbers[-keep:] if keep else []
    used = {(b, v) for n in kept for b, v in manifest(spark, target, n).items()}
    gone = [_place(target, n) for n in numbers[: len(numbers) - len(kept)]]
    for bucket in _folders(spark, target):
        if bucket.startswith("bucket="):
            for version in _folders(spark, f"{target}/{bucket}"):
                if (int(bucket.split("=")[1]), int(version.split("=")[1])) not in used:
                    gone.append(f"{target}/{bucket}/{version}")
    for folder in gone:
        at = spark._jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return gone


def read_version(spark: SparkSession, target: str, number: int) -> DataFrame | None:
    """The table after a batch, or None before the first."""
    rows = _read(spark, target, manifest(spark, target, number))
    return None if rows is None else rows.drop("bucket")


def windowed_counts(events: DataFrame, ts: str, keys: list[str], width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by event-time window; rows later than the watermark are dropped by the stream."""
    at = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return at.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def run_to_table(df: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Run a stream over what is there in update mode and read its result: the row of each key that changed last.

    Each batch lands its changed rows below ``path`` under its own number, so
    a batch that is run again replaces its rows.
    """
    spark = df.sparkSession

    def land(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    land(spark.createDataFrame([], df.schema), -1)
    q = df.writeStream.outputMode("update").foreachBatch(land).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rest = [c for c in df.columns if c not in keys]
    last = spark.read.parquet(f"{path}/rows").groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select(*keys, "r.*").select(*df.columns)
