"""Structured Streaming forms of activity windows, document ingest and source state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registra.operators import merges


def hour_activity(attempts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(source_id, hour, attempts, errors) by hour windows; rows later than the watermark are dropped. Batch or stream."""
    timed = attempts.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = timed.withWatermark("ts", delay) if attempts.isStreaming else timed
    found = marked.groupBy(F.window("ts", "1 hour"), "source_id").agg(F.count("*").alias("attempts"), F.count_if(~F.col("ok")).alias("errors"))
    return found.select("source_id", F.date_format("window.start", "yyyy-MM-dd'T'HH").alias("hour"), "attempts", "errors")


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of a table that are complete, oldest first. A version is a folder that Spark has marked as written."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(fs_path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(fs_path)]
    done = [n for n in names if n.startswith("v=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(int(n[2:]) for n in done)


def current(spark: SparkSession, path: str) -> DataFrame | None:
    found = versions(spark, path)
    return spark.read.parquet(f"{path}/v={found[-1]}") if found else None


def versioned_merge(path: str, merge: Callable[[DataFrame | None, DataFrame], DataFrame], keep: int = 2) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: batch k reads the newest version before k + 1 and writes version k + 1. A batch that
    is run again finds its version complete and does nothing, so each batch takes effect once. The newest `keep`
    versions stay (the last one for the next batch, others for readers); older ones, and what lost batches have left of
    them, are deleted. A version is the whole table: merges look across keys (an address belongs to one item), so a
    batch can touch rows of any partition."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = versions(spark, path)
        if batch_id + 1 in found:
            return
        before = [v for v in found if v <= batch_id]
        target = spark.read.parquet(f"{path}/v={before[-1]}") if before else None
        merge(target, batch).write.mode("overwrite").parquet(f"{path}/v={batch_id + 1}")
        for v in [*before, batch_id + 1][:-keep]:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v={v}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return run


def ingest_documents(target: DataFrame | None, batch: DataFrame) -> DataFrame:
    return merges.merge_documents(batch.limit(0) if target is None else target, batch)[0]


def source_state(registry: DataFrame) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """Merge for versioned_merge: applies a batch of attempts to the last state, or to the given registry at first."""
    return lambda target, batch: merges.apply_attempts(registry if target is None else target, batch)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process all that is there now in batches, then stop."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
