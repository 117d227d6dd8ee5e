"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from registra.sources.shared import shared_dir


#: Paths that are erased when the scratch() around them ends.
_PATHS: ContextVar[list[str] | None] = ContextVar("paths", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, path: str | None = None, **options) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark, held = df.sparkSession, _PATHS.get()
    if path is None:
        path = new_path(spark, name)
        if held is not None:
            held.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def erase(spark: SparkSession, *paths: str) -> None:
    """Delete folders that no table reads any more."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession):
    """Erases at its end what written() has made inside without a path of its own."""
    made: list[str] = []
    before = _PATHS.set(made)
    try:
        yield
    finally:
        _PATHS.reset(before)
        erase(spark, *made)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000, rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about so many bytes of a column and so many rows, one row at least: a bound on a task's memory."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and (total + size > most or i - start >= rows):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)
