"""Pages of a table in one order, however deep: rows are stored by range of the order, with the number of rows before
each range, and a page reads the ranges that it lies in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE, AT, RANK = "__range", "__at", "rank"
_ROW_BITS = 33  # of monotonically_increasing_id: the row in its partition


def feed_order(newest: bool = True) -> list[Column]:
    """The order of feed_page."""
    order = [F.coalesce(F.col("published_date").cast("timestamp_ntz"), F.col("collected_at")), F.col("collected_at"), F.col("id")]
    return [c.desc() if newest else c.asc() for c in order]


def write_pages(rows: DataFrame, order: list[Column], path: str, ranges: int) -> None:
    """Rows under path/rows, a folder for each of about `ranges` ranges of the order, sorted inside; path/ranges has the
    range, its first rank and its number of rows. The order should leave no ties: rows that tie are in no fixed order."""
    spark = rows.sparkSession
    placed = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn(AT, F.monotonically_increasing_id())
    placed.withColumn(RANGE, F.shiftright(AT, _ROW_BITS).cast("int")).write.partitionBy(RANGE).parquet(f"{path}/rows")
    stored = spark.read.schema(placed.schema.add(RANGE, "integer")).parquet(f"{path}/rows")
    counts = stored.groupBy(RANGE).agg(F.count("*").alias("n"), F.min(AT).alias("begin"))
    before = F.sum("n").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1))  # of as many rows as ranges
    counts.withColumn("first", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{path}/ranges")


def total(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/ranges").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def last_page(spark: SparkSession, path: str, limit: int) -> int:
    """The number of the last page that has rows; 1 for an empty table."""
    return max(1, -(-total(spark, path) // limit))


def read_page(spark: SparkSession, path: str, page: int, limit: int = 20) -> DataFrame:
    """Rows of a page with their rank from 0, in order; none beyond the end. Only folders of its ranges are opened: at most
    `limit`, as each holds a row of the page."""
    low, high = (page - 1) * limit, page * limit
    found = spark.read.parquet(f"{path}/ranges").where((F.col("first") < high) & (F.col("first") + F.col("n") > low)).collect()
    rows = spark.read.parquet(f"{path}/rows")
    own, rank = F.lit(False), F.lit(None).cast("long")
    for r in found:
        here = (F.col(RANGE) == r[RANGE]) & (F.col(AT) >= r.begin + max(0, low - r["first"])) & (F.col(AT) < r.begin + high - r["first"])
        own, rank = own | here, F.when(F.col(RANGE) == r[RANGE], F.col(AT) - r.begin + r["first"]).otherwise(rank)
    return rows.where(own).withColumn(RANK, rank).drop(RANGE, AT).orderBy(RANK)
