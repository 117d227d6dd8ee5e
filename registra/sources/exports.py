"""Exports with line breaks in values, read as many tasks.

A file is read by lines, in blocks that Spark chooses. A line begins a record if the number of quotes before it in its
file is even; that number comes from sums: over the blocks before, and over the lines before in its own block. The
lines of a record are put together again, wherever a block ends, and each record is parsed by itself. Values with
quotes or line breaks are quoted and quotes in them doubled, as the CSV rules have it."""

from __future__ import annotations

import csv
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from registra.sources.io import delimiter_of
from registra.sources.shared import shared_dir

PLACE = ["file", "block"]


def header_names(header: str, sep: str) -> list[str]:
    """Column names of a header record as Spark's reader gives them: blank ones by number, repeated ones with it behind."""
    names = [x.strip() for x in next(csv.reader([header.lstrip("\ufeff")], delimiter=sep))]
    low = [x.lower() for x in names]
    return [f"_c{k}" if not x else f"{x}{k}" if low.count(x.lower()) > 1 else x for k, x in enumerate(names)]


def _marked(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line, value, start, odd, nth) of every line: its number in the file, whether it begins a record,
    whether it holds an odd number of quotes, and how many records with content have begun in its block so far."""
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    lines = lines.withColumn("odd", (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2)
    blocks = lines.groupBy(*PLACE).agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum("odd").alias("quotes"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*PLACE, (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"), F.coalesce(F.sum("quotes").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*PLACE).orderBy("at")
    own = F.coalesce(F.sum("odd").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    met = lines.join(blocks, PLACE).withColumn("start", (F.col("before") + own) % 2 == 0)
    begun = F.count_if(F.col("start") & (F.trim(F.regexp_replace("value", r"[\r\ufeff]", "")) != "")).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return met.select(*PLACE, (F.col("at") + F.col("shift")).alias("line"), "value", "start", "odd", begun.alias("nth"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, nth, record): the records of each file with content, the number of their first line and their own,
    the header's being 0."""
    at = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    marked = _marked(spark, path)
    marked.write.parquet(at)  # read for the blocks' sums and for the records
    marked = spark.read.schema(marked.schema).parquet(at)
    blocks = marked.groupBy(*PLACE).agg(F.max("nth").alias("n"), F.max(F.when(F.col("start"), F.col("line"))).alias("last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*PLACE, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.max("last").over(earlier).alias("open"))
    inside = Window.partitionBy(*PLACE).orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = marked.join(blocks, PLACE).withColumn("nth", F.col("before") + F.col("nth") - 1)
    whole = F.col("start") & (F.col("odd") == 0)
    single = met.where(whole).select("file", "line", "nth", F.col("value").alias("record"))
    # lines of records over several lines: the first line is the last that begins one, here or in a block before
    broken = met.where(~whole).withColumn("own", F.coalesce(F.max(F.when(F.col("start"), F.col("line"))).over(inside), F.col("open")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n")
    several = broken.groupBy("file", "own").agg(F.min_by("nth", "line").alias("nth"), joined.alias("record")).select("file", F.col("own").alias("line"), "nth", "record")
    every = single.unionByName(several).withColumn("record", F.regexp_replace("record", r"^\ufeff|\r$", ""))
    return every.where(F.trim("record") != "")


def _parsed(record: Column, names: list[str], sep: str) -> Column:
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "FAILFAST", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    return F.from_csv(record, schema, options)


def read_export_split(spark: SparkSession, path: str) -> DataFrame:
    """What read_export gives, for files of any size with line breaks in values: delimiter of each file by its own header,
    trimmed values, empty lines skipped, row_index from 0 without gaps by file and in file order; a row with more or
    fewer values than the header fails the whole read. One header of each kind reaches the driver."""
    every = records(spark, path)
    at = f"{shared_dir(spark)}/records-{uuid.uuid4().hex}"
    every.write.parquet(at)
    every = spark.read.schema(every.schema).parquet(at)
    heads = every.where("nth = 0").select("file", F.col("record").alias("header"))
    sizes = every.groupBy("file").agg((F.count("*") - 1).alias("n"))
    files = sizes.withColumn("shift", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each file
    met = every.where("nth > 0").join(files.select("file", "shift"), "file").join(heads, "file")
    parts = None
    for (header,) in heads.select("header").distinct().orderBy("header").collect():
        sep = delimiter_of(header, path)
        own = met.where(F.col("header") == header).select(_parsed(F.col("record"), header_names(header, sep), sep).alias("row"), (F.col("nth") - 1 + F.col("shift")).alias("row_index"))
        own = own.select("row.*", "row_index")
        parts = own if parts is None else parts.unionByName(own, allowMissingColumns=True)
    if parts is None:
        raise ValueError(f"{path}: the header row is empty")
    return parts
