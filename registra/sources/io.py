"""Readers and writers of the engine's files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from registra.functions import scalars as S

ATTACHMENT_CAP = 20 * 1024 * 1024

RUN_LOG = "timestamp_utc timestamp, municipality string, municipality_id string, status string, parsed_rows_total int, parsed_rows_kept int, inserted int, skipped int, last_error_type string, scraped_from string, ms int, http_status int, error_message string"
# The columns of a registry snapshot.
REGISTRY = (
    "municipality string, county string, base_url string, data_tier string, verification_status string, attempt_count int, first_seen_utc timestamp, final_url string, homepage_status string, feasibility string, "
    "classification_confidence float, cadence string, rate_limit_policy string, retry_policy string, vendime_url string, vendime_confidence float, prokurime_url string, prokurime_confidence float, "
    "konsultime_url string, konsultime_confidence float, robots_respected string, crawl_notes string, last_checked_utc timestamp, last_seen_utc timestamp, last_error_type string, cooldown_until_utc timestamp, hour_buckets_seen string"
)


def delimiter_of(line: str | None, path: str = "") -> str:
    """';' if a header line has more of them outside quotes than ','; an empty one is an error."""
    line = (line or "").lstrip("\ufeff")
    if not line.strip():
        raise ValueError(f"{path}: the header row is empty")
    outside = "".join(line.split('"')[::2])
    return ";" if outside.count(";") > outside.count(",") else ","


def sniff_delimiters(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files of path by delimiter, each by its own first line."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("place"), "value")
    found: dict[str, list[str]] = {}
    for file, line in lines.groupBy("file").agg(F.min_by("value", "place")).collect():
        found.setdefault(delimiter_of(line, file), []).append(file)
    if not found:
        raise ValueError(f"{path}: the header row is empty")
    return found


def read_export(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """A procurement export of one or many files: delimiter of each file by its first line, trimmed values, empty lines
    skipped, row_index from 0 without gaps, by file and in file order. A row with more or fewer values than the header
    fails the whole read. multiline: values may hold line breaks, which keeps a file in one task; without it files are
    split."""
    parts = None
    for sep, files in sorted(sniff_delimiters(spark, path).items()):
        df = spark.read.csv(files, header=True, sep=sep, quote='"', escape='"', multiLine=multiline, mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
        place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at")]
        own = df.select("*", *place)
        parts = own if parts is None else parts.unionByName(own, allowMissingColumns=True)
    # rows of one block of a file lie together; a row for each block is all that is put in one order
    blocks = parts.groupBy("__file", "__block").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__file", "__block")) - F.col("__n")
    starts = blocks.select("__file", "__block", (before - F.col("__first")).alias("__shift"))
    met = parts.join(F.broadcast(starts), ["__file", "__block"])  # the rows stay where they were read
    return met.withColumn("row_index", F.col("__at") + F.col("__shift")).drop("__file", "__block", "__at", "__shift")


def is_csv(content_type: Column, body: Column) -> Column:
    """By content type first, then by how the body begins; HTML is never CSV."""
    t, start = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.ltrim(F.substring(F.coalesce(body, F.lit("")), 1, 500)))
    html = F.contains(t, F.lit("text/html")) | start.rlike("^(<!doctype|<html|<head|<body)")
    return ~html & (t.rlike("csv|excel|octet-stream|text/plain") | F.split_part(start, F.lit("\n"), F.lit(1)).rlike("[,;]"))


def read_csv_or_reject(spark: SparkSession, paths: str) -> tuple[DataFrame, DataFrame]:
    """(path, body) of text files that are CSV, and of those that aren't."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
    ok = is_csv(F.lit(None).cast("string"), F.col("body"))
    return files.where(ok), files.where(~ok)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True, schema=REGISTRY, multiLine=True, quote='"', escape='"')
    hours = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("hour_buckets_seen", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))
    return df.withColumn("hour_buckets", hours)


def seed_municipalities(target: DataFrame, seed: DataFrame) -> DataFrame:
    """Upsert by name_sq: counties are updated, new names added with their slug as key."""
    new = seed.select("name_sq", F.col("county").alias("new_county"))
    met = target.join(new, "name_sq", "full")
    return met.select(
        F.coalesce("id", F.substring(F.sha1("name_sq"), 1, 20)).alias("id"), "name_sq", F.coalesce("new_county", "county").alias("county"), F.coalesce("name_key", S.slugify(F.col("name_sq"))).alias("name_key")
    )


def seed_registry(registry: DataFrame, municipality: DataFrame) -> DataFrame:
    """One primary row for each municipality that has none."""
    have = registry.where("is_primary").select("municipality_id")
    fresh = municipality.select(F.col("id").alias("municipality_id")).join(have, "municipality_id", "left_anti").withColumn("is_primary", F.lit(True))
    return registry.unionByName(fresh, allowMissingColumns=True)


def read_attachments(spark: SparkSession, path: str, cap: int = ATTACHMENT_CAP) -> DataFrame:
    """(path, size_bytes, sha256, type, accepted) of files; contents above the cap aren't read."""
    return attachments_of(spark.read.format("binaryFile").load(path), cap)


def attachments_of(files: DataFrame, cap: int = ATTACHMENT_CAP, declared: Column | None = None) -> DataFrame:
    """The same of a table of binary files; the declared type is the extension of the file's name, unless given."""
    small = files.where(F.col("length") <= cap)
    if declared is None:
        declared = S.attachment_ext(F.concat(F.lit("http://f/"), F.element_at(F.split("path", "/"), -1)))
    kind = S.detect_attachment_type(F.col("content"), declared)
    read = small.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), kind.alias("type"), kind.isNotNull().alias("accepted"))
    large = files.where(F.col("length") > cap)
    return read.unionByName(large.select("path", F.col("length").alias("size_bytes"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("string").alias("type"), F.lit(False).alias("accepted")))


def read_reviewed(spark: SparkSession, path: str) -> DataFrame:
    """Reviewed URL candidates: municipality_id, confirmed, url (the override, else the proposal)."""
    df = spark.read.json(path, multiLine=True, schema="municipality_id string, confirmed boolean, url string, override_url string")
    return df.select("municipality_id", F.coalesce("confirmed", F.lit(False)).alias("confirmed"), F.coalesce(S.nonblank(F.col("override_url")), S.nonblank(F.col("url"))).alias("url"))


def write_run_log(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").csv(path, header=True, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSX")


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=RUN_LOG, timestampFormat="yyyy-MM-dd'T'HH:mm:ss.SSSX")


def write_search_documents(documents: DataFrame, path: str, reset: bool = False, dry_run: bool = False, file_format: str = "json", rows_per_file: int = 500_000) -> int | None:
    """Write search documents, replacing the index or adding to it; a dry run only counts them."""
    if dry_run:
        return documents.count()
    documents.write.option("maxRecordsPerFile", rows_per_file).mode("overwrite" if reset else "append").format(file_format).save(path)
    return None


def write_report(summary: DataFrame, rows: DataFrame, path: str) -> None:
    """A report as JSON: the summary rows, and the detail rows beside them."""
    summary.write.mode("overwrite").json(f"{path}/summary")
    rows.write.mode("overwrite").json(f"{path}/items")
