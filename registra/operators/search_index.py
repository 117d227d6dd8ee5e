"""A search index in segments: postings sorted by term, a small segment for each batch of changes, ranks by attribute.

path/postings has (term, id, attribute) in ranges of terms, so a search reads the row groups of its words, and, for the
last word, of the range of terms that begin with it. path/documents has the ids of each segment, and whether they were
deleted. Of a document that is in several segments the newest one counts: hits of older ones meet the ids of the
segments after the first, which are small until they are merged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registra.functions import scalars as S

#: Attributes, the most important first.
ATTRIBUTES = ["title", "summary", "municipality", "category", "source_host"]
SEGMENT = "segment"
DOCUMENTS = "id bigint, deleted boolean, segment int"


def postings(documents: DataFrame, attributes: list[str] = ATTRIBUTES) -> DataFrame:
    """(term, id, attribute): the folded words of each document with the number of the first attribute that has them."""

    def words(k: int):
        return F.transform(F.split(S.normalize_title(F.col(attributes[k])), " "), lambda t: F.struct(t.alias("term"), F.lit(k).alias("attribute")))

    every = F.sort_array(F.flatten(F.array(*map(words, range(len(attributes))))))
    first = lambda xs: F.filter(xs, lambda x, i: (x["term"] != "") & ~x["term"].eqNullSafe(F.get(xs, i - 1)["term"]))
    return documents.select("id", F.inline(S.bound(every, first))).select("term", "id", "attribute")


def add_segment(documents: DataFrame, path: str, number: int, deleted: DataFrame | None = None, ranges: int = 32, attributes: list[str] = ATTRIBUTES) -> None:
    """Segment `number`: new and changed documents, and (id) of deleted ones. Ranges are of terms and ids, so that a
    frequent term is several. A segment that is written again replaces itself; numbers grow."""
    posts = postings(documents, attributes).repartitionByRange(ranges, "term", "id").sortWithinPartitions("term", "attribute", "id")
    posts.write.mode("overwrite").option("parquet.block.size", 4 * 1024 * 1024).parquet(f"{path}/postings/{SEGMENT}={number}")
    ids = documents.select("id", F.lit(False).alias("deleted"))
    if deleted is not None:
        ids = ids.unionByName(deleted.select("id", F.lit(True).alias("deleted")).join(ids.select("id"), "id", "left_anti"))
    ids.write.mode("overwrite").parquet(f"{path}/documents/{SEGMENT}={number}")


def _newest(hits: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """hits (id, segment, ...) without those that a later segment has anew or deleted."""
    later = spark.read.schema(DOCUMENTS).parquet(f"{path}/documents").where(F.col(SEGMENT) > 0).groupBy("id").agg(F.max(SEGMENT).alias("__newest"))
    return hits.join(later, "id", "left").where(F.coalesce(F.col("__newest") <= F.col(SEGMENT), F.lit(True))).drop("__newest")


def query_words(query: str) -> tuple[list[str], str | None]:
    """The distinct folded words that must be met whole, and the last word, which may go on; none if a space ends the query."""
    words = S.normalized(query).split()
    last = words.pop() if words and not query[-1].isspace() else None
    return list(dict.fromkeys(words)), last


def search(spark: SparkSession, path: str, query: str, limit: int = 50) -> DataFrame:
    """(id, matched, attribute, places): documents by number of the query's words that they have, then by the first
    attribute with one of them, then by the sum over the words of their first attributes, then id."""
    words, last = query_words(query)
    posts = spark.read.parquet(f"{path}/postings")
    fits = F.col("term").isin(words) if words else F.lit(False)
    if last is not None:
        fits = fits | F.startswith("term", F.lit(last))
    met = [F.when(F.col("term") == w, k) for k, w in enumerate(words)] + ([F.when(F.startswith("term", F.lit(last)), len(words))] if last is not None else [])
    hits = _newest(posts.where(fits), spark, path)
    each = hits.select("id", "attribute", F.explode(F.array_compact(F.array(*met)) if met else F.array().cast("array<int>")).alias("word"))
    best = each.groupBy("id", "word").agg(F.min("attribute").alias("attribute")).groupBy("id").agg(F.count("*").alias("matched"), F.min("attribute").alias("attribute"), F.sum("attribute").alias("places"))
    return best.orderBy(F.desc("matched"), "attribute", "places", "id").limit(limit)


def merged_segments(spark: SparkSession, path: str, to: str, ranges: int = 32) -> None:
    """The index under `to` with what counts of all segments as one."""
    posts = _newest(spark.read.parquet(f"{path}/postings"), spark, path).drop(SEGMENT)
    posts.repartitionByRange(ranges, "term", "id").sortWithinPartitions("term", "attribute", "id").write.option("parquet.block.size", 4 * 1024 * 1024).parquet(f"{to}/postings/{SEGMENT}=0")
    ids = _newest(spark.read.schema(DOCUMENTS).parquet(f"{path}/documents"), spark, path).where("not deleted").drop(SEGMENT)
    ids.write.parquet(f"{to}/documents/{SEGMENT}=0")
