"""The feed's text filter by trigrams: postings name the rows that can match, and ILIKE decides on these alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "bucket"
#: Trigrams of a query whose postings are read: the rarest.
MOST = 4


def grams(text: Column) -> Column:
    """The distinct runs of three characters of the text in small letters; none of a null or shorter text."""
    chars = F.regexp_extract_all(F.lower(text), F.lit("(?s)."), F.lit(0))

    def of(xs):
        at = F.when(F.size(xs) >= 3, F.sequence(F.lit(0), F.size(xs) - 3)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda i: F.concat(F.get(xs, i), F.get(xs, i + 1), F.get(xs, i + 2))))

    return F.coalesce(F.transform(F.array(chars), of)[0], F.array().cast("array<string>"))


def literals(pattern: str) -> list[str]:
    """The pieces of a LIKE pattern that stand for themselves: what lies between % and _, with \\ before a literal one."""
    pieces, piece, at = [], "", 0
    while at < len(pattern):
        c = pattern[at]
        if c in "%_":
            pieces.append(piece)
            piece = ""
        else:
            at += c == "\\" and at + 1 < len(pattern)
            piece += pattern[at]
        at += 1
    return [p for p in [*pieces, piece] if p]


def bucket_of(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


def write_postings(rows: DataFrame, path: str, fields: tuple[str, ...] = ("title", "summary"), key: str = "id", buckets: int = 64) -> None:
    """path/postings (gram, field, key) and path/sizes (gram, n), in folders by hash of the gram and sorted by it there.
    A frequent gram's postings are dealt over tasks by their key, too."""
    def of(k: int) -> Column:
        return F.transform(grams(F.col(fields[k])), lambda g: F.struct(g.alias("gram"), F.lit(k).alias("field")))

    each = F.explode(F.flatten(F.array(*map(of, range(len(fields))))))
    posts = rows.select(F.col(key), each.alias("x")).select(bucket_of(F.col("x.gram"), buckets).alias(BUCKET), "x.*", key)
    posts.repartition(BUCKET, F.pmod(F.xxhash64(key), F.lit(8))).sortWithinPartitions(BUCKET, "gram", "field").write.partitionBy(BUCKET).parquet(f"{path}/postings")
    stored = rows.sparkSession.read.schema(posts.schema).parquet(f"{path}/postings")
    stored.groupBy(BUCKET, "gram").agg(F.count("*").alias("n")).repartition(BUCKET).sortWithinPartitions("gram").write.partitionBy(BUCKET).parquet(f"{path}/sizes")


@dataclass
class Postings:
    """Postings that write_postings() has written, with the same buckets."""

    path: str
    buckets: int = 64

    def candidates(self, spark: SparkSession, pattern: str, key: str = "id") -> DataFrame | None:
        """(key) of the rows with a field that holds the rarest trigrams of the pattern's literal pieces, which every match
        must hold; None if the pattern has no trigram. Only folders of the trigrams are read."""
        pieces = literals(pattern)
        asked = spark.createDataFrame([(p,) for p in pieces], "p string").select(F.explode(grams(F.col("p"))).alias("gram")).distinct()
        asked = asked.select("gram", bucket_of(F.col("gram"), self.buckets).alias(BUCKET)).collect()  # fewer than the pattern's characters
        if not asked:
            return None
        own = lambda table, wanted: spark.read.parquet(f"{self.path}/{table}").where(F.col(BUCKET).isin([r[BUCKET] for r in wanted]) & F.col("gram").isin([r.gram for r in wanted]))
        sizes = {r.gram: r.n for r in own("sizes", asked).collect()}
        rarest = sorted(asked, key=lambda r: (sizes.get(r.gram, 0), r.gram))[:MOST]
        found = own("postings", rarest).groupBy(key, "field").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(rarest))
        return found.select(key).distinct()


def matching(rows: DataFrame, postings: Postings, text: str, fields: tuple[str, ...] = ("title", "summary"), key: str = "id") -> DataFrame:
    """The rows with a field ILIKE %text%, in which % and _ stay wildcards: those of the candidates, or, of a text without a
    trigram, of all rows."""
    found = postings.candidates(rows.sparkSession, f"%{text}%", key)
    some = rows if found is None else rows.join(found, key, "left_semi")
    fits = F.lit(False)
    for c in fields:
        fits = fits | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
    return some.where(fits)
