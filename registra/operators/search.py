"""Search documents, filtered search and term search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registra.functions import scalars as S

#: Points for a term in each field, the most important first.
WEIGHTS = {"title": 5, "summary": 4, "municipality": 3, "category": 2, "source_host": 1}


def search_documents(items: DataFrame, municipality: DataFrame) -> DataFrame:
    """Published items as flat documents with sort keys in milliseconds."""
    m = municipality.select(F.col("id").alias("municipality_id"), F.col("name_sq").alias("municipality"), F.col("name_key").alias("municipality_key"))
    own = items.where("status = 'published'").join(m, "municipality_id")
    collected = S.epoch_ms(F.col("collected_at"))
    return own.select(
        "id", "title", "summary", "municipality", "municipality_key", "category", F.year("published_date").alias("year"), "source_url", S.compare_host(F.col("source_url")).alias("source_host"),
        F.coalesce(S.epoch_ms(F.col("published_date")), collected).alias("published_ts"), collected.alias("collected_ts"),
    )


def search_filtered(documents: DataFrame, key: str | None = None, category: str | None = None, year: int | None = None, newest: bool = True, page: int = 1, limit: int = 20) -> DataFrame:
    out = documents
    for column, value in (("municipality_key", key), ("category", category), ("year", year)):
        if value is not None:
            out = out.where(F.col(column) == value)
    order = [F.col(c).desc() if newest else F.col(c).asc() for c in ("published_ts", "collected_ts", "id")]
    return out.orderBy(*order).offset((page - 1) * limit).limit(limit)


def inverted(documents: DataFrame, weights: dict[str, int] = WEIGHTS) -> DataFrame:
    """(term, id, weight): the tokens of the fields, with the weight of the best field that holds them."""
    def terms(column: str, weight: int):
        return F.transform(F.split(S.normalize_title(F.col(column)), " "), lambda t: F.struct(t.alias("term"), F.lit(weight).alias("weight")))

    parts = F.flatten(F.array(*[terms(c, w) for c, w in weights.items()]))
    each = documents.select("id", F.explode(parts).alias("x")).select("id", "x.*").where("term <> ''")
    return each.groupBy("term", "id").agg(F.max("weight").alias("weight"))


def term_search(postings: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """(id, matched, weight): documents by number of distinct query terms, folded like the postings, then weight, then id."""
    terms = list(dict.fromkeys(S.normalized(query).split()))
    hits = postings.where(F.col("term").isin(terms)) if terms else postings.where("false")
    return hits.groupBy("id").agg(F.count("*").alias("matched"), F.sum("weight").alias("weight")).orderBy(F.desc("matched"), F.desc("weight"), "id").limit(limit)
