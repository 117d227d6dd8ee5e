"""Top-k, keep-first and paging. Ties are broken by explicit columns, so results don't depend on the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key. Rows with a null key column are one group."""
    return top_k(df, keys, order, 1)


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    n = "__rank"
    while n in df.columns:
        n = "_" + n
    return df.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) <= k).drop(n)


def tagged_union(parts: dict[str, DataFrame], keys: list[str], order: list, tag: str = "part") -> DataFrame:
    """Union of tables of the same columns with the name of each row's table; of rows of one key the one of the first
    table stays, then by order."""
    every = None
    for k, (name, part) in enumerate(parts.items()):
        own = part.withColumn(tag, F.lit(name)).withColumn("__precedence", F.lit(k))
        every = own if every is None else every.unionByName(own)
    return keep_first(every, keys, ["__precedence", *order]).drop("__precedence")


def with_duplicates(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Adds duplicate_rank: 1 for the row that is kept."""
    return df.withColumn("duplicate_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def document_cap(items: DataFrame, array: str = "documents", most: int = 50) -> DataFrame:
    """One row for each of an item's first documents (url, label), repeated urls skipped."""
    each = items.select("id", F.posexplode(array).alias("pos", "d")).select("id", "pos", "d.*").where("url is not null")
    return top_k(keep_first(each, ["id", "url"], ["pos"]), ["id"], ["pos"], most)


def row_window(df: DataFrame, offset: int, limit: int, row: str = "row_index") -> DataFrame:
    return df.where((F.col(row) >= offset) & (F.col(row) < offset + limit)).withColumn("next_offset", F.lit(offset + limit))


def feed_page(items: DataFrame, page: int = 1, limit: int = 20, newest: bool = True) -> DataFrame:
    order = [F.coalesce(F.col("published_date").cast("timestamp_ntz"), F.col("collected_at")), F.col("collected_at"), F.col("id")]
    return items.orderBy(*[c.desc() if newest else c.asc() for c in order]).offset((page - 1) * limit).limit(limit)


def coverage_order(cells: DataFrame) -> DataFrame:
    return cells.orderBy("name_key", "category")


def in_collation(column: str, collation: str | None) -> Column:
    """The column as it sorts and compares in a collation (`sq`: Albanian, in which dh, gj or xh are letters after d, g and
    x, and ç and ë after c and e); plain without one."""
    return F.collate(F.col(column), collation) if collation else F.col(column)


def municipality_list(municipality: DataFrame, collation: str | None = None) -> DataFrame:
    return municipality.select("id", "name_sq", "name_key", "county").orderBy(in_collation("name_sq", collation), "id")


def candidate_pool(found: DataFrame, common: DataFrame, most_found: int = 20, most: int = 28) -> DataFrame:
    """Candidates (page_id, url, score, pos) of a page's links and of common paths: the first of each URL (without
    fragment) by score, at most `most_found` links, then the common paths that aren't among them; `most` in all."""
    keyed = lambda df: df.withColumn("plain", F.regexp_replace("url", "#.*$", ""))
    links = top_k(keep_first(keyed(found), ["page_id", "plain"], [F.desc("score"), "pos"]), ["page_id"], [F.desc("score"), "pos"], most_found).withColumn("part", F.lit(0))
    paths = keep_first(keyed(common), ["page_id", "plain"], ["pos"]).withColumn("part", F.lit(1))
    both = keep_first(links.unionByName(paths), ["page_id", "plain"], ["part"])
    return top_k(both, ["page_id"], ["part", F.when(F.col("part") == 0, -F.col("score")), "pos"], most).drop("plain", "part")


def latest(items: DataFrame, n: int = 10) -> DataFrame:
    return feed_page(items, 1, n)


def score_table(scores: DataFrame, by: str = "total", descending: bool = True, collation: str | None = None) -> DataFrame:
    """Rows by total or name, ties by name: in small letters, or in a collation."""
    name = in_collation("name_sq", collation) if collation else F.lower("name_sq")
    first = name if by == "name_sq" else F.col(by)
    return scores.orderBy(first.desc() if descending else first.asc(), name, "name_key")
