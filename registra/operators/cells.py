"""Coverage kept up to date: the counts and latest dates of each municipality and category from what merges change,
instead of from all items again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["municipality_id", "category"]
COUNTS = ["published", "drafts", "published_attachments", "draft_attachments", "published_with_attachment"]
LATEST = ["latest_published", "latest_collected", "last"]


def counted(items: DataFrame, attachments: DataFrame) -> DataFrame:
    """items with n, the number of their attachments, and newest, the latest one. Attachments are aggregated by item, then
    met by it, so each table is shuffled once on the item."""
    own = attachments.groupBy("item_id").agg(F.count("*").alias("n"), F.max(F.struct("created_at", F.col("id").alias("attachment_id"))).alias("newest"))
    return items.join(own.withColumnRenamed("item_id", "id"), "id", "left")


def cells(items: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """(municipality_id, category, COUNTS, LATEST) of every cell with an item. Archived items count only for
    latest_collected; last is the latest attachment, with its item's status (null if archived). Items that are counted
    already (see counted()) need no attachments."""
    met = items if attachments is None else counted(items, attachments)
    live, draft, n = F.col("status") == "published", F.col("status") == "draft", F.coalesce("n", F.lit(0))
    shown = F.when(F.col("status") != "archived", F.col("status"))
    last = F.when(F.col("newest").isNotNull(), F.struct("newest.created_at", "newest.attachment_id", shown.alias("status")))
    return met.groupBy(*CELL).agg(
        F.count_if(live).alias("published"), F.count_if(draft).alias("drafts"), F.sum(F.when(live, n).otherwise(0)).alias("published_attachments"), F.sum(F.when(draft, n).otherwise(0)).alias("draft_attachments"),
        F.count_if(live & (n > 0)).alias("published_with_attachment"), F.max(F.when(live, F.col("published_date"))).alias("latest_published"), F.max("collected_at").alias("latest_collected"), F.max(last).alias("last"),
    )


def changed_rows(before: DataFrame, after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of each table that the other lacks: what a merge took away and put in. Both tables meet in one grouping,
    whose exchange the two results share."""
    signed = before.withColumn("__net", F.lit(1)).unionByName(after.withColumn("__net", F.lit(-1)))
    net = signed.groupBy(*before.columns).agg(F.sum("__net").cast("int").alias("__net"))
    side = lambda n: net.where(n > 0).select(*before.columns, F.explode(F.array_repeat(F.lit(0), n)).alias("__k")).drop("__k")
    return side(F.col("__net")), side(-F.col("__net"))


def _gone(name: str) -> Column:
    """The state's maximum was held by a row that changed, and no changed row holds as much now: another row of the cell
    may, or none."""
    held = F.col(f"s.{name}").isNotNull() & F.col(f"b.{name}").eqNullSafe(F.col(f"s.{name}"))
    return held & F.coalesce(F.col(f"a.{name}") < F.col(f"s.{name}"), F.lit(True))


def apply_changes(state: DataFrame, before: DataFrame, after: DataFrame, attachments_before: DataFrame | None = None, attachments_after: DataFrame | None = None) -> DataFrame:
    """state (as cells() gives it) after a change, with `stale`: whether a latest value was taken back, so that it has to
    be looked up (see refreshed()). Cells that lose all that counts stay, with zeros.

    before, after: the item rows that changed, as they were and as they are (a row that is in both cancels out); the
    attachments are those of these items, before and after. An item whose attachments alone change is in both."""
    was, now = cells(before, attachments_before), cells(after, attachments_after)
    packed = lambda df, name: df.select(*CELL, F.struct(*COUNTS, *LATEST).alias(name))
    met = packed(state, "s").join(packed(was, "b").join(packed(now, "a"), CELL, "full"), CELL, "full")
    zero = lambda name, c: F.coalesce(F.col(f"{name}.{c}"), F.lit(0))
    counts = [(zero("s", c) + zero("a", c) - zero("b", c)).alias(c) for c in COUNTS]
    stale = _gone("latest_published") | _gone("latest_collected") | _gone("last")
    return met.select(*CELL, *counts, *[F.greatest(F.col(f"s.{c}"), F.col(f"a.{c}")).alias(c) for c in LATEST], F.coalesce(stale, F.lit(False)).alias("stale"))


def refreshed(state: DataFrame, items: DataFrame, attachments: DataFrame | None = None) -> DataFrame:
    """state without `stale`: stale cells get their latest values from the items and attachments as they are now, of these
    cells alone. Cells whose items are all gone go."""
    worn = state.where("stale")
    if worn.isEmpty():
        return state.drop("stale")
    own = items.join(worn.select(*CELL), CELL, "left_semi")
    met = own if attachments is None else counted(own, attachments.join(own.select(F.col("id").alias("item_id")), "item_id", "left_semi"))
    fresh = cells(met).select(*CELL, F.struct(*LATEST).alias("f"))
    met = state.join(fresh, CELL, "left").where(~F.col("stale") | F.col("f").isNotNull())
    return met.select(*CELL, *COUNTS, *[F.when(F.col("stale"), F.col(f"f.{c}")).otherwise(F.col(c)).alias(c) for c in LATEST])


def consultation_counts(state: DataFrame, category: str = "Konsultime publike") -> DataFrame:
    """(municipality_id, items, items_with_attachment, attachments) of published items of a category, as E5 counts them."""
    own = state.where((F.col("category") == category) & (F.col("published") > 0))
    return own.select("municipality_id", F.col("published").alias("items"), F.col("published_with_attachment").alias("items_with_attachment"), F.col("published_attachments").alias("attachments"))
