"""Aggregations: spend, coverage, health, audits, counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from registra.functions import scalars as S
from registra.functions import vocab
from registra.operators.cells import cells
from registra.operators.joins import latest_primary
from registra.operators.predicates import missing_url


def spend_rows(records: DataFrame, items: DataFrame, municipality_id=None, year: int | None = None, currency: str = "ALL") -> DataFrame:
    """Records with an amount in the currency, of items of a municipality and year; drafts count. Adds code."""
    own = items.select(F.col("id").alias("item_id"), "municipality_id", "published_date")
    if year is not None:
        own = own.where((F.col("published_date") >= F.lit(f"{year}-01-01").cast("date")) & (F.col("published_date") < F.lit(f"{year + 1}-01-01").cast("date")))
    if municipality_id is not None:
        own = own.where(F.col("municipality_id") == municipality_id)
    fit = records.where((S.effective_currency(F.col("amount_currency")) == currency) & F.col("amount_value").isNotNull())
    return fit.drop("municipality_id").join(own, "item_id").withColumn("code", F.coalesce(S.nonblank(F.col("cpv_code")), F.lit("UNKNOWN")))


def spend_top_codes(rows: DataFrame, top: int = 10) -> DataFrame:
    """(bucket, position, amount, contracts): the top codes by amount, ties by code, and `other`, always there."""
    codes = rows.groupBy("code").agg(F.sum("amount_value").alias("amount"), F.count("*").alias("contracts"))
    first = codes.orderBy(F.desc("amount"), "code").limit(top)
    ranked = first.withColumn("position", F.row_number().over(Window.orderBy(F.desc("amount"), "code")))  # of `top` rows
    sums = lambda df: df.agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"), F.coalesce(F.sum("contracts"), F.lit(0)).alias("contracts"))
    whole, part = sums(codes), sums(first).select(F.col("amount").alias("a"), F.col("contracts").alias("n"))
    other = whole.join(part).select(F.lit("other").alias("bucket"), F.lit(top + 1).alias("position"), (F.col("amount") - F.col("a")).alias("amount"), (F.col("contracts") - F.col("n")).alias("contracts"))
    every = ranked.select(F.col("code").alias("bucket"), "position", "amount", "contracts").unionByName(other)
    return every.select("bucket", "position", F.col("amount").cast("decimal(18,2)").alias("amount"), "contracts")


def spend_shares(buckets: DataFrame) -> DataFrame:
    """Adds share of the total, zero-safe; empty buckets go."""
    total = F.sum("amount").over(Window.partitionBy())
    return buckets.withColumn("share", F.when(total > 0, F.round(F.col("amount").cast("double") / total.cast("double"), 6)).otherwise(0.0)).where("amount > 0")


def default_year(rows: DataFrame, fallback: int = 2026) -> DataFrame:
    return rows.agg(F.coalesce(F.max(F.year("published_date")), F.lit(fallback)).alias("year"))


def coverage(municipality: DataFrame, registry: DataFrame, items: DataFrame, attachments: DataFrame, categories: list[str] = vocab.CATEGORIES, nationwide: str = vocab.NATIONWIDE_CATEGORY) -> DataFrame:
    """One row for each municipality and category: counts, latest dates, latest attachment, source.

    Attachments are aggregated by item and items by cell, once each; archived items count only for latest_collected."""
    return coverage_of(municipality, registry, cells(items, attachments), categories, nationwide)


def coverage_of(municipality: DataFrame, registry: DataFrame, state: DataFrame, categories: list[str] = vocab.CATEGORIES, nationwide: str = vocab.NATIONWIDE_CATEGORY) -> DataFrame:
    """coverage() from the cells' state, which may be kept up to date by batches (see operators.cells)."""
    every = municipality.select(F.col("id").alias("municipality_id"), "name_key").withColumn("category", F.explode(F.array(*map(F.lit, categories))))
    source = latest_primary(registry).select("municipality_id", "vendime_url", "prokurime_url", "konsultime_url", "homepage_status", "last_error_type")
    met = every.join(state, ["municipality_id", "category"], "left").join(source, "municipality_id", "left")
    own = F.when(F.col("category") == categories[0], F.col("vendime_url")).when(F.col("category") == categories[1], F.col("prokurime_url")).otherwise(F.col("konsultime_url"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("published", "drafts", "published_attachments", "draft_attachments")]
    return met.select(
        "municipality_id", "name_key", "category", *zero, "latest_published", "latest_collected", F.col("last.attachment_id").alias("latest_attachment"), F.col("last.status").alias("latest_attachment_status"),
        ((F.col("category") == nationwide) | ~missing_url(own)).alias("source_set"), "homepage_status", "last_error_type",
    )


def latest_attachment_per_cell(items: DataFrame, attachments: DataFrame) -> DataFrame:
    keyed = attachments.select("item_id", F.col("id").alias("attachment_id"), "created_at").join(items.select(F.col("id").alias("item_id"), "municipality_id", "category", "status"), "item_id")
    best = keyed.groupBy("municipality_id", "category").agg(F.max(F.struct("created_at", "attachment_id", "status")).alias("x"))
    return best.select("municipality_id", "category", "x.attachment_id", F.when(F.col("x.status") != "archived", F.col("x.status")).alias("status"))


def source_status(homepage: Column, error_type: Column, url: Column) -> Column:
    h, e = F.upper(F.coalesce(homepage, F.lit(""))), F.upper(F.coalesce(error_type, F.lit("")))
    return (
        F.when((h == "BLOCKED") | (e == "HTTP_403"), "BLOCKED").when((h == "ERROR") | (e == "TIMEOUT"), "ERROR")
        .when((h == "DOWN") | e.isin(vocab.DOWN_ERRORS), "DOWN").when(missing_url(url), "UNKNOWN").otherwise("OK")
    )


def source_health(municipality: DataFrame, registry: DataFrame) -> DataFrame:
    """(status, sources, name_keys): every municipality by its latest primary row; those without one are UNKNOWN."""
    rows = municipality.select(F.col("id").alias("municipality_id"), "name_key").join(latest_primary(registry), "municipality_id", "left")
    status = source_status(F.col("homepage_status"), F.col("last_error_type"), F.col("vendime_url"))
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("sources"), F.array_join(F.array_sort(F.collect_list("name_key")), ",").alias("name_keys"))


def registry_sanity(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count("*").alias("total"), F.count_if("is_primary").alias("primaries"), *[F.count_if(missing_url(F.col(f"{c}_url"))).alias(f"{c}_missing") for c in ("vendime", "prokurime", "konsultime")])


def not_one_primary(municipality: DataFrame, registry: DataFrame) -> DataFrame:
    n = registry.where("is_primary").groupBy("municipality_id").agg(F.count("*").alias("n"))
    met = municipality.select(F.col("id").alias("municipality_id")).join(n, "municipality_id", "left")
    return met.select("municipality_id", F.coalesce("n", F.lit(0)).alias("primaries")).where("primaries <> 1")


def consultation_counts(items: DataFrame, attachments: DataFrame) -> DataFrame:
    """(municipality_id, items, items_with_attachment, attachments) of published consultation items."""
    own = items.where("status = 'published' and category = 'Konsultime publike'").select("id", "municipality_id")
    n = attachments.groupBy(F.col("item_id").alias("id")).agg(F.count("*").alias("n"))
    return own.join(n, "id", "left").groupBy("municipality_id").agg(F.count_distinct("id").alias("items"), F.count_distinct(F.when(F.col("n") > 0, F.col("id"))).alias("items_with_attachment"), F.coalesce(F.sum("n"), F.lit(0)).alias("attachments"))


def procurement_audit(municipality: DataFrame, items: DataFrame, records: DataFrame, year: int | None = None) -> DataFrame:
    own = items.where(F.col("category") == "Prokurime")
    if year is not None:
        own = own.where(F.year("published_date") == year)
    r = records.select(F.col("item_id").alias("id"), "amount_value", S.effective_currency(F.col("amount_currency")).alias("cur"), F.lit(True).alias("has"))
    met = own.select("id", "municipality_id").join(r, "id", "left").withColumn("amount", F.col("amount_value"))
    money = F.col("has") & F.col("amount").isNotNull()
    per = met.groupBy("municipality_id").agg(
        F.count("*").alias("items"), F.count_if("has").alias("records"), F.count_if(money).alias("with_amount"), F.count_if(F.col("has") & F.col("amount").isNull()).alias("missing_amount"),
        F.count_if(money & (F.col("cur") != "ALL")).alias("other_currency"), F.sum(F.when(F.col("cur") == "ALL", F.col("amount"))).alias("total"),
    )
    out = municipality.select(F.col("id").alias("municipality_id"), "name_key").join(per, "municipality_id", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("items", "records", "with_amount", "missing_amount", "other_currency")]
    return out.select("municipality_id", "name_key", *counts, F.coalesce(F.col("total"), F.lit(0)).cast("decimal(18,2)").alias("total"))


def reason_histogram(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def publish_stats(before: DataFrame, after: DataFrame, attachments: DataFrame) -> DataFrame:
    """Rows that a transition published, those with attachments, and the attachments made public."""
    turned = after.where("status = 'published'").join(before.where("status = 'published'").select("id"), "id", "left_anti").select("id")
    n = attachments.groupBy(F.col("item_id").alias("id")).agg(F.count("*").alias("n"))
    return turned.join(n, "id", "left").agg(F.count("*").alias("published"), F.count("n").alias("with_attachments"), F.coalesce(F.sum("n"), F.lit(0)).alias("attachments_public"))


def authority_frequency(rows: DataFrame, top: int = 50) -> DataFrame:
    name = F.coalesce(S.nonblank(F.col("authority")), F.lit("(missing)")).alias("authority")
    return rows.groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "authority").limit(top)


def failures_by_source(attempts: DataFrame) -> DataFrame:
    """(source_id, timeouts, blocked, last_failure, last_error) of failed attempts."""
    failed = attempts.where("not ok")
    t, b = S.is_timeout(F.col("error_type"), F.col("message")), S.is_blocked(F.col("error_type"), F.col("http_status"), F.col("message"))
    return failed.groupBy("source_id").agg(F.count_if(t).alias("timeouts"), F.count_if(b & ~t).alias("blocked"), F.max("ts").alias("last_failure"), F.max_by("error_type", F.struct("ts", "id")).alias("last_error"))


def category_totals(items: DataFrame) -> DataFrame:
    """(category, is_total, n): published items by category (null is a category of its own), and the grand total."""
    found = items.where("status = 'published'").rollup("category").agg((F.grouping("category") == 1).alias("is_total"), F.count("*").alias("n"))
    return found.select("category", "is_total", "n")


def failures_by_municipality(attempts: DataFrame, registry: DataFrame) -> DataFrame:
    """(municipality_id, timeouts, blocked, last_failure, last_error) of failed attempts at all of its sources."""
    keys = registry.select("source_id", "municipality_id").distinct()
    failed = attempts.where("not ok").join(keys, "source_id")
    t, b = S.is_timeout(F.col("error_type"), F.col("message")), S.is_blocked(F.col("error_type"), F.col("http_status"), F.col("message"))
    return failed.groupBy("municipality_id").agg(F.count_if(t).alias("timeouts"), F.count_if(b & ~t).alias("blocked"), F.max("ts").alias("last_failure"), F.max_by("error_type", F.struct("ts", "id")).alias("last_error"))


def ingest_counters(seen: DataFrame, actions: DataFrame) -> DataFrame:
    """One row of an ingest's counters. seen: (skip_reason, null for kept rows, and match_mode); actions: (action)."""
    rows = seen.agg(
        F.count("*").alias("seen"), F.count_if(F.col("skip_reason").isNull()).alias("kept"), F.count_if(F.col("skip_reason") == "missing_date").alias("missing_date"), F.count_if(F.col("skip_reason") == "wrong_year").alias("wrong_year"),
        F.count_if(F.col("match_mode").isin("primary", "exact_override")).alias("matched_primary"), F.count_if(F.col("match_mode") == "operator_suffix").alias("matched_fallback"), F.count_if(F.col("match_mode").isNull()).alias("unmatched"),
    )
    done = actions.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("inserted", "updated", "skipped")])
    return rows.join(done)  # one row each


ACTIONS = ("inserted", "updated", "skipped")


def observed(rows: DataFrame, counts: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """rows, whose next job also counts: the observation's `get` then has a number for each name, and nothing is read again."""
    seen = Observation()
    return rows.observe(seen, *[F.coalesce(F.count_if(c), F.lit(0)).alias(n) for n, c in counts.items()]), seen


def observed_actions(actions: DataFrame) -> tuple[DataFrame, Observation]:
    """A merge's actions with the number of each kind observed (see observed)."""
    return observed(actions, {a: F.col("action") == a for a in ACTIONS})


def observed_rows(rows: DataFrame) -> tuple[DataFrame, Observation]:
    """Rows of an ingest (skip_reason, match_mode) with the counters that ingest_counters reads from them observed."""
    reason, mode = F.col("skip_reason"), F.col("match_mode")
    return observed(rows, {
        "seen": F.lit(True), "kept": reason.isNull(), "missing_date": reason == "missing_date", "wrong_year": reason == "wrong_year",
        "matched_primary": mode.isin("primary", "exact_override"), "matched_fallback": mode == "operator_suffix", "unmatched": mode.isNull(),
    })


def repair_report(results: DataFrame) -> DataFrame:
    """(status, reason, n) of repaired records, with a row for each status (reason null) and one for all."""
    found = results.rollup("status", "reason").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))
    return found.select("status", "reason", "level", "n")


def checked_baseline(registry: DataFrame) -> DataFrame:
    """Primary rows, rows checked for each category, and rows that carry the old flag (checked) and no new one yet or already."""
    if "checked" in registry.columns:
        old, new = F.coalesce("checked", F.lit(False)), F.coalesce("vendime_checked", F.lit(False))
        registry = registry.withColumn("__done", old & new).withColumn("__old", old)
        own = registry.where("is_primary")
        return own.agg(F.count("*").alias("primaries"), F.count_if("__old").alias("legacy_checked"), F.count_if("__done").alias("backfilled"))
    return registry.where("is_primary").agg(F.count("*").alias("primaries"), F.count_if("vendime_checked").alias("vendime_checked"), F.count_if("prokurime_checked").alias("prokurime_checked"), F.count_if("konsultime_checked").alias("konsultime_checked"))


def batch_outcomes(runs: DataFrame) -> DataFrame:
    bucket = F.when(F.col("status") == "OK", F.when(F.col("parsed_rows_kept") > 0, "ok").otherwise("ok_empty")).when(F.startswith("status", F.lit("SKIPPED")), "skipped").otherwise("failed")
    return runs.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("runs"), F.sum("inserted").alias("inserted"))
