"""Merges: (target, incoming) to a new target and an action for each incoming key. Nothing is written here.

Incoming rows are reduced to one of each key before the join, so a merge doesn't depend on row order, and merging the
result again takes no action. Where the last write wins (upserts, patches), an order can be given; by default it is
that of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registra.functions import scalars as S
from registra.operators.windows import keep_first

ITEM_KEY = ["municipality_id", "category", "dedup_key"]


def last_of(rows: DataFrame, keys: list[str], order: list[str] | None) -> DataFrame:
    """The last row of each key by the columns of order, or in row order. Rows with a null key column are one group."""
    by = [F.col(c).desc_nulls_last() for c in order] if order else [F.desc("__at")]
    return keep_first(rows.withColumn("__at", F.monotonically_increasing_id()), keys, by).drop("__at")


def _pair(target: DataFrame, incoming: DataFrame, key: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """Full join of two tables of the same columns, as structs t and n; n has the columns of more, too."""
    columns = [c for c in target.columns if c != "__out"]
    t = target.select(*key, F.struct(*columns).alias("t"))
    n = incoming.select(*key, F.struct(*columns, *more).alias("n"))
    return t.join(n, key, "full")


def _out_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """rows whose mark __out is also set where a row of the same key without the mark comes before. The first rows are
    found in parts of a key and then among these parts' first ones, so that a frequent key isn't one task's work."""
    part = F.pmod(F.xxhash64("id"), F.lit(256))
    for own in (part, F.lit(None).cast("long")):
        n = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))
        # rows that are out keep to parts of their own, negative and many
        rows = rows.withColumn("__part", F.when(F.col("__out"), -1 - F.pmod(F.xxhash64("id"), F.lit(1 << 20))).otherwise(own))
        rows = rows.repartition(*keys, "__part").withColumn("__n", n).withColumn("__out", F.col("__out") | (F.col("__n") > 1)).drop("__n", "__part")
    return rows


def _merged(pair: DataFrame, columns: list[str], changed: Column, new: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """The new target, and (t.id or n.id, action) for incoming rows."""
    row, action = _outcome(columns, changed, new)
    actions = pair.where(F.col("n").isNotNull()).select(F.col("n.id").alias("id"), action.alias("action"))
    return pair.select(row.alias("row")).select("row.*"), actions


def _outcome(columns: list[str], changed: Column, new: dict[str, Column]) -> tuple[Column, Column]:
    """Of a pair: the row of the new target, and the action for its incoming row."""
    both = F.col("t").isNotNull() & F.col("n").isNotNull()
    change = both & F.coalesce(changed, F.lit(False))
    value = lambda c: F.when(F.col("t").isNull(), F.col(f"n.{c}")).when(change, new.get(c, F.col(f"t.{c}"))).otherwise(F.col(f"t.{c}"))
    action = F.when(F.col("t").isNull(), "inserted").when(change, "updated").otherwise("skipped")
    return F.struct(*[value(c).alias(c) for c in columns]), action


def merge_decisions(target: DataFrame, incoming: DataFrame, publish: bool = False) -> tuple[DataFrame, DataFrame]:
    """Key: municipality, category and dedup key. A source of more weight replaces title, URLs, origin and, where it
    has one, the date; any source fills a missing date; publish only raises the status."""
    first = keep_first(incoming, ITEM_KEY, [S.source_weight(F.col("source_origin")).desc(), F.col("published_date").desc_nulls_last(), F.col("id")])
    pair = _pair(target, first, ITEM_KEY)
    heavier = S.source_weight(F.col("n.source_origin")) > S.source_weight(F.col("t.source_origin"))
    fills = F.col("t.published_date").isNull() & F.col("n.published_date").isNotNull()
    raises = F.lit(publish) & (F.col("t.status") != "published")
    date = F.when(fills, F.col("n.published_date")).when(heavier, F.coalesce("n.published_date", "t.published_date")).otherwise(F.col("t.published_date"))
    new = {c: F.when(heavier, F.col(f"n.{c}")).otherwise(F.col(f"t.{c}")) for c in ("title", "source_url", "source_origin") if c in target.columns}
    new |= {"published_date": date, "status": F.when(raises, "published").otherwise(F.col("t.status"))}
    if "date_unknown" in target.columns:
        new["date_unknown"] = date.isNull()
    return _merged(pair, target.columns, heavier | fills | raises, new)


def merge_documents(target: DataFrame, incoming: DataFrame, publish: bool = False, on_url_conflict: str = "skip") -> tuple[DataFrame, DataFrame]:
    """Title is always refreshed, dates only fill nulls, URLs stay where set, the status only rises.

    on_url_conflict: a new row whose source_url another key of the target has is skipped, or reconciled: merged into
    that row, which takes the new key (it is free, as the row is new) and the new origin, if municipality and category
    are the same."""
    met = merged_documents(target, incoming, publish, on_url_conflict)
    return met.where("row is not null").select("row.*"), met.where("action is not null").select("id", "action")


def merged_documents(target: DataFrame, incoming: DataFrame, publish: bool = False, on_url_conflict: str = "skip") -> DataFrame:
    """merge_documents as one table: row, a row of the new target (null for incoming rows that have no part in it), and id
    and action of the incoming row that it has met, or that was skipped."""
    by_date = [F.col("published_date").desc_nulls_last(), F.col("id")]
    # rows that go are marked, not filtered: the incoming rows are read once, also for their actions
    met = keep_first(incoming, ITEM_KEY, by_date).withColumn("new_key", F.lit(None).cast("string"))
    met = met.join(target.select(*ITEM_KEY).distinct().withColumn("__known", F.lit(True)), ITEM_KEY, "left")
    owners = target.where("source_url is not null").groupBy(F.col("source_url").alias("__u")).agg(F.min(F.struct(*ITEM_KEY)).alias("__own"))
    met = met.withColumn("__u", F.coalesce("source_url", F.concat(F.lit("#"), F.col("id").cast("string")))).join(owners, "__u", "left")
    clash = F.col("__known").isNull() & F.col("source_url").isNotNull() & F.col("__own").isNotNull()
    if on_url_conflict == "reconcile":
        same = (F.col("__own.municipality_id") == F.col("municipality_id")) & (F.col("__own.category") == F.col("category"))
        met = met.withColumn("__moves", clash & F.coalesce(same, F.lit(False))).withColumn("__out", clash & ~F.col("__moves"))
        moved = F.when(F.col("__moves"), F.col("__own.dedup_key"))
        met = met.withColumns({"new_key": F.when(moved.isNotNull(), F.col("dedup_key")), "dedup_key": F.coalesce(moved, "dedup_key")})
        met = _out_of(met, ITEM_KEY, by_date)
    else:
        met = met.withColumn("__out", clash)
    met = _out_of(met, ["__u"], [F.col("id")])
    pair = _pair(target.withColumn("__out", F.lit(False)), met, [*ITEM_KEY, "__out"], ("new_key",))
    fills = F.col("t.published_date").isNull() & F.col("n.published_date").isNotNull()
    raises = F.lit(publish) & (F.col("t.status") != "published")
    moves = F.col("n.new_key").isNotNull()
    new = {
        "dedup_key": F.coalesce("n.new_key", "t.dedup_key"),
        "title": F.col("n.title"),
        "published_date": F.coalesce("t.published_date", "n.published_date"),
        "source_url": F.coalesce("t.source_url", "n.source_url"),
        "status": F.when(raises, "published").otherwise(F.col("t.status")),
    }
    if "date_unknown" in target.columns:
        new["date_unknown"] = F.coalesce("t.published_date", "n.published_date").isNull()
    if "source_origin" in target.columns:
        new["source_origin"] = F.when(moves, F.coalesce("n.source_origin", "t.source_origin")).otherwise(F.col("t.source_origin"))
    changed = moves | ~F.col("n.title").eqNullSafe(F.col("t.title")) | fills | raises | (F.col("t.source_url").isNull() & F.col("n.source_url").isNotNull())
    row, action = _outcome(target.columns, changed, new)
    kept, arrived = ~F.col("__out"), F.col("n").isNotNull()
    return pair.select(F.when(kept, row).alias("row"), F.col("n.id").alias("id"), F.when(arrived & kept, action).when(arrived, "skipped").alias("action"))


def resolve_decision_keys(incoming: DataFrame, target: DataFrame, order: str | None = None) -> DataFrame:
    """incoming with dedup_key: a dated row adopts the key of the same number and title without a date, if that is
    stored, or comes earlier in the batch by the column `order` (without one, rows of a batch don't meet).

    incoming: municipality_id, published_date, number, title_normalized; target: municipality_id, category, dedup_key."""
    title = F.col("title_normalized")
    dated = S.decision_key(F.col("municipality_id"), F.col("published_date"), F.col("number"), title)
    unknown = S.decision_key(F.col("municipality_id"), F.lit(None).cast("date"), F.col("number"), title)
    keys = target.where("category = 'Vendime'").select("municipality_id", "dedup_key").distinct()
    rows = incoming.drop("dedup_key").withColumn("dated_key", dated).withColumn("unknown_key", unknown)
    met = rows.join(keys.select("municipality_id", F.col("dedup_key").alias("dated_key"), F.lit(True).alias("has_dated")), ["municipality_id", "dated_key"], "left")
    met = met.join(keys.select("municipality_id", F.col("dedup_key").alias("unknown_key"), F.lit(True).alias("has_unknown")), ["municipality_id", "unknown_key"], "left")
    if order is not None:
        undated = rows.where("published_date is null").groupBy("municipality_id", "unknown_key").agg(F.min(order).alias("first_unknown"))
        of_dated = rows.where("published_date is not null").groupBy("municipality_id", "dated_key").agg(F.min(order).alias("first_dated"))
        met = met.join(undated, ["municipality_id", "unknown_key"], "left").join(of_dated, ["municipality_id", "dated_key"], "left")
        # the first dated row decides for its key: it is stored under it, unless the undated key was there before
        met = met.withColumn("has_unknown", F.coalesce(F.col("has_unknown") | (F.col("first_unknown") < F.col("first_dated")), F.col("has_unknown"), F.col("first_unknown") < F.col("first_dated"))).drop("first_unknown", "first_dated")
    chosen = F.when(F.col("has_dated").isNull() & F.col("has_unknown") & F.col("published_date").isNotNull(), F.col("unknown_key")).otherwise(F.col("dated_key"))
    return met.withColumn("dedup_key", chosen).drop("dated_key", "unknown_key", "has_dated", "has_unknown")


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Incoming rows replace target rows of the same key; of several incoming rows the last by order (see last_of)."""
    columns, null = target.columns, F.lit(False)
    for c in keys:
        null = null | F.col(c).isNull()
    both = target.withColumn("__new", F.lit(0)).unionByName(last_of(incoming, keys, order).select(*columns, F.lit(1).alias("__new")))
    met = both.withColumn("__any", F.max("__new").over(Window.partitionBy(*keys)))
    return met.where((F.col("__new") == F.col("__any")) | null).select(*columns)


def upsert_scores(target: DataFrame, fresh: DataFrame, indicators: int = 5) -> DataFrame:
    """Automatic values are replaced; final values and arguments stay where a reviewer has overridden them."""
    new = {}
    for k in range(1, indicators + 1):
        over = F.coalesce(F.col(f"t.ind{k}_overridden"), F.lit(False))
        new[f"ind{k}_auto"] = F.col(f"n.ind{k}_auto")
        new[f"ind{k}_final"] = F.when(over, F.col(f"t.ind{k}_final")).otherwise(F.col(f"n.ind{k}_auto"))
        new[f"ind{k}_overridden"] = over
    pair = _pair(target, fresh, ["municipality_id"])
    value = lambda c: F.when(F.col("n").isNull(), F.col(f"t.{c}")).when(F.col("t").isNull(), F.col(f"n.{c}")).otherwise(new.get(c, F.col(f"n.{c}")))
    return pair.select(*[value(c).alias(c) for c in target.columns])


def override_scores(scores: DataFrame, patches: DataFrame, rubric: tuple[int, ...] = (0, 5, 10), indicators: int = 5, order: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """patches: (municipality_id, indicator, action set or clear, value, argument). Gives scores and rejected patches; of
    several patches of one cell the last by order counts (see last_of)."""
    good = F.col("indicator").between(1, indicators) & (((F.col("action") == "set") & F.col("value").isin(list(rubric)) & (F.trim(F.coalesce("argument", F.lit(""))) != "")) | (F.col("action") == "clear"))
    known = patches.join(scores.select("municipality_id"), "municipality_id", "left_semi")
    fit = known.where(F.coalesce(good, F.lit(False)))
    rejected = patches.exceptAll(fit)
    folded = last_of(fit, ["municipality_id", "indicator"], order).groupBy("municipality_id").agg(F.map_from_entries(F.collect_list(F.struct("indicator", F.struct("action", "value")))).alias("p"))
    out = scores.join(folded, "municipality_id", "left")
    for k in range(1, indicators + 1):
        own = F.try_element_at("p", F.lit(k))
        out = out.withColumn(f"ind{k}_final", F.when(own["action"] == "set", own["value"]).when(own["action"] == "clear", None).otherwise(F.col(f"ind{k}_final")))
        out = out.withColumn(f"ind{k}_overridden", F.when(own["action"] == "set", True).when(own["action"] == "clear", False).otherwise(F.col(f"ind{k}_overridden")))
    return out.select(*scores.columns), rejected


def publish(items: DataFrame, keys: DataFrame | None = None, municipality_id=None, category: str | None = None, year: int | None = None) -> DataFrame:
    """Rows of the keys (id), or of the municipality, category and year, become published, archived ones too."""
    chosen = F.lit(True)
    for column, value in (("municipality_id", municipality_id), ("category", category)):
        if value is not None:
            chosen = chosen & (F.col(column) == value)
    if year is not None:
        chosen = chosen & F.coalesce(F.year("published_date") == year, F.lit(False))
    if keys is not None:
        items = items.join(keys.select("id").distinct().withColumn("__chosen", F.lit(True)), "id", "left")
        chosen = chosen & F.coalesce("__chosen", F.lit(False))
    return items.withColumn("status", F.when(chosen, "published").otherwise(F.col("status"))).drop("__chosen")


def attempt_summary(attempts: DataFrame) -> DataFrame:
    """One row for each source: attempts, first and last times, last outcome, the last status that an attempt sets, hour
    buckets; whether any attempt was blocked, and the last final URL that an attempt has."""
    best = F.max_by(F.struct("ok", "error_type"), F.struct("ts", "id"))
    status = F.when(F.col("ok"), "OK").when(F.col("error_type") == "HTTP_403", "BLOCKED").when(F.col("error_type") == "TIMEOUT", "ERROR")
    final = F.col("final_url") if "final_url" in attempts.columns else F.lit(None).cast("string")
    return attempts.groupBy("source_id").agg(
        F.count("*").alias("attempts"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_ok"),
        best.alias("last"), F.max_by(status, F.when(status.isNotNull(), F.struct("ts", "id"))).alias("last_status"), F.array_sort(F.collect_set(S.hour_bucket(F.col("ts")))).alias("hours"),
        F.max(~F.col("ok") & F.col("error_type").eqNullSafe("HTTP_403")).alias("was_blocked"), F.max_by(final, F.when(final.isNotNull(), F.struct("ts", "id"))).alias("last_final_url"),
    )


def apply_attempts(registry: DataFrame, attempts: DataFrame, block_minutes: int = 10080, minutes: int = 30) -> DataFrame:
    """registry (source_id, attempt_count, first_seen, last_checked, last_seen, last_error_type, cooldown_until,
    homepage_status, hour_buckets) after the attempts: counts add up, first_seen is written once, hours are appended,
    the last outcome sets error and cooldown, and the last that is a success, a block or a timeout the status. feasibility and final_url, if the registry has them: C after any
    block, and the last one that an attempt has."""
    met = registry.join(attempt_summary(attempts), "source_id", "left")
    ok, failed = F.coalesce(F.col("last.ok"), F.lit(False)), ~F.coalesce(F.col("last.ok"), F.lit(True))
    error = F.col("last.error_type")
    pause = F.when(error == "HTTP_403", F.col("last_ts") + F.make_dt_interval(mins=F.lit(block_minutes))).otherwise(F.col("last_ts") + F.make_dt_interval(mins=F.lit(minutes)))
    more = {"feasibility": F.when(F.col("was_blocked"), "C").otherwise(F.col("feasibility")) if "feasibility" in registry.columns else None, "final_url": F.coalesce("last_final_url", "final_url") if "final_url" in registry.columns else None}
    return met.select(
        *[x.alias(c) for c, x in more.items() if x is not None],
        "source_id", (F.col("attempt_count") + F.coalesce("attempts", F.lit(0))).alias("attempt_count"), F.coalesce("first_seen", "first_ts").alias("first_seen"),
        F.greatest("last_checked", "last_ts").alias("last_checked"), F.greatest("last_seen", "last_ok").alias("last_seen"),
        F.when(ok, None).when(failed, error).otherwise(F.col("last_error_type")).alias("last_error_type"), F.when(ok, None).when(failed, pause).otherwise(F.col("cooldown_until")).alias("cooldown_until"),
        F.coalesce("last_status", "homepage_status").alias("homepage_status"),
        F.array_sort(F.array_union(F.coalesce("hour_buckets", F.array().cast("array<string>")), F.coalesce("hours", F.array().cast("array<string>")))).alias("hour_buckets"),
    )


def apply_reviewed_urls(registry: DataFrame, reviewed: DataFrame, column: str = "konsultime_url") -> DataFrame:
    """Confirmed candidates (municipality_id, confirmed, url) fill blank URLs of primary rows and reset their errors."""
    good = reviewed.where("confirmed and url is not null").groupBy("municipality_id").agg(F.min("url").alias("__url"))
    met = registry.join(good, "municipality_id", "left")
    fill = F.col("is_primary") & F.col("__url").isNotNull() & (F.trim(F.coalesce(column, F.lit(""))) == "")
    new = {column: F.when(fill, F.col("__url")).otherwise(F.col(column))}
    new |= {c: F.when(~F.coalesce(fill, F.lit(False)), F.col(c)) for c in ("last_error_type", "cooldown_until") if c in registry.columns}
    return met.withColumns(new).select(*registry.columns)


def reconcile_provenance(items: DataFrame, official: DataFrame, publish_them: bool = False) -> DataFrame:
    """Items whose URL is in official (source_url, origin) take its origin, and are published if asked for."""
    own = official.groupBy("source_url").agg(F.min("origin").alias("__origin"))
    met = items.join(own, "source_url", "left")
    hit = F.col("__origin").isNotNull()
    out = met.withColumn("source_origin", F.coalesce("__origin", "source_origin"))
    if publish_them:
        out = out.withColumn("status", F.when(hit, "published").otherwise(F.col("status")))
    return out.select(*items.columns)


def add_attachments(target: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Insert or ignore by (item_id, sha256); the action of each incoming row is stored or duplicate."""
    key = ["item_id", "sha256"]
    ranked = incoming.join(target.select(*key).distinct().withColumn("__has", F.lit(True)), key, "left")
    first = keep_first(ranked.where("__has is null"), key, [F.col("id")])
    actions = incoming.select("id").join(first.select("id", F.lit("stored").alias("action")), "id", "left").select("id", F.coalesce("action", F.lit("duplicate")).alias("action"))
    return target.unionByName(first.select(*target.columns)), actions


def manual_items(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (municipality_id, category, title, published_date, source_url, content) as draft items, and rejected rows with a reason."""
    has_url, has_file = F.coalesce(F.trim("source_url"), F.lit("")) != "", F.col("content").isNotNull()
    reason = F.when(has_url == has_file, "url_or_file").when(has_file & ~F.startswith(F.hex(F.substring("content", 1, 5)), F.lit("255044462D")), "not_a_pdf").when(S.normalize_title(F.col("title")) == "", "missing_title")
    checked = rows.withColumn("reason", reason)
    key = S.manual_key(F.col("municipality_id"), F.col("category"), F.col("published_date"), S.normalize_title(F.col("title")), F.col("source_url"), F.sha2(F.coalesce("content", F.lit("").cast("binary")), 256))
    good = checked.where("reason is null").withColumn("dedup_key", key).withColumn("status", F.lit("draft")).withColumn("date_unknown", F.col("published_date").isNull())
    return keep_first(good.drop("reason", "content"), ["dedup_key"], ["title"]), checked.where("reason is not null")


def set_checked(registry: DataFrame, category: str, municipalities: DataFrame) -> DataFrame:
    column = {"Vendime": "vendime_checked", "Prokurime": "prokurime_checked", "Konsultime publike": "konsultime_checked"}[category]
    hit = municipalities.select("municipality_id").distinct().withColumn("__hit", F.lit(True))
    met = registry.join(hit, "municipality_id", "left")
    return met.withColumn(column, F.coalesce("__hit", column)).select(*registry.columns)


def regenerate_keys(municipality: DataFrame, alias: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Name keys made anew from names; a key that changes becomes an alias."""
    new = municipality.withColumn("new_key", S.slugify(F.col("name_sq")))
    old = new.where("not (name_key <=> new_key) and name_key is not null").select(F.col("name_key").alias("alias_key"), F.col("id").alias("municipality_id"))
    aliases = alias.unionByName(old.join(alias, "alias_key", "left_anti"))
    return new.withColumn("name_key", F.col("new_key")).drop("new_key"), aliases


def lookup_items(wanted: DataFrame, items: DataFrame) -> DataFrame:
    """(wanted.key, id): by municipality, category and dedup key, else by source URL."""
    by_key = items.groupBy(*ITEM_KEY).agg(F.min("id").alias("by_key"))
    by_url = items.where("source_url is not null").groupBy("source_url").agg(F.min("id").alias("by_url"))
    return wanted.join(by_key, ITEM_KEY, "left").join(by_url, "source_url", "left").withColumn("id", F.coalesce("by_key", "by_url")).drop("by_key", "by_url")
