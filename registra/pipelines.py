"""The engine's pipelines, composed of the operators: tables in, tables out. Only what several results of an ingest read is
written, to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.functions import scalars as S
from registra.functions import vocab
from registra.operators import aggs, joins, merges, predicates, scoring, windows
from registra.sources.shared import written

ITEM = ["id", "municipality_id", "category", "title", "published_date", "date_unknown", "source_url", "source_origin", "dedup_key", "status"]


def ingest_procurement(export: DataFrame, export_url: str, municipality: DataFrame, alias: DataFrame, items: DataFrame, records: DataFrame, year: int | None = None, publish: bool = False) -> dict[str, DataFrame]:
    """An export's rows as items of the municipalities that they name and as records of these items.

    items: ITEM; records: item_id and fields of procurement_records. Gives the new items and records, the action for
    each incoming item, and one row of counters."""
    terms = joins.authority_terms(municipality, alias)
    own = [x for c, x in predicates.record_columns(export).items() if c in records.columns]
    rows = predicates.year_gate(export.select("*", F.struct(*predicates.item_columns(export, export_url)).alias("__item")), year, "__item.published_date")
    # only kept rows' amounts and codes are read
    rows = rows.select(export["row_index"], "__item.*", "skip_reason", F.when(F.col("skip_reason").isNull(), F.struct(*own)).alias("record"))
    rows = written(rows, "rows")
    match = joins.match_authorities(rows.select(F.struct(*rows.columns).alias("id"), "authority"), terms)
    seen = match.select("id.*", "municipality_id", "match_mode")
    kept = seen.where("skip_reason is null and municipality_id is not null")
    key = S.procurement_key(F.col("municipality_id"), F.col("procedure_id"), F.col("published_date"), S.normalize_title(F.col("title")))
    incoming = kept.withColumn("dedup_key", key).select(
        F.xxhash64("municipality_id", "dedup_key").alias("id"), "municipality_id", F.lit(vocab.NATIONWIDE_CATEGORY).alias("category"), "title", "published_date", F.col("published_date").isNull().alias("date_unknown"), "source_url",
        S.compare_host(F.lit(export_url)).alias("source_origin"), "dedup_key", predicates.publish_decision(publish, F.lit(False)).alias("status"), "row_index", "record",
    )
    merged, actions = merges.merge_documents(items.select(*ITEM), incoming, publish=publish)
    of_row = incoming.select("row_index", "record", *merges.ITEM_KEY).join(merged.select(*merges.ITEM_KEY, F.col("id").alias("item_id")), merges.ITEM_KEY)
    fresh = of_row.select("row_index", "record.*", "item_id", F.lit(export_url).alias("source_export_url"))
    fields = [c for c in records.columns if c in fresh.columns]
    return {
        "items": merged,
        "records": merges.upsert(records.select(*fields), fresh, ["item_id"], ["row_index"]),
        "actions": actions,
        "counters": aggs.ingest_counters(seen, actions),
    }


def rebuild_records(items: DataFrame, rows: DataFrame, rejects: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of procurement items made anew from the exports that their source URLs name.

    items: (id, source_url, procedure_id, published_date, title). rows: rows of all exports with export_url, row_index
    and what procurement_items and procurement_records give; rejects: (export_url, reason) of exports that are no CSV
    (export_not_csv) or couldn't be read. Gives the new records, and for each item a status (upserted or skipped), a
    reason, how it was matched, and the number of candidates."""
    parts = S.export_url_parts(F.trim("source_url"))
    asked = items.withColumn("is_export", S.is_export_url(F.col("source_url"))).withColumn("export_url", F.when(F.col("is_export"), parts["page"]))
    asked = asked.withColumn("procedure_id", F.coalesce(S.nonblank(parts["procedure"]), "procedure_id"))
    asked = asked.join(rejects.select("export_url", F.col("reason").alias("reject_reason"), F.lit(True).alias("rejected")), "export_url", "left")
    # items of other sources and of rejected exports have no scope, so they meet no row
    asked = asked.withColumn("scope", F.when(F.col("is_export") & F.col("rejected").isNull(), F.col("export_url")))
    fields = [c for c in records.columns if c in rows.columns]
    met = joins.match_export_rows(asked, rows.withColumn("scope", F.col("export_url")), "scope", ("is_export", "reject_reason", "export_url", "procedure_id"), F.struct(*fields))
    met = met.withColumnRenamed("reason", "match_reason")
    found = F.col("row").isNotNull()
    reason = (
        F.when(~F.col("is_export"), "source_not_exportdocument").when(F.col("reject_reason").isNotNull(), F.col("reject_reason")).when(~found, F.col("match_reason"))
        .when(F.col("row.amount_value").isNull(), "record_upserted_amount_null").otherwise("record_upserted")
    )
    met = met.withColumn("status", F.when(found, "upserted").otherwise("skipped")).withColumn("out_reason", reason)
    fresh = met.where(found).select(F.col("id").alias("item_id"), *[F.col(f"row.{c}").alias(c) for c in fields if c != "procedure_ref"], F.coalesce("row.procedure_ref", "procedure_id").alias("procedure_ref"), F.col("export_url").alias("source_export_url"))
    done = merges.upsert(records, fresh.select(*[c for c in records.columns if c in fresh.columns]), ["item_id"])
    return done, met.select("id", "status", F.col("out_reason").alias("reason"), F.when(found, F.col("match_reason")).alias("match_strategy"), "candidates")


def ingest_documents(incoming: DataFrame, items: DataFrame, publish: bool = False, on_url_conflict: str = "reconcile") -> dict[str, DataFrame]:
    """Scraped documents (ITEM) into the items: merged, with the action for each and counts of actions."""
    merged, actions = merges.merge_documents(items.select(*ITEM), incoming.select(*ITEM), publish, on_url_conflict)
    return {"items": merged, "actions": actions, "counters": aggs.reason_histogram(actions, "action")}


def build_feed(items: DataFrame, municipality: DataFrame, alias: DataFrame, attachments: DataFrame, key: str | None = None, category: str | None = None, year: int | None = None, text: str | None = None, page: int = 1, limit: int = 20, newest: bool = True) -> tuple[DataFrame, DataFrame]:
    """One page of the public feed, with municipality and attachments, and the total of the same filters."""
    predicates.check_parameters(page, limit, year=year, key=key, q=text)
    ids = None
    if key is not None:
        wanted = municipality.sparkSession.createDataFrame([(key,)], "key string")
        ids = joins.resolve_keys(wanted, municipality, alias).where("municipality_id is not null").select("municipality_id")
    found = predicates.feed_filter(items, ids, category, year, text)
    first = windows.feed_page(joins.with_municipality(found, municipality), page, limit, newest)
    return joins.with_attachments(first, attachments), found.agg(F.count("*").alias("total"))


def spend_dashboard(records: DataFrame, items: DataFrame, municipality_id=None, year: int | None = None, top: int = 10, names: dict[str, str] = vocab.CPV_NAMES) -> DataFrame:
    """(bucket, position, amount, contracts, share, title, secondary) of a municipality and year."""
    buckets = aggs.spend_shares(aggs.spend_top_codes(aggs.spend_rows(records, items, municipality_id, year), top))
    shown = S.cpv_display(F.col("bucket"), F.col("bucket"), names)
    return buckets.withColumn("title", shown["title"]).withColumn("secondary", shown["secondary"])


def coverage_matrix(municipality: DataFrame, registry: DataFrame, items: DataFrame, attachments: DataFrame) -> DataFrame:
    return windows.coverage_order(aggs.coverage(municipality, registry, items, attachments))


def consultation_scores(municipality: DataFrame, registry: DataFrame, items: DataFrame, attachments: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The score table: automatic values computed anew, final values of `stored` kept where a reviewer has overridden them."""
    fresh = scoring.indicator_scores(municipality, registry, items, attachments)
    for k in range(1, 6):
        fresh = fresh.withColumn(f"ind{k}_final", F.col(f"ind{k}_auto")).withColumn(f"ind{k}_overridden", F.lit(False))
    columns = ["municipality_id", *[f"ind{k}_{c}" for k in range(1, 6) for c in ("auto", "final", "overridden")]]
    merged = fresh.select(*columns) if stored is None else merges.upsert_scores(stored.select(*columns), fresh.select(*columns))
    names = municipality.select(F.col("id").alias("municipality_id"), "name_sq", "name_key")
    return windows.score_table(scoring.effective_scores(merged).join(names, "municipality_id"))


def source_health(municipality: DataFrame, registry: DataFrame, attempts: DataFrame | None = None) -> DataFrame:
    """Health of all sources, after the attempts if there are any."""
    if attempts is not None:
        state = merges.apply_attempts(registry, attempts)
        rest = [c for c in registry.columns if c not in state.columns]
        registry = state.join(registry.select("source_id", *rest), "source_id")
    return aggs.source_health(municipality, registry)


def audit_procurement(municipality: DataFrame, items: DataFrame, records: DataFrame, served: DataFrame, year: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The audit by municipality, and how its totals agree with those that are served (municipality_id, total)."""
    audit = aggs.procurement_audit(municipality, items, records, year)
    return audit, joins.reconcile(audit.select("municipality_id", "total"), served)


def rank_url_candidates(links: DataFrame, common: DataFrame, pages: DataFrame, score, pattern: str, points: int, most: int = 3) -> DataFrame:
    """The best candidates of each page: links (page_id, pos, text, href, url) and common paths, scored by `score`
    (decision_score, generic_score, ...), pooled, confirmed on the candidates' pages (url, http_status, html), best first."""
    scored = score(links.withColumn("method", F.lit("homepage_link")))
    paths = score(common.withColumn("method", F.lit("common_path")))
    pool = windows.candidate_pool(scored.select("page_id", "url", "score", "pos"), paths.select("page_id", "url", "score", "pos"))
    hit: Column = F.coalesce(F.col("http_status") == 200, F.lit(False)) & S.fold_text(F.col("html")).rlike(pattern)
    met = pool.join(pages.groupBy("url").agg(F.max(hit).alias("valid")), "url", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    total = met.withColumn("score", F.col("score") + F.when(F.col("valid"), points).otherwise(0))
    ranked = windows.top_k(total.withColumn("confidence", S.confidence_from_score(F.col("score"))), ["page_id"], [F.desc("valid"), F.desc("score"), "pos"], most)
    return ranked.select("page_id", "url", "score", "valid", "confidence")
