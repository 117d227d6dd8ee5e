"""Filters, reason columns and projections of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registra.functions import scalars as S
from registra.functions import vocab


def resolve_headers(columns: list[str], keywords: list[str]) -> list[str]:
    """The columns whose normalised name contains a keyword, keyword by keyword: the order in which values are tried."""
    found = [c for k in keywords for c in columns if S.normalized(k) in S.normalized(c)]
    return list(dict.fromkeys(found))


def by_headers(df: DataFrame, keywords: list[str]) -> Column:
    """First non-blank value of the columns that the keywords name."""
    names = resolve_headers(df.columns, keywords)
    return F.coalesce(*[S.nonblank(df[f"`{c}`"]) for c in names]) if names else F.lit(None).cast("string")


def url_from_value(value: Column, base: Column) -> Column:
    absolute = S.nonblank(F.regexp_extract(value, r"(https?://[^\s\"'<>]+)", 1))
    return F.coalesce(absolute, F.when(F.startswith(F.trim(value), F.lit("/")), S.absolute_url(base, value)))


def procurement_items(export: DataFrame, export_url: str, row: str = "row_index") -> DataFrame:
    """Rows of an export as items: title, published_date, procedure_id, authority, source_url."""
    return export.select(row, *item_columns(export, export_url, row))


def item_columns(export: DataFrame, export_url: str, row: str = "row_index") -> list[Column]:
    title = F.coalesce(by_headers(export, vocab.TITLE_HEADERS), F.concat(F.lit("Procurement row "), F.col(row) + 1))
    procedure = by_headers(export, vocab.ITEM_PROCEDURE_HEADERS)
    links = [url_from_value(by_headers(export, vocab.DETAIL_HEADERS), F.lit(export_url))]
    links += [S.nonblank(F.regexp_extract(F.col(f"`{c}`"), r"(https?://[^\s\"'<>]+)", 1)) for c in export.columns if c != row]
    fallback = F.when(procedure.isNotNull(), F.concat(F.lit(export_url + "#procedure="), F.url_encode(procedure)))
    return [title.alias("title"), S.export_date(by_headers(export, vocab.DATE_HEADERS)).alias("published_date"), procedure.alias("procedure_id"), by_headers(export, vocab.AUTHORITY_HEADERS).alias("authority"), F.coalesce(*links, fallback, F.lit(export_url)).alias("source_url")]


def procurement_records(export: DataFrame, row: str = "row_index") -> DataFrame:
    """Rows of an export as records: amount, currency, supplier, CPV, procedure, type, authority and the raw row."""
    return export.select(row, *record_columns(export, row).values())


def record_columns(export: DataFrame, row: str = "row_index") -> dict[str, Column]:
    amount, cpv = by_headers(export, vocab.AMOUNT_HEADERS), by_headers(export, vocab.CPV_HEADERS)
    names = [c for c in export.columns if c != row]
    raw = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(f"`{c}`").cast("string") for c in names]))
    found = {
        "amount_value": S.parse_amount(amount), "amount_currency": S.storage_currency(S.detect_currency(amount, by_headers(export, vocab.CURRENCY_HEADERS))),
        "supplier_name": by_headers(export, vocab.SUPPLIER_HEADERS), "cpv_code": cpv, "cpv_group": S.cpv_group(cpv),
        "procedure_ref": by_headers(export, vocab.RECORD_PROCEDURE_HEADERS), "procedure_type": by_headers(export, vocab.PROCEDURE_TYPE_HEADERS),
        "contracting_authority": by_headers(export, vocab.AUTHORITY_HEADERS), "raw_row": raw,
    }
    return {c: x.alias(c) for c, x in found.items()}


def year_gate(df: DataFrame, year: int | None, date: str = "published_date") -> DataFrame:
    """Adds skip_reason: missing_date, wrong_year or null (kept). Without a year all rows are kept."""
    if year is None:
        return df.withColumn("skip_reason", F.lit(None).cast("string"))
    return df.withColumn("skip_reason", F.when(F.col(date).isNull(), "missing_date").when(F.year(date) != year, "wrong_year"))


def year_floor(df: DataFrame, floor: int = vocab.CONSULTATION_FLOOR, date: str = "published_date") -> DataFrame:
    """Rows dated in the floor year or later; rows without a date go."""
    return df.where(F.col(date) >= F.lit(f"{floor}-01-01").cast("date"))


def supported_year(c: Column, years: tuple[int, int] = vocab.YEARS) -> Column:
    return F.coalesce(c.between(*years), F.lit(False))


def looks_like_decision(title: Column, url: Column, rejects: list[str] = vocab.NOT_DECISIONS) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(url, F.lit(""))))
    return ~text.rlike("|".join(rejects)) & (S.is_document_url(url) | F.contains(text, F.lit("vendim")) | text.rlike(r"\bnr[.\- ]?\s*\d{1,4}\b"))


def keyword_keep(title: Column, url: Column, pattern: str = "konsultim|degjes|njoftim") -> Column:
    return S.fold_text(F.concat_ws(" ", title, url)).rlike(pattern)


def no_year_policy(source_url: Column, page_url: Column, municipality_host: Column) -> Column:
    """struct<allowed, page>: own host stays; an external PDF stays if the page that links to it is the municipality's."""
    own = S.compare_host(source_url) == municipality_host
    external = S.compare_host(page_url).eqNullSafe(municipality_host) & F.lower(source_url).rlike(r"\.pdf([?#]|$)")
    return F.struct(F.coalesce(own | external, F.lit(False)).alias("allowed"), F.when(own | external, F.coalesce(page_url, source_url)).alias("page"))


def generic_resource(title: Column, url: Column) -> Column:
    return F.lower(F.coalesce(url, F.lit(""))).rlike(r"harta?[^/]*\.pdf|logo|favicon|\.(png|jpe?g|gif|svg|css|js)([?#]|$)") | S.normalize_title(title).rlike("^bashkia( [a-z]+)?$")


def decision_post(title: Column, url: Column) -> Column:
    return F.lower(url).rlike(r"/vendim[a-z-]*[/-]|/vendime?/") | F.contains(S.normalize_title(title), F.lit("vendim"))


def hints_match(hints: Column, key: Column) -> Column:
    """No hints pass; a hint equals the key or is its prefix up to a hyphen, or the other way round."""
    return (F.size(F.coalesce(hints, F.array().cast("array<string>"))) == 0) | F.exists(hints, lambda h: (h == key) | F.startswith(h, F.concat(key, F.lit("-"))) | F.startswith(key, F.concat(h, F.lit("-"))))


def year_in(year: int, date: Column, *texts: Column) -> Column:
    token = rf"(^|\D){year}(\D|$)"
    out = F.coalesce(F.year(date) == year, F.lit(False))
    for t in texts:
        out = out | F.coalesce(t.rlike(token), F.lit(False))
    return out


def published(items: DataFrame) -> DataFrame:
    return items.where(F.col("status") == "published")


def feed_filter(items: DataFrame, municipality_ids: DataFrame | None = None, category: str | None = None, year: int | None = None, text: str | None = None) -> DataFrame:
    """Published items of a municipality (a table of ids: unknown keys give an empty one), category, year and text."""
    out = published(items)
    if municipality_ids is not None:
        out = out.join(municipality_ids, "municipality_id", "left_semi")
    if category is not None:
        out = out.where(F.col("category") == category)
    if year is not None:
        out = out.where(F.year("published_date") == year)
    if text:
        out = out.where(F.col("title").ilike(f"%{text}%") | F.col("summary").ilike(f"%{text}%"))
    return out


def check_parameters(page: int = 1, limit: int = 20, most: int = 100, year: int | None = None, key: str | None = None, top: int | None = None, sort: str | None = None, q: str | None = None) -> None:
    """ValueError for parameters out of range, before anything is planned."""
    import re

    if page < 1 or not 1 <= limit <= most:
        raise ValueError(f"page is 1 or more, limit 1 to {most}")
    if year is not None and not vocab.YEARS[0] <= year <= vocab.YEARS[1]:
        raise ValueError(f"year is {vocab.YEARS[0]} to {vocab.YEARS[1]}")
    if key is not None and not re.fullmatch("[a-z0-9]+(?:-[a-z0-9]+)*", key):
        raise ValueError("keys are slugs")
    if top is not None and not 1 <= top <= 20:
        raise ValueError("top is 1 to 20")
    if sort is not None and sort not in ("newest", "oldest"):
        raise ValueError("sort is newest or oldest")
    if q is not None and len(q) > 120:
        raise ValueError("q has 120 characters at most")


def missing_url(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def repair_candidates(items: DataFrame, records: DataFrame, year: int) -> DataFrame:
    """Procurement items of a year without a record, or whose record lacks amount or currency; reason tells which."""
    own = items.where((F.col("category") == "Prokurime") & (F.year("published_date") == year))
    met = own.join(records.select(F.col("item_id").alias("id"), "amount_value", "amount_currency", F.lit(True).alias("has")), "id", "left")
    reason = F.when(F.col("has").isNull(), "missing_record").when(F.col("amount_value").isNull(), "missing_amount").when(missing_url(F.col("amount_currency")), "missing_currency")
    return met.withColumn("reason", reason).where("reason is not null")


def skip_reason(url: Column, error_type: Column, cooldown_until: Column, now: Column) -> Column:
    """Why a source isn't run now; null for runnable ones."""
    cool = cooldown_until > now
    return (
        F.when(missing_url(url), "missing_url")
        .when(cool & (F.upper(error_type) == "HTTP_403"), "cooldown_403")
        .when(cool, "cooldown")
        .when(F.upper(error_type).isin("HTTP_401", "HTTP_403", "HTTP_451"), "hard_block")
    )


def official_source(enabled: Column, template: Column, first: Column, last: Column, year: int) -> Column:
    ok = F.coalesce(enabled, F.lit(False)) & ~missing_url(template) & (F.coalesce(first, F.lit(year)) <= year) & (F.coalesce(last, F.lit(year)) >= year)
    return F.when(ok, S.apply_year_template(template, F.lit(year)))


def publish_decision(force: bool, checked: Column) -> Column:
    return F.when(F.lit(force) | F.coalesce(checked, F.lit(False)), "published").otherwise("draft")


def quality_violations(items: DataFrame) -> DataFrame:
    """(id, rule) for each broken rule of published items and each non-unique key."""
    live = F.col("status") == "published"
    rules = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("category").isin(vocab.CATEGORIES), F.lit(False)), "unknown_category"),
            F.when(~F.coalesce(F.col("status").isin(vocab.STATUSES), F.lit(False)), "unknown_status"),
            F.when(live & (F.col("date_unknown") != F.col("published_date").isNull()), "date_flag"),
            F.when(live & missing_url(F.col("source_url")), "missing_source"),
            F.when(live & F.col("collected_at").isNull(), "missing_collected_at"),
        )
    )
    own = items.select("id", F.explode(rules).alias("rule"))

    def repeated(keys: list[str], rows: DataFrame, rule: str) -> DataFrame:
        again = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
        return rows.join(again, keys).select("id", F.lit(rule).alias("rule"))

    urls = repeated(["source_url"], items.where("source_url is not null"), "source_url_not_unique")
    keys = repeated(["municipality_id", "category", "dedup_key"], items.where("source_url is null and dedup_key is not null"), "dedup_key_not_unique")
    return own.unionByName(urls).unionByName(keys)


def first_valid_title(candidates: list[Column], municipality: Column | None = None) -> Column:
    return F.coalesce(*[F.when(~S.invalid_title(c, municipality), c) for c in candidates])


def has_phrase(text: Column, phrases: list[str]) -> Column:
    """Any phrase as whole words in text that normalize_title has made."""
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(padded, F.lit(f" {p} "))
    return out


def annual_calendar(item: Column, document: Column) -> Column:
    return has_phrase(item, vocab.ANNUAL_ITEM) | has_phrase(document, vocab.ANNUAL_DOCUMENT)


def draft_act(document: Column) -> Column:
    return has_phrase(document, vocab.DRAFT_ACT)


def response_document(item: Column, document: Column) -> Column:
    report = document.rlike(r"\braport[a-z0-9]*\b") & document.rlike(r"\bdegjes[a-z0-9]*\b")
    context = has_phrase(document, vocab.CONSULTATION_DOCUMENT) | has_phrase(item, vocab.CONSULTATION_ITEM)
    return ~has_phrase(document, vocab.NOT_RESPONSE) & context & (has_phrase(document, vocab.RESPONSE) | report)
