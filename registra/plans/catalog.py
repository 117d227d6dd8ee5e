"""The registered queries of the civic-records operators, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registra.functions import scalars as S
from registra.operators import aggs, joins, predicates, windows
from registra.plans import extra, incremental, more, pages, whole
from registra.plans.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


# Spend


SPEND = """spend as (select i.municipality_id, i.published_date, amount_value, case when trim(cpv_code) = '' or cpv_code is null then 'UNKNOWN' else trim(cpv_code) end as code
    from v_rec r join v_item i on i.id = r.item_id where coalesce(nullif(trim(upper(amount_currency)), ''), 'ALL') = 'ALL' and amount_value is not null)"""
BUCKETS = f"""with {SPEND}, ranked as (select code, sum(amount_value) as amount, count(*) as n, row_number() over (order by sum(amount_value) desc, code) as rn from spend group by code),
    buckets as (select bucket, position, cast(sum(amount) as decimal(18,2)) as amount, cast(sum(n) as bigint) as contracts from (
    select case when rn <= 10 then code else 'other' end as bucket, case when rn <= 10 then cast(rn as int) else 11 end as position, amount, n from ranked union all select 'other', 11, 0, 0) x group by 1, 2)"""


def _spend(spark, d):
    return aggs.spend_rows(view(spark, d, "v_rec"), view(spark, d, "v_item"))


@query(f"{BUCKETS} select * from buckets")
def spend_top_codes(spark, d):
    return aggs.spend_top_codes(_spend(spark, d))


@query(f"with {SPEND} select cast(coalesce(max(year(published_date)), 2026) as int) as year from spend")
def spend_default_year(spark, d):
    return aggs.default_year(_spend(spark, d))


@query(f"{BUCKETS} select *, round(cast(amount as double) / cast(sum(amount) over () as double), 6) as share from buckets where amount > 0")
def spend_shares(spark, d):
    return aggs.spend_shares(aggs.spend_top_codes(_spend(spark, d)))


# Feed

FEED = ["id", "municipality_id", "name_key", "category", "title", "published_date", "source_url"]
FEED_SQL = "select i.id, i.municipality_id, name_key, category, title, published_date, source_url from v_item i join v_m m on m.id = i.municipality_id where status = 'published'"


def _keys(spark, *keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def _ids(spark, d, *keys):
    found = joins.resolve_keys(_keys(spark, *keys), view(spark, d, "v_m"), view(spark, d, "v_alias"))
    return found.where("municipality_id is not null").select("municipality_id")


@query(f"{FEED_SQL} order by coalesce(cast(published_date as timestamp), collected_at) desc, collected_at desc, i.id desc limit 20 offset 20")
def public_feed_page(spark, d):
    feed = joins.with_municipality(predicates.feed_filter(view(spark, d, "v_item")), view(spark, d, "v_m"))
    return windows.feed_page(feed, 2, 20).select(*FEED)


@query("select count(*) as total from v_item where status = 'published' and municipality_id = 3 and category = 'Vendime'")
def feed_total(spark, d):
    return predicates.feed_filter(view(spark, d, "v_item"), _ids(spark, d, "n3"), "Vendime").agg(F.count("*").alias("total"))


@query(f"{FEED_SQL} and (title ilike '%nr 12%' or summary ilike '%nr 12%')")
def feed_text_filter(spark, d):
    return joins.with_municipality(predicates.feed_filter(view(spark, d, "v_item"), text="nr 12"), view(spark, d, "v_m")).select(*FEED)


@query(f"{FEED_SQL} and year(published_date) = 1997 and i.municipality_id = 4")
def feed_year_strict(spark, d):
    return joins.with_municipality(predicates.feed_filter(view(spark, d, "v_item"), _ids(spark, d, "nation-4"), year=1997), view(spark, d, "v_m")).select(*FEED)


@query(f"{FEED_SQL} and false")
def feed_unknown_key(spark, d):
    return joins.with_municipality(predicates.feed_filter(view(spark, d, "v_item"), _ids(spark, d, "nowhere")), view(spark, d, "v_m")).select(*FEED)


@query("""select i.id, cast(count(a.id) as bigint) as n_attachments, coalesce(string_agg(cast(a.id as varchar), ',' order by a.created_at, a.id), '') as attachment_ids,
    arg_min(a.id, (a.created_at, a.id)) as primary_attachment from v_item i left join v_att a on a.item_id = i.id where status = 'published' group by i.id""")
def feed_attachments(spark, d):
    met = joins.with_attachments(predicates.published(view(spark, d, "v_item")), view(spark, d, "v_att"))
    return met.select("id", "n_attachments", F.array_join(F.transform("attachments", lambda a: a["id"].cast("string")), ",").alias("attachment_ids"), "primary_attachment")


@query("""select i.id, title, name_sq, string_agg(a.file_name || ':' || cast(size_bytes as varchar), ',' order by a.created_at, a.id) as files from v_item i join v_m m on m.id = i.municipality_id
    left join v_att a on a.item_id = i.id where status = 'published' and i.id = (select min(id) from v_item where status = 'published') group by 1, 2, 3""")
def item_detail(spark, d):
    items = predicates.published(view(spark, d, "v_item"))
    first = items.join(items.agg(F.min("id").alias("id")), "id", "left_semi")
    met = joins.with_attachments(joins.with_municipality(first, view(spark, d, "v_m")), view(spark, d, "v_att"))
    return met.select("id", "title", "name_sq", F.array_join(F.transform("attachments", lambda a: F.concat(a["file_name"], F.lit(":"), a["size_bytes"].cast("string"))), ",").alias("files"))


@query("select a.id, item_id from v_att a where item_id in (select id from v_item where status = 'published')")
def visible_attachments(spark, d):
    return joins.visible_attachments(view(spark, d, "v_att"), view(spark, d, "v_item")).select("id", "item_id")


@query("select category, grouping(category) = 1 as is_total, count(*) as n from (select status, case when id % 8 = 0 then null else category end as category from v_item) x where status = 'published' group by rollup (category)")
def category_totals(spark, d):
    """Every eighth item has no category."""
    return aggs.category_totals(view(spark, d, "v_item").withColumn("category", F.when(F.col("id") % 8 != 0, F.col("category"))))


@query("""with keys as (select distinct lower(replace(n_name, '_', '-')) as key from nation union select 'n' || cast(n_nationkey as varchar) from nation union select 'x' || cast(n_nationkey as varchar) from nation)
    select key, coalesce(m.id, a.municipality_id) as municipality_id, case when m.id is not null then 'name_key' when a.municipality_id is not null then 'alias' end as matched_by
    from keys left join v_m m on m.name_key = key left join v_alias a on a.alias_key = key""")
def key_resolution(spark, d):
    m, alias = view(spark, d, "v_m"), view(spark, d, "v_alias")
    keys = m.select(F.col("name_key").alias("key")).union(alias.select("alias_key")).union(m.select(F.concat(F.lit("x"), F.col("id").cast("string"))))
    return joins.resolve_keys(keys, m, alias)


# Coverage and health

PRIMARY = "primary_row as (select * from (select *, row_number() over (partition by municipality_id order by updated_at desc, id desc) as rn from v_reg where is_primary) x where rn = 1)"


@query(f"""with {PRIMARY}, cats as (select unnest(['Vendime', 'Prokurime', 'Konsultime publike']) as category),
    it as (select municipality_id, category, count(*) filter (status = 'published') as published, count(*) filter (status = 'draft') as drafts, max(published_date) filter (status = 'published') as latest_published,
    max(collected_at) as latest_collected from v_item group by 1, 2),
    att as (select municipality_id, category, count(*) filter (status = 'published') as pa, count(*) filter (status = 'draft') as da from v_att a join v_item i on i.id = a.item_id group by 1, 2),
    la as (select municipality_id, category, a.id as latest_attachment, case when status <> 'archived' then status end as st, row_number() over (partition by municipality_id, category order by created_at desc, a.id desc) as rn
    from v_att a join v_item i on i.id = a.item_id)
    select m.id as municipality_id, name_key, c.category, coalesce(published, 0) as published, coalesce(drafts, 0) as drafts, coalesce(pa, 0) as published_attachments, coalesce(da, 0) as draft_attachments, latest_published,
    cast(latest_collected as date) as latest_collected, latest_attachment, la.st as latest_attachment_status,
    c.category = 'Prokurime' or coalesce(trim(case c.category when 'Vendime' then vendime_url else konsultime_url end), '') <> '' as source_set, homepage_status, last_error_type
    from v_m m cross join cats c left join it on it.municipality_id = m.id and it.category = c.category left join att on att.municipality_id = m.id and att.category = c.category
    left join la on la.municipality_id = m.id and la.category = c.category and la.rn = 1 left join primary_row p on p.municipality_id = m.id""")
def coverage_matrix(spark, d):
    found = aggs.coverage(view(spark, d, "v_m"), view(spark, d, "v_reg"), view(spark, d, "v_item"), view(spark, d, "v_att"))
    return found.withColumn("latest_collected", F.col("latest_collected").cast("date"))


@query("""select municipality_id, category, attachment_id, case when status <> 'archived' then status end as status from (select municipality_id, category, a.id as attachment_id, status,
    row_number() over (partition by municipality_id, category order by created_at desc, a.id desc) as rn from v_att a join v_item i on i.id = a.item_id) x where rn = 1""")
def latest_attachment_per_cell(spark, d):
    return aggs.latest_attachment_per_cell(view(spark, d, "v_item"), view(spark, d, "v_att"))


@query(f"""with {PRIMARY}, st as (select name_key, case when upper(homepage_status) = 'BLOCKED' or upper(last_error_type) = 'HTTP_403' then 'BLOCKED' when upper(homepage_status) = 'ERROR' or upper(last_error_type) = 'TIMEOUT' then 'ERROR'
    when upper(homepage_status) = 'DOWN' or upper(last_error_type) in ('UPSTREAM_DOWN', 'TLS_CERT_EXPIRED', 'TLS_SELF_SIGNED', 'TLS_UNVERIFIED_CHAIN') then 'DOWN' when coalesce(trim(vendime_url), '') = '' then 'UNKNOWN' else 'OK' end as status
    from v_m m left join primary_row p on p.municipality_id = m.id) select status, count(*) as sources, string_agg(name_key, ',' order by name_key) as name_keys from st group by 1""")
def source_health(spark, d):
    return aggs.source_health(view(spark, d, "v_m"), view(spark, d, "v_reg"))


@query("""select count(*) as total, count(*) filter (is_primary) as primaries, count(*) filter (coalesce(trim(vendime_url), '') = '') as vendime_missing, count(*) filter (coalesce(trim(prokurime_url), '') = '') as prokurime_missing,
    count(*) filter (coalesce(trim(konsultime_url), '') = '') as konsultime_missing from v_reg""")
def registry_sanity(spark, d):
    return aggs.registry_sanity(view(spark, d, "v_reg"))


@query("select m.id as municipality_id, count(r.id) as primaries from v_m m left join v_reg r on r.municipality_id = m.id and r.is_primary group by 1 having count(r.id) <> 1")
def not_one_primary(spark, d):
    return aggs.not_one_primary(view(spark, d, "v_m"), view(spark, d, "v_reg"))


@query("select id from v_reg where vendime_url is null or trim(vendime_url) = ''")
def missing_urls(spark, d):
    return view(spark, d, "v_reg").where(predicates.missing_url(F.col("vendime_url"))).select("id")


@query("""select id, case when coalesce(trim(vendime_url), '') = '' then 'missing_url' when cooldown_until > timestamp '2024-01-01 12:00:00' and upper(last_error_type) = 'HTTP_403' then 'cooldown_403'
    when cooldown_until > timestamp '2024-01-01 12:00:00' then 'cooldown' when upper(last_error_type) in ('HTTP_401', 'HTTP_403', 'HTTP_451') then 'hard_block' end as skip_reason from v_reg""")
def runnable_sources(spark, d):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    return view(spark, d, "v_reg").select("id", predicates.skip_reason(F.col("vendime_url"), F.col("last_error_type"), F.col("cooldown_until"), now).alias("skip_reason"))


@query("select count(*) as primaries, count(*) filter (vendime_checked) as vendime_checked, count(*) filter (prokurime_checked) as prokurime_checked, count(*) filter (konsultime_checked) as konsultime_checked from v_reg where is_primary")
def checked_baseline(spark, d):
    return aggs.checked_baseline(view(spark, d, "v_reg"))


# Authorities

TERMS = """texts as (select id as municipality_id, name_key, name_sq as t from v_m union all select id, name_key, name_key from v_m union all select m.id, name_key, alias_key from v_m m join v_alias a on a.municipality_id = m.id),
    base as (select distinct municipality_id, name_key, trim(regexp_replace(upper(t), '[^A-Z0-9]+', ' ', 'g')) as t from texts),
    terms as (select distinct municipality_id, name_key, t || s as term from base cross join (select unnest(['', 'S', 'SE', 'IT', 'UT']) as s) x where s = '' or length(split_part(t, ' ', -1)) >= 4)"""
MATCH = f"""{TERMS}, norm as (select id, authority, trim(regexp_replace(upper(strip_accents(authority)), '[^A-Z0-9]+', ' ', 'g')) as text from v_auth),
    tails as (select *, regexp_replace(trim(regexp_extract(text, '\\bBASHKIA\\b(.*)$', 1)), '^E\\s+', '') as b, trim(regexp_extract(text, '\\bMUNICIPALITY\\s+OF\\b(.*)$', 1)) as u,
    regexp_matches(text, '\\bBASHKIA\\b|\\bMUNICIPALITY\\s+OF\\b') as marker, case when text like 'NDERMARRJA E PASTRIMIT%' then 'NDERMARRJA E PASTRIMIT' end as prefix from norm),
    hits as (select n.id, t.municipality_id, term, case when position(' ' || term || ' ' in ' ' || b || ' ') > 0 then 0 else 1 end as way,
    row_number() over (partition by n.id order by name_key, length(term) desc, term, case when position(' ' || term || ' ' in ' ' || b || ' ') > 0 then 0 else 1 end) as rn
    from tails n join terms t on (b <> '' and position(' ' || term || ' ' in ' ' || b || ' ') > 0) or (u <> '' and position(' ' || term || ' ' in ' ' || u || ' ') > 0) where marker),
    ends as (select n.id, count(distinct t.municipality_id) as n, min(t.municipality_id) as one, arg_max(term, (length(term), term)) as term from tails n join terms t on ends_with(' ' || text, ' ' || term) where prefix is not null group by 1),
    matched as (select n.id, n.authority, coalesce(h.municipality_id, case when e.n = 1 then e.one end) as municipality_id, case when h.id is not null then 'primary' when e.n = 1 then 'operator_suffix' end as match_mode,
    case when h.id is null and e.n = 1 then prefix end as matched_prefix, case when text = '' then 'missing_authority' when h.id is not null then case when way = 0 then 'matched_bashkia' else 'matched_municipality_of' end
    when e.n = 1 then 'matched_operator_suffix' when e.n > 1 then 'ambiguous_operator_suffix' when prefix is not null then 'operator_suffix_not_unique' when marker then 'unclear_authority_name' else 'missing_municipality_marker' end as reason,
    case when h.id is not null then h.term when e.n = 1 then e.term end as matched_term from tails n left join hits h on h.id = n.id and rn = 1 left join ends e on e.id = n.id)"""


def _terms(spark, d):
    return joins.authority_terms(view(spark, d, "v_m"), view(spark, d, "v_alias"))


@query(f"with {TERMS} select * from terms")
def authority_terms(spark, d):
    return _terms(spark, d)


@query(f"with {MATCH} select * from matched")
def authority_match(spark, d):
    return joins.match_authorities(view(spark, d, "v_auth"), _terms(spark, d))


@query(f"with {MATCH} select match_mode, reason, count(*) as n from matched group by 1, 2")
def authority_match_counts(spark, d):
    return aggs.reason_histogram(authority_match(spark, d), "match_mode", "reason")


@query("select coalesce(nullif(trim(authority), ''), '(missing)') as authority, count(*) as n from v_auth group by 1 order by 2 desc, 1 limit 50")
def authority_top(spark, d):
    return aggs.authority_frequency(view(spark, d, "v_auth"))


@query(f"with {MATCH} select t.municipality_id, count(distinct n.id) as mentions from tails n join matched m on m.id = n.id and m.municipality_id is null join terms t on position(' ' || term || ' ' in ' ' || text || ' ') > 0 group by 1")
def mention_gap(spark, d):
    return joins.mention_gap(authority_match(spark, d).where("municipality_id is null"), _terms(spark, d))


ROWS = """rows as (select item_id as row_index, procedure_ref as pid, i.published_date, case when item_id % 3 = 0 then 'same title' else title end as title from v_rec r join v_item i on i.id = r.item_id),
    own as (select id, case when id % 5 = 0 then 'ref ' || cast(id as varchar) end as pid, published_date, case when id % 3 = 0 then 'Same Title' else title end as title from v_item)"""


@query(f"""with {ROWS}, r as (select row_index, nullif(upper(pid), '') as pid, published_date, lower(title) as t from rows), o as (select id, upper(replace(pid, ' ', '-')) as pid, published_date, lower(title) as t from own),
    bi as (select pid, min(row_index) as row_index, count(*) as n from r where pid is not null group by 1), bt as (select published_date, t, min(row_index) as row_index, count(*) as n from r where published_date is not null group by 1, 2)
    select id, case when bi.row_index is not null then bi.row_index when bt.n = 1 then bt.row_index end as row_index, case when bi.row_index is not null then 'matched_procedure_id'
    when o.published_date is null then case when o.pid is not null then 'procedure_not_found' else 'missing_fallback_identifiers' end when bt.n = 1 then 'matched_title_date_fallback' when bt.n > 1 then 'ambiguous_title_date_fallback'
    else 'no_export_row_match' end as reason, coalesce(bi.n, case when o.published_date is not null then coalesce(bt.n, 0) end, 0) as candidates from o left join bi on bi.pid = o.pid left join bt on bt.published_date = o.published_date and bt.t = o.t""")
def export_row_match(spark, d):
    items = view(spark, d, "v_item")
    titled = lambda c, name: F.when(F.col(c) % 3 == 0, name).otherwise(F.col("title"))
    rows = view(spark, d, "v_rec").join(items.select(F.col("id").alias("item_id"), "published_date", "title"), "item_id")
    rows = rows.select(F.col("item_id").alias("row_index"), F.col("procedure_ref").alias("procedure_id"), "published_date", titled("item_id", "same title").alias("title"))
    own = items.select("id", F.when(F.col("id") % 5 == 0, F.concat(F.lit("ref "), F.col("id").cast("string"))).alias("procedure_id"), "published_date", titled("id", "Same Title").alias("title"))
    return joins.match_export_rows(own, rows)


# Parsing


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, cast(l_extendedprice as decimal(18,2)) as eu, cast(l_extendedprice as decimal(18,2)) as us, cast(floor(l_extendedprice) as decimal(18,2)) as plain,
    cast(null as decimal(18,2)) as bad from lineitem""")
def amount_parse(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    us = F.format_number("l_extendedprice", 2)
    eu = F.translate(us, ",.", ".,")
    whole = F.format_number(F.floor("l_extendedprice"), 0)
    return rows.select("*", S.parse_amount(F.concat(eu, F.lit(" Lekë"))).alias("eu"), S.parse_amount(F.concat(F.lit("EUR "), us)).alias("us"), S.parse_amount(F.concat(whole, F.lit(" ALL"))).alias("plain"), S.parse_amount(F.lit("n/a")).alias("bad"))


@query("""select item_id, case when upper(trim(amount_currency)) = 'ALL' then 'ALL' when upper(trim(amount_currency)) = 'EUR' then 'EUR' else 'ALL' end as detected, case when item_id % 2 = 0 then 'USD' else 'EUR' end as from_amount,
    cast(null as varchar) as unknown, coalesce(nullif(trim(upper(amount_currency)), ''), 'ALL') as effective from v_rec""")
def currency_detect(spark, d):
    c = F.col("amount_currency")
    amount = F.concat(F.when(F.col("item_id") % 2 == 0, "$ ").otherwise("€ "), F.col("amount_value").cast("string"))
    return view(spark, d, "v_rec").select("item_id", S.detect_currency(F.col("amount_value").cast("string"), c).alias("detected"), S.detect_currency(amount, F.lit(None).cast("string")).alias("from_amount"), S.detect_currency(F.lit("12"), F.lit("CHF")).alias("unknown"), S.effective_currency(c).alias("effective"))


@query("""select id, published_date as iso, published_date as dotted, published_date as slashed, published_date as free, published_date as named, cast(null as date) as impossible from v_item""")
def date_parse_variants(spark, d):
    c, none = F.col("published_date"), F.lit(None).cast("string")
    f = lambda p: F.date_format(c, p)
    return view(spark, d, "v_item").select(
        "id", S.strict_iso_date(f("yyyy-MM-dd")).alias("iso"), S.numeric_date(F.concat(F.lit("dated "), f("d.M.yyyy"), F.lit("."))).alias("dotted"), S.export_date(f("dd/MM/yyyy")).alias("slashed"),
        S.strict_iso_date(S.free_text_date(F.concat(F.lit("on "), f("dd-MM-yyyy")))).alias("free"), S.month_name_date(F.concat(F.lit("Posted "), f("MMM d, yyyy"))).alias("named"),
        S.strict_iso_date(S.free_text_date(F.when(c.isNull(), none).otherwise(F.lit("31.02.2020")))).alias("impossible"),
    )


FOLD_SQL = "trim(regexp_replace(strip_accents(lower(coalesce({0}, ''))), '[^a-z0-9]+', ' ', 'g'))"


@query(f"select id, {FOLD_SQL.format('text')} as folded_text from v_doc")
def title_fold(spark, d):
    return view(spark, d, "v_doc").select("id", S.normalize_title(F.col("text")).alias("folded_text"))


@query("select id, regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug, regexp_replace(translate(lower(text), 'ëç', 'ec'), '[^a-z0-9]', '', 'g') as legacy from v_doc")
def slugs(spark, d):
    return view(spark, d, "v_doc").select("id", S.slugify(F.col("text")).alias("slug"), S.legacy_key(F.col("text")).alias("legacy"))


T1 = FOLD_SQL.format("title")


@query(f"""select id, cast(municipality_id as varchar) || '|' || coalesce(cast(published_date as varchar), 'unknown') || '|' || cast(id % 40 as varchar) || '|' || substr(sha1({T1}), 1, 12) as decision,
    cast(municipality_id as varchar) || '|' || category || '|' || coalesce(cast(published_date as varchar), 'unknown') || '|' || substr(sha1({T1}), 1, 12) || '|' || substr(sha1(coalesce(source_url, '')), 1, 12) as document,
    case when id % 2 = 0 then cast(municipality_id as varchar) || '|proc|REF-' || cast(id as varchar) else cast(municipality_id as varchar) || '|' || coalesce(cast(published_date as varchar), 'unknown') || '|' || substr(sha1({T1}), 1, 12) end as procurement
    from v_item""")
def dedup_keys(spark, d):
    t, m, p = S.normalize_title(F.col("title")), F.col("municipality_id"), F.col("published_date")
    ref = F.when(F.col("id") % 2 == 0, F.concat(F.lit(" ref/"), F.col("id").cast("string")))
    return view(spark, d, "v_item").select("id", S.decision_key(m, p, (F.col("id") % 40).cast("string"), t).alias("decision"), S.document_key(m, F.col("category"), p, t, F.col("source_url")).alias("document"), S.procurement_key(m, ref, p, t).alias("procurement"))


@query("select id, source, lang from (select *, row_number() over (partition by text order by id) as rn from v_doc) x where rn = 1")
def dedup_first(spark, d):
    """Documents of one whole text, known by its digest."""
    return windows.keep_first(view(spark, d, "v_doc").withColumn("digest", F.sha2("text", 256)), ["digest"], ["id"]).select("id", "source", "lang")


QUERIES |= more.QUERIES | extra.QUERIES | pages.QUERIES | incremental.QUERIES | whole.QUERIES
ORACLE |= more.ORACLE | extra.ORACLE | pages.ORACLE | incremental.ORACLE | whole.ORACLE


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, sql in ORACLE.items()}

