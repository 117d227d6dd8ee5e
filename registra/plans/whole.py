"""Registered queries of whole pipelines, row by row, and of rules that no other query reaches."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registra import pipelines
from registra.operators import aggs, extract, joins, predicates, scoring, windows
from registra.plans import extra, more
from registra.plans.views import view
from registra.sources import exports
from registra.sources.shared import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return register


# Scores with their arguments

PRIMARY = "primary_row as (select * from (select *, row_number() over (partition by municipality_id order by updated_at desc, id desc) as rn from v_reg where is_primary) x where rn = 1)"
PICKS = f"""{PRIMARY}, ev as (select i.municipality_id, published_date, title, a.source_url as u, a.id as aid, case when file_name like 'kalendari%' then 'annual' when file_name like 'projekt%' then 'draft' else 'response' end as kind
    from v_item i join v_att a on a.item_id = i.id where status = 'published' and category = 'Konsultime publike'),
    pick as (select municipality_id, kind, split_part(u, '/', 4) || ' (' || u || ')' as name from (select *, row_number() over (partition by municipality_id, kind order by case when kind = 'annual' and year(published_date) = 2026 then 1 else 0 end desc,
    published_date desc nulls last, title, u nulls last, aid) as rn from ev) x where rn = 1),
    n as (select municipality_id, count(distinct i.id) as items, count(distinct a.item_id) as with_files, count(a.id) as files from v_item i left join v_att a on a.item_id = i.id where status = 'published' and category = 'Konsultime publike' group by 1),
    s as (select m.id as municipality_id, m.id % 11 = 5 as lost, pa.name as annual, pd.name as draft, pr.name as response, nullif(trim(p.konsultime_url), '') as url, coalesce(items, 0) as items, coalesce(files, 0) as files, coalesce(with_files, 0) as with_files
    from v_m m left join pick pa on pa.municipality_id = m.id and pa.kind = 'annual' left join pick pd on pd.municipality_id = m.id and pd.kind = 'draft' left join pick pr on pr.municipality_id = m.id and pr.kind = 'response'
    left join primary_row p on p.municipality_id = m.id left join n on n.municipality_id = m.id)"""
REVIEW = "'Pending review - could not auto-compute consultation score from available public evidence.'"


def _argument(k: int, *cases: str) -> str:
    return f"case when lost then {REVIEW} {' '.join(cases)} end as ind{k}_argument"


@query(f"""with {PICKS} select municipality_id, case when lost or annual is null then 0 else 10 end as ind1_auto, case when lost or url is null then 0 else 10 end as ind2_auto, case when lost then 0 when draft is not null then 10 when items > 0 then 5 else 0 end as ind3_auto,
    0 as ind4_auto, case when lost or response is null then 0 else 10 end as ind5_auto, case when lost or annual is null then 'low' else 'medium' end as ind1_confidence, case when lost or url is null then 'low' else 'medium' end as ind2_confidence,
    case when lost or draft is null then 'low' else 'medium' end as ind3_confidence, 'low' as ind4_confidence, case when lost or response is null then 'low' else 'medium' end as ind5_confidence,
    {_argument(1, "when annual is null then 'No annual consultation calendar document detected in archived consultation attachments. Per-item consultation calendars are not counted as annual plans - pending review.'",
               "else 'Ind1=10 - consultation calendar/annual plan evidence identified: ' || annual || '. Full-year coverage and quality remain pending review.'")},
    {_argument(2, "when url is null then 'No consultation register source configured - pending review.'",
               "else 'A consultation register was found (' || url || '). Not assessed for dedicated / mobile-friendly / intuitive access (20 pts) - pending review.'")},
    {_argument(3, "when draft is not null then 'Ind3=10 - draft/project-act evidence identified: ' || draft || '. Plain-language explanatory material and completeness remain pending review.'",
               "when files > 0 then items || ' consultation items published with ' || files || ' archived documents across ' || with_files || ' items, but no clear draft/project-act or relacion document was identified by conservative patterns - pending review.'",
               "when items > 0 then items || ' consultation items found but no documents archived - pending review.' else 'No consultation drafts/documents found - pending review.'")},
    {_argument(4, "else 'Consultation-to-vote timeframe could not be automatically verified (no reliable link between consultations and council decisions). Pending review.'")},
    {_argument(5, "when response is null then 'No explicit post-consultation response or summary-report document detected in archived consultation attachments. Generic council reports and processverbals are not counted - pending review.'",
               "else 'Ind5=10 - consultation response/summary-report evidence identified: ' || response || '. Whether it addresses public input remains pending review.'")} from s""")  # fmt: skip
def score_arguments(spark, d):
    """Scores with confidence and argument; the inputs of every eleventh municipality could not be read."""
    m = view(spark, d, "v_m")
    failed = m.where("id % 11 = 5").select(F.col("id").alias("municipality_id"))
    found = scoring.indicator_scores(m, view(spark, d, "v_reg"), view(spark, d, "v_item"), view(spark, d, "v_att"), failed)
    return found.select("municipality_id", *[f"ind{k}_{c}" for c in ("auto", "confidence", "argument") for k in range(1, 6)])


@query(f"""with {more.SCORES}, t as (select municipality_id, ind1_auto + ind2_auto + ind3_auto + ind5_auto + case when municipality_id % 3 = 0 then 10 else 0 end as total, municipality_id % 3 = 0 as reviewed from scores)
    select t.municipality_id, name_key, total, case when total >= 90 then 'Excellent' when total >= 75 then 'Good' when total >= 60 then 'Moderate' when total >= 40 then 'Weak' else 'Critical' end as tier, reviewed from t join v_m m on m.id = t.municipality_id""")
def scores_pipeline(spark, d):
    """The score table over stored scores, of which a reviewer has raised every third's fourth indicator."""
    m, registry, items, attachments = (view(spark, d, v) for v in ("v_m", "v_reg", "v_item", "v_att"))
    stored = more._stored(scoring.indicator_scores(m, registry, items, attachments))
    found = pipelines.consultation_scores(m, registry, items, attachments, stored)
    return found.select("municipality_id", "name_key", "total", "tier", F.col("ind4_overridden").alias("reviewed"))


@query(f"""with {more.AUDIT.replace("where item_id % 6 <> 0", "")}, served as (select municipality_id, case when municipality_id % 5 = 0 then total + 1 else total end as total from audit where municipality_id % 7 <> 0)
    select a.*, s.total as served, case when s.total is null then 'missing_served' when abs(a.total - s.total) <= 0.01 then 'match' else 'total_mismatch' end as reason from audit a left join served s on s.municipality_id = a.municipality_id""")
def audit_pipeline(spark, d):
    """The audit of all years beside served totals, of which some are missing and some differ."""
    m, items, records = (view(spark, d, v) for v in ("v_m", "v_item", "v_rec"))
    stored = aggs.procurement_audit(m, items, records).select("municipality_id", "total")
    served = stored.where("municipality_id % 7 <> 0").withColumn("total", F.when(F.col("municipality_id") % 5 == 0, F.col("total") + 1).otherwise(F.col("total")).cast("decimal(19,2)"))
    audit, agreement = pipelines.audit_procurement(m, items, records, served)
    return audit.join(agreement.select("municipality_id", "served", "reason"), "municipality_id")


# Pipelines, all rows


@query("""with f as (select i.id, row_number() over (order by coalesce(cast(published_date as timestamp), collected_at) desc, collected_at desc, i.id desc) as rn, count(*) over () as total, name_key, title, published_date from v_item i join v_m m on m.id = i.municipality_id
    where status = 'published' and name_key = 'nation-2' and category = 'Vendime' and (title ilike '%nr 1%' or summary ilike '%nr 1%'))
    select f.id, name_key, title, published_date, total, cast(count(a.id) as bigint) as n_attachments, coalesce(string_agg(a.file_name, ',' order by a.created_at, a.id), '') as files from f left join v_att a on a.item_id = f.id where rn between 4 and 6 group by 1, 2, 3, 4, 5""")
def feed_pipeline_rows(spark, d):
    """The second page of a municipality's feed with category and text filter, its attachments and the total."""
    page, total = pipelines.build_feed(*(view(spark, d, v) for v in ("v_item", "v_m", "v_alias", "v_att")), key="n2", category="Vendime", text="nr 1", page=2, limit=3)
    files = F.array_join(F.transform("attachments", lambda a: a["file_name"]), ",").alias("files")
    return page.join(total).select("id", "name_key", "title", "published_date", "total", "n_attachments", files)  # one row of the total


@query(f"""with {more.ATTEMPTS}, r as (select v_reg.*, case when s.ok then null when s.ok is not null then err else last_error_type end as e, coalesce(st, homepage_status) as h from v_reg left join s on s.source_id = v_reg.source_id),
    p as (select * from (select *, row_number() over (partition by municipality_id order by updated_at desc, id desc) as rn from r where is_primary) x where rn = 1),
    k as (select name_key, case when upper(h) = 'BLOCKED' or upper(e) = 'HTTP_403' then 'BLOCKED' when upper(h) = 'ERROR' or upper(e) = 'TIMEOUT' then 'ERROR' when upper(h) = 'DOWN' or upper(e) in ('UPSTREAM_DOWN', 'TLS_CERT_EXPIRED', 'TLS_SELF_SIGNED', 'TLS_UNVERIFIED_CHAIN') then 'DOWN'
    when coalesce(trim(vendime_url), '') = '' then 'UNKNOWN' else 'OK' end as status from v_m m left join p on p.municipality_id = m.id) select status, count(*) as sources, string_agg(name_key, ',' order by name_key) as name_keys from k group by 1""")
def health_pipeline_rows(spark, d):
    """Health after all attempts, with the municipalities of each status."""
    registry = more._states(spark, d).join(view(spark, d, "v_reg").select("source_id", "id", "municipality_id", "is_primary", "vendime_url", "updated_at"), "source_id")
    return pipelines.source_health(view(spark, d, "v_m"), registry, view(spark, d, "v_attempt"))


@query(f"""with {more.HALVES} select coalesce(t.id, n.id) as id, coalesce(n.title, t.title) as title, coalesce(t.published_date, n.published_date) as published_date, coalesce(t.status, n.status) as status, coalesce(t.published_date, n.published_date) is null as date_unknown,
    case when n.id is null then 'kept' when t.id is null then 'inserted' when n.title <> t.title or (t.published_date is null and n.published_date is not null) then 'updated' else 'skipped' end as action from target t full join incoming n on t.id = n.id""")
def documents_pipeline_rows(spark, d):
    target, incoming = more._halves(spark, d)
    found = pipelines.ingest_documents(incoming, target)
    return found["items"].join(found["actions"], "id", "left").select("id", "title", "published_date", "status", "date_unknown", F.coalesce("action", F.lit("kept")).alias("action"))


# Rules


@query("select cast(precedence as int) as precedence, count(*) filter (precedence > 0) as duplicates from v_item cross join (select unnest([0, 1, 2]) as precedence) p where precedence <> 1 or id % 2 = 0 group by 1")
def union_duplicates(spark, d):
    """Articles are all items, hearings the even ones, registers all again: later rows of a URL are counted for their part."""
    own = view(spark, d, "v_item")
    return extract.counted_items(own, own.where("id % 2 = 0"), own, year=1997)[1]


@query("select id, year(published_date) between 1994 and 1996 as supported from v_item where published_date >= date '1995-01-01'")
def consultation_floor(spark, d):
    """Items from a floor year on, and whether their year is among the supported ones."""
    items = predicates.year_floor(view(spark, d, "v_item"), 1995)
    return items.select("id", predicates.supported_year(F.year("published_date"), (1994, 1996)).alias("supported"))


@query("select id, authority, case when id % 4 = 3 and id % 8 <> 3 then 9 end as municipality_id, case when id % 4 = 3 and id % 8 <> 3 then 'exact_override' end as match_mode from v_auth where id % 4 = 3")
def exact_authorities(spark, d):
    """Authorities without a marker, whose whole names are given a municipality."""
    rows = view(spark, d, "v_auth")
    names = {f"AGJENCIA KOMBETARE NATION {k}": "nation-9" for k in range(25)}
    found = joins.match_authorities(rows, joins.authority_terms(view(spark, d, "v_m"), view(spark, d, "v_alias")), overrides=names)
    return found.where("id % 4 = 3").select("id", "authority", "municipality_id", "match_mode")


# Exports with line breaks


@query("""select 'r' || cast(item_id as varchar) as nr, 'Line of ' || title || chr(10) || 'and "quotes"; B' as title, case when item_id % 3 = 0 then null else supplier_name end as supplier from v_rec r join v_item i on i.id = r.item_id""")
def export_split(spark, d):
    """An export whose titles have line breaks and quotes, read as many tasks."""
    path = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
    rows = view(spark, d, "v_rec").join(view(spark, d, "v_item").select(F.col("id").alias("item_id"), "title"), "item_id")
    supplier = F.when(F.col("item_id") % 3 != 0, F.col("supplier_name"))
    rows = rows.select(F.concat(F.lit("r"), F.col("item_id").cast("string")).alias("Nr"), F.concat(F.lit("Line of "), "title", F.lit('\nand "quotes"; B')).alias("Objekti"), supplier.alias("Operatori"))
    rows.write.option("header", True).option("escape", '"').csv(path)
    found = exports.read_export_split(spark, path)
    return found.select(F.col("Nr").alias("nr"), F.col("Objekti").alias("title"), F.col("Operatori").alias("supplier"))


# Names in their language


NAMES = ["Cërrik", "Çorovodë", "Devoll", "Dibër", "Durrës", "Dhërmi", "Elbasan", "Ëmbël", "Gramsh", "Gjirokastër", "Xarrë", "Xhafzotaj", "Zogaj"]


def _named(spark, d):
    """Municipalities under names in Albanian letters, of which the list above is in order."""
    of = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("id") * 5 % len(NAMES) + 1).cast("int"))
    return view(spark, d, "v_m").withColumn("name_sq", F.concat(of, F.lit(" "), F.lpad(F.col("id").cast("string"), 2, "0")))


@query(f"select row_number() over (order by id * 5 % {len(NAMES)}, id) - 1 as position, id from v_m")
def albanian_order(spark, d):
    """The list of municipalities in Albanian order; one task numbers its rows as they come."""
    found = windows.municipality_list(_named(spark, d), "sq").coalesce(1)
    return found.select(F.monotonically_increasing_id().alias("position"), "id")


@query(f"select strip_accents(upper(name)) as name, id as municipality_id from (select id, {NAMES!r}[cast(id * 5 % {len(NAMES)} + 1 as int)] || ' ' || lpad(cast(id as varchar), 2, '0') as name from v_m) x union all select 'NOWHERE', null")
def names_without_marks(spark, d):
    """Names in capital letters without marks find their municipality."""
    m = _named(spark, d)
    asked = m.select(F.upper(F.translate("name_sq", "ëËçÇ", "eEcC")).alias("name")).union(spark.range(1).select(F.lit("NOWHERE")))
    return joins.resolve_names(asked, m)


@query("""select cast(item_id as varchar) as nr, title || ', "A"; B' as title, strftime(published_date, '%d/%m/%Y') as date, supplier_name as supplier, 9 as columns from v_rec r join v_item i on i.id = r.item_id""")
def raw_rows(spark, d):
    """What the raw row of an export's record holds under its headers; blank values are null."""
    raw = predicates.procurement_records(extra._export(spark, d)).select(F.from_json(F.to_json("raw_row"), "map<string,string>").alias("raw"), F.size("raw_row").alias("columns"))
    value = lambda name: F.col("raw")[name]
    return raw.select(value("Nr").alias("nr"), value("Objekti i Kontratës").alias("title"), value("Data e publikimit").alias("date"), value("Operatori Ekonomik").alias("supplier"), "columns")
