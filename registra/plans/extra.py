"""Registered queries of sources and sinks, parsing rules, reviews and listing pages. Files and pages that the test
tables lack are derived from them by Spark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registra.functions import scalars as S
from registra.operators import aggs, extract, joins, merges, predicates, scoring, search, windows
from registra.plans.more import ITEM, _folder, _scores, _stored
from registra.plans.views import view
from registra.sources import io

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


# Sources and sinks


def _export(spark, d):
    """A procurement export as files: written with local headers and amounts, then read as any export."""
    r = view(spark, d, "v_rec").join(view(spark, d, "v_item").select(F.col("id").alias("item_id"), "title", "published_date", "municipality_id"), "item_id")
    path = f"{_folder(spark)}/export"
    rows = r.select(
        F.col("item_id").cast("string").alias("Nr"), F.concat(F.lit("Bashkia NATION "), F.col("municipality_id").cast("string")).alias("Autoriteti Kontraktor"), F.concat("title", F.lit(", \"A\"; B")).alias("Objekti i Kontratës"),
        F.date_format("published_date", "dd/MM/yyyy").alias("Data e publikimit"), F.col("procedure_ref").alias("Numri i references"), F.translate(F.format_number("amount_value", 2), ",.", ".,").alias("Vlera e fondit"),
        F.col("amount_currency").alias("Monedha"), F.col("supplier_name").alias("Operatori Ekonomik"), F.lit("03310000-5").alias("Kodi CPV"),
    )
    rows.write.option("header", True).option("escape", '"').csv(path)
    return io.read_export(spark, path)


@query("""select cast(item_id as varchar) as nr, title || ', "A"; B' as title, published_date, procedure_ref as procedure_id, 'Bashkia NATION ' || cast(municipality_id as varchar) as authority,
    'https://e.al/x.csv' || case when procedure_ref is not null then '#procedure=' || procedure_ref else '' end as source_url from v_rec r join v_item i on i.id = r.item_id""")
def export_items(spark, d):
    df = _export(spark, d)
    return predicates.procurement_items(df, "https://e.al/x.csv").join(df.select("row_index", F.col("Nr").alias("nr")), "row_index").drop("row_index")


@query("""select cast(item_id as varchar) as nr, amount_value, case when trim(amount_currency) = 'EUR' then 'EUR' else 'ALL' end as amount_currency, supplier_name, '03' as cpv_group, procedure_ref, 9 as raw_columns from v_rec r join v_item i on i.id = r.item_id""")
def export_records(spark, d):
    df = _export(spark, d)
    found = predicates.procurement_records(df).join(df.select("row_index", F.col("Nr").alias("nr")), "row_index")
    return found.select("nr", "amount_value", "amount_currency", "supplier_name", "cpv_group", "procedure_ref", F.size("raw_row").alias("raw_columns"))


@query("""select reason, count(*) as n from (select case when published_date is null then 'missing_date' when year(published_date) <> 1997 then 'wrong_year' else 'kept' end as reason from v_item) x group by 1""")
def ingest_counters(spark, d):
    gated = predicates.year_gate(view(spark, d, "v_item"), 1997)
    return aggs.reason_histogram(gated.withColumn("reason", F.coalesce("skip_reason", F.lit("kept"))), "reason")


@query("select i.id, title, summary, name_key as municipality_key, category, cast(year(published_date) as int) as year from v_item i join v_m m on m.id = i.municipality_id where status = 'published'")
def search_sink(spark, d):
    path = f"{_folder(spark)}/index"
    docs = search.search_documents(view(spark, d, "v_item"), view(spark, d, "v_m"))
    io.write_search_documents(docs, path, reset=True)
    return spark.read.schema(docs.schema).json(path).select("id", "title", "summary", "municipality_key", "category", "year")


@query("""select case when ok then 'ok' else 'failed' end as bucket, count(*) as runs, cast(sum(case when ok then 1 else 0 end) as bigint) as inserted from v_attempt group by 1""")
def run_log(spark, d):
    path = f"{_folder(spark)}/log"
    a = view(spark, d, "v_attempt")
    ok = F.col("ok")
    rows = a.select(
        F.col("ts").cast("timestamp").alias("timestamp_utc"), F.col("source_id").cast("string").alias("municipality"), F.col("source_id").cast("string").alias("municipality_id"), F.when(ok, "OK").otherwise("FAILED").alias("status"),
        F.lit(2).alias("parsed_rows_total"), F.when(ok, 1).otherwise(0).alias("parsed_rows_kept"), F.when(ok, 1).otherwise(0).alias("inserted"), F.lit(0).alias("skipped"), F.col("error_type").alias("last_error_type"),
        F.lit("u").alias("scraped_from"), F.lit(5).alias("ms"), "http_status", F.col("message").alias("error_message"),
    )
    io.write_run_log(rows, path)
    return aggs.batch_outcomes(io.read_run_log(spark, path))


@query("select name_sq, case when id % 2 = 0 then 'X' else county end as county, name_key from v_m union all select 'Qyteti ' || cast(id as varchar), 'X', 'qyteti-' || cast(id as varchar) from v_m where id % 2 = 1")
def municipality_seed(spark, d):
    """Even municipalities get another county; as many new ones come in."""
    m = view(spark, d, "v_m").withColumn("id", F.col("id").cast("string"))
    i = F.col("id").cast("int")
    seed = m.where(i % 2 == 0).select("name_sq", F.lit("X").alias("county")).union(m.where(i % 2 == 1).select(F.concat(F.lit("Qyteti "), F.col("id")), F.lit("X")))
    return io.seed_municipalities(m, seed).select("name_sq", "county", "name_key")


@query("select m.id as municipality_id, greatest(count(r.id), 1) as primaries from v_m m left join v_reg r on r.municipality_id = m.id and r.is_primary group by 1")
def registry_seed(spark, d):
    out = io.seed_registry(view(spark, d, "v_reg"), view(spark, d, "v_m"))
    return out.where("is_primary").groupBy("municipality_id").agg(F.count("*").alias("primaries"))


@query("select count(*) as n, count(distinct alias_key) as aliases from (select alias_key from v_alias union select lower(replace(n_name, '_', '-')) from nation) x")
def alias_insert(spark, d):
    alias = view(spark, d, "v_alias")
    more = view(spark, d, "v_m").select(F.col("name_key").alias("alias_key"), F.col("id").alias("municipality_id"))
    out = joins.insert_if_absent(alias, more.union(more).union(alias), ["alias_key"])
    return out.agg(F.count("*").alias("n"), F.count_distinct("alias_key").alias("aliases"))


# Parsing and predicates


@query("""select id, id % 3 = 0 or id < 10000 as decision, regexp_matches(lower(title || ' ' || source_url), 'konsultim|degjes|njoftim') as keyword, id % 3 = 0 as document, case when id % 3 = 0 then 'pdf' end as ext,
    'm' || cast(municipality_id as varchar) || '.example.al' as host, cast(id as varchar) as name, case when source_origin = 'vendime.al' then 50 else 100 end as weight from v_item""")
def item_predicates(spark, d):
    u, t = F.col("source_url"), F.col("title")
    return view(spark, d, "v_item").select(
        "id", predicates.looks_like_decision(t, u).alias("decision"), predicates.keyword_keep(t, u).alias("keyword"), S.is_document_url(u).alias("document"), S.attachment_ext(u).alias("ext"), S.compare_host(u).alias("host"),
        S.slug_title(F.regexp_replace(u, r"\.pdf$", "")).alias("name"), S.source_weight(F.col("source_origin")).alias("weight"),
    )


@query("""select id, case when id % 2 = 0 then 'https://www.m' || cast(municipality_id as varchar) || '.example.al/doc/' || case when id % 3 = 0 then '' else cast(id as varchar) || '/' end || 'p' || cast(id as varchar) else 'https://www.m' || cast(municipality_id as varchar) || '.example.al/q' end as absolute,
    'https://x.al/y' as plain, 'Y1997-' || cast(id as varchar) as template, 'ab12' as number, case when id % 4 = 0 then 'Vendime' else null end as category from v_item""")
def url_rules(spark, d):
    i = F.col("id")
    href = F.when(i % 2 == 0, F.concat(F.lit("p"), i.cast("string"))).otherwise("/q")
    return view(spark, d, "v_item").select(
        "id", S.absolute_url(F.col("source_url"), href).alias("absolute"), S.normalize_url(F.concat(F.lit("https://x.al/y#"), i.cast("string"))).alias("plain"), S.apply_year_template(F.concat(F.lit("Y{year}-"), i.cast("string")), F.lit(1997)).alias("template"),
        S.normalize_decision_number(F.lit("ÄB-12")).alias("number"), S.canonical_category(F.when(i % 4 == 0, '"vendime"').otherwise("other")).alias("category"),
    )


@query("""select id, source_origin = 'vendime.al' and id % 3 = 0 or source_origin <> 'vendime.al' as allowed, year(published_date) = 1996 or regexp_matches(cast(id as varchar), '(^|[^0-9])1996([^0-9]|$)') as in_year,
    case when id % 2 = 0 then 'published' else 'draft' end as status_by_flag from v_item where published_date is not null""")
def source_policies(spark, d):
    """External links come from the municipality's own page: they stay if they are PDFs."""
    items = view(spark, d, "v_item").where("published_date is not null")
    own = F.concat(F.lit("m"), F.col("municipality_id").cast("string"), F.lit(".example.al"))
    ext = F.when(F.col("source_origin") == "vendime.al", F.regexp_replace("source_url", r"www\.m\d+\.example", "files.example")).otherwise(F.col("source_url"))
    policy = predicates.no_year_policy(ext, F.concat(F.lit("https://"), own, F.lit("/list")), own)
    return items.select("id", policy["allowed"].alias("allowed"), predicates.year_in(1996, F.col("published_date"), F.col("id").cast("string")).alias("in_year"), predicates.publish_decision(False, F.col("id") % 2 == 0).alias("status_by_flag"))


@query("""select id, case when id % 2 = 0 and id % 5 <> 0 and (id % 7 = 0 or id % 7 <= 5) then 'https://o.al/2024/' || cast(id as varchar) end as official_url from v_reg""")
def official_sources(spark, d):
    i = F.col("id")
    url = predicates.official_source(i % 2 == 0, F.when(i % 5 == 0, " ").otherwise(F.concat(F.lit("https://o.al/{year}/"), i.cast("string"))), F.when(i % 7 == 6, 2025).otherwise(2020), F.lit(None).cast("int"), 2024)
    return view(spark, d, "v_reg").select("id", url.alias("official_url"))


@query("""select r.id, case when name_key = 'nation-3' then 'https://special.al' else 'https://' || name_key || '.vendime.al/' end as new_url from v_reg r join v_m m on m.id = r.municipality_id""")
def canonical_urls(spark, d):
    reg = view(spark, d, "v_reg").join(view(spark, d, "v_m").select(F.col("id").alias("municipality_id"), "name_key"), "municipality_id")
    over = view(spark, d, "v_m").where("name_key = 'nation-3'").select("name_key", F.lit("https://special.al").alias("url"))
    return joins.canonical_urls(reg, over, "https://%s.vendime.al/").select("id", "new_url")


# Reviews and state


@query("select id, case when is_primary and coalesce(trim(konsultime_url), '') = '' and municipality_id % 2 = 0 then 'https://r.al/' || cast(municipality_id as varchar) else konsultime_url end as konsultime_url, case when is_primary and coalesce(trim(konsultime_url), '') = '' and municipality_id % 2 = 0 then null else last_error_type end as last_error_type from v_reg")
def reviewed_urls(spark, d):
    m = view(spark, d, "v_m")
    reviewed = m.select(F.col("id").alias("municipality_id"), (F.col("id") % 2 == 0).alias("confirmed"), F.concat(F.lit("https://r.al/"), F.col("id").cast("string")).alias("url"))
    return merges.apply_reviewed_urls(view(spark, d, "v_reg"), reviewed).select("id", "konsultime_url", "last_error_type")


@query("select id, case when id % 4 = 0 then 'official.al' else source_origin end as source_origin, case when id % 4 = 0 then 'published' else status end as status from v_item")
def provenance(spark, d):
    items = view(spark, d, "v_item")
    official = items.where("id % 4 = 0").select("source_url", F.lit("official.al").alias("origin"))
    return merges.reconcile_provenance(items, official, publish_them=True).select("id", "source_origin", "status")


@query("select id, vendime_checked or municipality_id % 3 = 0 as vendime_checked from v_reg")
def checked_flags(spark, d):
    m = view(spark, d, "v_m").where("id % 3 = 0").select(F.col("id").alias("municipality_id"))
    return merges.set_checked(view(spark, d, "v_reg"), "Vendime", m).select("id", "vendime_checked")


@query("""select reason, count(*) as n from (select case when id % 3 = 2 then 'url_or_file' when id % 3 = 1 and id % 2 = 0 then 'not_a_pdf' else 'accepted' end as reason from v_item) x group by 1""")
def manual_items(spark, d):
    """Every third has a URL, every third a file (half of them no PDF), every third neither."""
    i = F.col("id")
    rows = view(spark, d, "v_item").select(
        "municipality_id", "category", "title", "published_date", F.when(i % 3 == 0, F.col("source_url")).alias("source_url"), F.when((i % 3 == 1) & (i % 2 == 1), F.encode(F.concat(F.lit("%PDF-"), i.cast("string")), "UTF-8")).when(i % 3 == 1, F.encode(F.lit("zip"), "UTF-8")).alias("content")
    )
    good, bad = merges.manual_items(rows)
    return aggs.reason_histogram(good.select(F.lit("accepted").alias("reason")).unionByName(bad.select("reason")), "reason")


@query("""select m.id as municipality_id, case when m.id % 3 = 0 then case when m.id % 2 = 0 then null else 10 end when m.id % 5 = 0 then 5 else 0 end as ind4_final, m.id % 3 = 0 and m.id % 2 = 1 or m.id % 3 <> 0 and m.id % 5 = 0 as ind4_overridden from v_m m""")
def score_overrides(spark, d):
    """Even reviewed municipalities are cleared, every fifth is set to 5; settings out of the rubric are rejected."""
    stored = _stored(_scores(spark, d))
    m = F.col("municipality_id")
    clear = stored.where((m % 3 == 0) & (m % 2 == 0)).select("municipality_id", F.lit(4).alias("indicator"), F.lit("clear").alias("action"), F.lit(None).cast("int").alias("value"), F.lit(None).cast("string").alias("argument"))
    five = stored.where((m % 5 == 0) & (m % 3 != 0)).select("municipality_id", F.lit(4), F.lit("set"), F.lit(5), F.lit("seen"))
    odd = stored.where((m % 5 != 0) & (m % 3 != 0)).select("municipality_id", F.lit(4), F.lit("set"), F.lit(7), F.lit("seen"))
    return merges.override_scores(stored, clear.union(five).union(odd))[0].select("municipality_id", "ind4_final", "ind4_overridden")


@query("select m.id as municipality_id, k as indicator, m.id % 3 = 0 and k = 4 as overridden from v_m m cross join (select unnest([1, 2, 3, 4, 5]) as k) x")
def indicators_long(spark, d):
    return scoring.indicators_long(_stored(_scores(spark, d))).select("municipality_id", "indicator", "overridden")


# Listing pages: one page for each municipality and month, its table rows from items

LISTED = "listed as (select id, municipality_id, title, published_date, source_url, strftime(published_date, '%Y-%m') as month, municipality_id * 1000000 + year(published_date) * 100 + month(published_date) as page_id from v_item where published_date is not null)"


def _listing(spark, d):
    items = view(spark, d, "v_item").where("published_date is not null")
    page = F.col("municipality_id").cast("long") * 1000000 + F.year("published_date") * 100 + F.month("published_date")
    tr = F.format_string('<tr><td>%d</td><td>%s</td><td>%s</td><td><a href="%s">Shiko</a></td></tr>', F.col("id") % 1000, F.date_format("published_date", "dd.MM.yyyy"), F.col("title"), F.col("source_url"))
    rows = items.withColumn("page_id", page).withColumn("tr", tr)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "tr"))), lambda x: x["tr"]), "")
    found = rows.groupBy("page_id", "municipality_id").agg(body.alias("body"), F.min("published_date").alias("first"))
    head = F.format_string('<html><head><meta name="date" content="%s"></head><body><h1>Vendime</h1><p>ok</p><p>Lista e vendimeve te muajit</p><table>', F.date_format("first", "yyyy-MM-dd"))
    tail = F.lit('</table><a href="?page=3">3</a><a href="?page=2">2</a></body></html>')
    url = F.format_string("https://m%d.example.al/lista/%d", F.col("municipality_id"), F.col("page_id"))
    return found.select("page_id", url.alias("url"), F.concat(head, "body", tail).alias("html"))


@query(f"with {LISTED} select page_id, title, source_url as href, published_date as date, 4 as cells from listed")
def table_rows(spark, d):
    rows = extract.table_rows(_listing(spark, d))
    return rows.select("page_id", "title", "href", "date", F.size("cells").alias("cells"))


@query(f"with {LISTED} select distinct page_id, source_url as url from listed where id % 3 = 0")
def document_links(spark, d):
    return extract.document_links(_listing(spark, d)).select("page_id", "url")


@query(f"with {LISTED} select page_id, 'https://m' || cast(municipality_id as varchar) || '.example.al/lista/' || cast(page_id as varchar) || '?page=2' as next_url, min(published_date) as date, 'Lista e vendimeve te muajit' as summary from listed group by page_id, municipality_id")
def page_facts(spark, d):
    pages = _listing(spark, d)
    facts = pages.select("page_id", extract.page_date(F.col("html")).alias("date"), extract.page_summary(F.col("html")).alias("summary"))
    return extract.next_page(pages).join(facts, "page_id")


@query(f"with {LISTED} select page_id, cast(id % 1000 as varchar) as number, published_date, 'Vendim nr. ' || cast(id % 1000 as varchar) as title, source_url from listed where year(published_date) >= 1995")
def profile_items(spark, d):
    pages = _listing(spark, d)
    profiles = view(spark, d, "v_m").select(
        F.format_string("m%d.example.al", "id").alias("host"), F.lit("/lista/").alias("path_pattern"), F.lit(0).alias("number_cell"), F.lit(1).alias("date_cell"), F.lit(2).alias("title_cell"), F.lit("Vendim nr. {number}").alias("title_template"), F.lit(1995).alias("year_floor"), F.lit("decision").alias("kind")
    )
    return extract.profile_items(pages, profiles)[0].select("page_id", "number", "published_date", "title", "source_url")


@query(f"with {LISTED}, n as (select page_id, source_url as url, 'Shiko' as label, row_number() over (partition by page_id order by id) as rn from listed where id % 3 = 0) select page_id, count(*) as documents, max(url) filter (rn = 1) as first_url from n group by 1")
def item_documents(spark, d):
    found = extract.item_documents(_listing(spark, d))
    return found.select("page_id", F.size("documents").cast("long").alias("documents"), F.element_at("documents", 1)["url"].alias("first_url"))


@query(f"with {LISTED} select page_id, source_url as url from (select *, row_number() over (partition by page_id order by id) as rn from listed where id % 3 = 0) x where rn <= 2")
def document_cap(spark, d):
    found = extract.item_documents(_listing(spark, d)).withColumnRenamed("page_id", "id")
    return windows.document_cap(found, most=2).select(F.col("id").alias("page_id"), "url")


@query("select id, title, published_date, source_url from v_item where year(published_date) = 1997")
def union_keep_first(spark, d):
    """Articles, hearings and registers overlap: the first source of each URL counts."""
    own = view(spark, d, "v_item")
    found = extract.page_items(own, own, own.where("id % 2 = 0").withColumn("title", F.lit("other")), own.withColumn("title", F.lit("late")), year=1997)
    return found.join(own.select("id", F.col("source_url").alias("u")), F.col("source_url") == F.col("u")).select("id", "title", "published_date", "source_url")


@query("select id, title, source_origin, 'baseline' as part from v_item where id % 2 = 0 union all select id, title, 'official.al', 'official' from v_item where id % 2 = 1")
def tagged_union(spark, d):
    """Baseline and official rows with their source; official rows of the same key come first."""
    items = view(spark, d, "v_item").select(*ITEM)
    official = items.where("id % 2 = 1").withColumn("source_origin", F.lit("official.al"))
    return windows.tagged_union({"official": official, "baseline": items}, merges.ITEM_KEY, ["id"]).select("id", "title", "source_origin", "part")
