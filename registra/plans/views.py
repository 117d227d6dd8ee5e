"""The engine's tables bound to the star-schema test tables: one SQL text for each, in the dialect that Spark and
DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"]

VIEWS = {
    "v_m": "select n_nationkey as id, replace(n_name, '_', ' ') as name_sq, r_name as county, lower(replace(n_name, '_', '-')) as name_key from {nation} join {region} on n_regionkey = r_regionkey",
    "v_alias": "select 'n' || cast(n_nationkey as string) as alias_key, n_nationkey as municipality_id from {nation}",
    "v_item": """select o_orderkey as id, c_nationkey as municipality_id,
        case o_orderstatus when 'O' then 'Vendime' when 'F' then 'Prokurime' else 'Konsultime publike' end as category,
        case when substr(o_orderpriority, 1, 1) in ('1', '2', '3') then 'published' when substr(o_orderpriority, 1, 1) = '4' then 'draft' else 'archived' end as status,
        case when o_orderkey % 11 = 0 then null else cast(o_orderdate as date) end as published_date, o_orderkey % 11 = 0 as date_unknown,
        o_orderdate + interval '1' day as collected_at, c_mktsegment || ' Nr ' || cast(o_orderkey as string) as title, 'order ' || o_orderpriority as summary,
        'https://www.m' || cast(c_nationkey as string) || '.example.al/doc/' || cast(o_orderkey as string) || case when o_orderkey % 3 = 0 then '.pdf' else '/' end as source_url,
        case when o_orderkey % 5 = 0 then 'vendime.al' else 'm' || cast(c_nationkey as string) || '.example.al' end as source_origin, 'k' || cast(o_orderkey as string) as dedup_key
        from {orders} join {customer} on o_custkey = c_custkey""",
    "v_att": """select l_orderkey * 1000 + seq as id, l_orderkey as item_id, l_shipdate as created_at, cast(l_quantity as bigint) as size_bytes,
        case l_returnflag when 'A' then 'projekt-vendim-' when 'R' then 'raport-permbledhes-konsultim-' else 'kalendari-vjetor-' end || cast(l_suppkey as string) || '.pdf' as file_name,
        'https://files.example.al/' || cast(l_partkey as string) as source_url, cast(l_partkey as string) as sha256
        from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as seq from {lineitem}) x""",
    "v_rec": """select l_orderkey as item_id, cast(l_extendedprice as decimal(18,2)) as amount_value, case l_returnflag when 'A' then ' all ' when 'N' then '' else 'EUR' end as amount_currency,
        case when p_size % 13 = 0 then ' ' else p_type end as cpv_code, s_name as supplier_name, case when l_partkey % 4 = 0 then null else 'REF-' || cast(l_orderkey as string) end as procedure_ref
        from (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as seq from {lineitem}) x
        join {part} on l_partkey = p_partkey join {supplier} on l_suppkey = s_suppkey where seq = 1""",
    "v_reg": """select s_suppkey as id, s_suppkey as source_id, s_nationkey as municipality_id, s_suppkey % 7 = 0 as is_primary,
        case s_suppkey % 5 when 0 then null when 1 then '  ' else 'https://v.example.al/' || cast(s_suppkey as string) end as vendime_url,
        case s_suppkey % 3 when 0 then '' else 'https://p.example.al/' || cast(s_suppkey as string) end as prokurime_url,
        case s_suppkey % 2 when 0 then null else 'https://k.example.al/' || cast(s_suppkey as string) end as konsultime_url,
        case s_suppkey % 6 when 0 then 'OK' when 1 then 'BLOCKED' when 2 then 'error' when 3 then 'DOWN' else null end as homepage_status,
        case s_suppkey % 8 when 1 then 'HTTP_403' when 2 then 'timeout' when 3 then 'UPSTREAM_DOWN' else null end as last_error_type,
        case when s_suppkey % 4 = 1 then cast('2024-01-02 00:00:00' as timestamp) else null end as cooldown_until,
        cast('2024-01-01' as date) + cast(s_suppkey % 50 as int) as updated_at, s_suppkey % 2 = 1 as vendime_checked, s_suppkey % 3 = 1 as prokurime_checked, s_suppkey % 4 = 1 as konsultime_checked from {supplier}""",
    "v_auth": """select s_suppkey as id, case s_suppkey % 4 when 0 then 'Bashkia ' || replace(n_name, '_', ' ') when 1 then 'MUNICIPALITY of  ' || replace(n_name, '_', ' ') || ' (unit)'
        when 2 then 'Ndërmarrja e Pastrimit ' || replace(n_name, '_', ' ') else case when s_suppkey % 8 = 3 then '' else 'Agjencia Kombëtare ' || replace(n_name, '_', ' ') end end as authority
        from {supplier} join {nation} on s_nationkey = n_nationkey""",
    "v_attempt": """select event_id as id, user_id as source_id, ts, event_id % 5 not in (0, 1, 2) as ok, case event_id % 5 when 0 then 'HTTP_403' when 1 then 'TIMEOUT' when 2 then 'ENOTFOUND' else null end as error_type,
        cast(case event_id % 5 when 0 then 403 when 1 then null when 2 then null else 200 end as int) as http_status, case event_id % 5 when 1 then 'Request timed out' else null end as message from {events}""",
    "v_doc": "select doc_id as id, text, source, lang from {documents}",
    "v_page": "select page_id, url, html from {pages}",
}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = VIEWS[name]
    used = [t for t in BASE if "{" + t + "}" in text]
    return spark.sql(text, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_views(sql: str) -> str:
    """sql for DuckDB, with the views that it names as common table expressions."""
    used = [v for v in VIEWS if v in sql]
    ctes = ", ".join(f"{v} as ({VIEWS[v].format(**{t: t for t in BASE})})" for v in used)
    text = sql.strip()
    if not used:
        return text
    return f"with {ctes}, {text[5:].lstrip()}" if text[:5].lower() == "with " else f"with {ctes} {text}"
