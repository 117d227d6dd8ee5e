"""Registered queries of merges, source state, audits, scores, pages, search and streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registra.functions import scalars as S
from registra.operators import aggs, extract, joins, merges, predicates, scoring, search, windows
from registra.plans.views import view
from registra.sources.shared import shared_dir
from registra.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


# Merges: even ids are the target, incoming rows are others and changed ones

ITEM = ["id", "municipality_id", "category", "title", "published_date", "date_unknown", "source_url", "source_origin", "dedup_key", "status"]
HALVES = """target as (select * from v_item where id % 2 = 0), incoming as (select id, municipality_id, category, case when id % 4 = 0 then title || ' (new)' else title end as title,
    case when id % 11 = 0 and id % 3 = 0 then date '2020-01-01' else published_date end as published_date, source_url, case when id % 5 = 0 then 'official.example.al' else 'vendime.al' end as source_origin, dedup_key, status from v_item where id % 2 = 1 or id % 4 = 0)"""


def _halves(spark, d):
    items = view(spark, d, "v_item").select(*ITEM)
    i = F.col("id")
    date = F.when((i % 11 == 0) & (i % 3 == 0), F.lit("2020-01-01").cast("date")).otherwise(F.col("published_date"))
    incoming = items.where((i % 2 == 1) | (i % 4 == 0)).withColumn("title", F.when(i % 4 == 0, F.concat("title", F.lit(" (new)"))).otherwise(F.col("title")))
    incoming = incoming.withColumn("published_date", date).withColumn("date_unknown", date.isNull()).withColumn("source_origin", F.when(i % 5 == 0, "official.example.al").otherwise("vendime.al"))
    return items.where(i % 2 == 0), incoming


@query(f"""with {HALVES}, w as (select coalesce(t.id, n.id) as id, t.id is not null as has_t, n.id is not null as has_n, coalesce(n.source_origin <> 'vendime.al' and t.source_origin = 'vendime.al', false) as heavier,
    coalesce(t.published_date is null and n.published_date is not null, false) as fills, t.title as tt, n.title as nt, t.published_date as td, n.published_date as nd, t.source_origin as o1, n.source_origin as o2, t.status as s1, n.status as s2
    from target t full join incoming n on t.municipality_id = n.municipality_id and t.category = n.category and t.dedup_key = n.dedup_key)
    select id, case when not has_t then nt when heavier then nt else tt end as title, case when not has_t then nd when has_n and fills then nd when heavier then coalesce(nd, td) else td end as published_date,
    case when not has_t then o2 when heavier then o2 else o1 end as source_origin, case when not has_t then s2 when has_n and (true) then 'published' else s1 end as status,
    case when not has_n then 'kept' when not has_t then 'inserted' when heavier or fills or s1 <> 'published' then 'updated' else 'skipped' end as action from w""")
def merge_decisions(spark, d):
    out, actions = merges.merge_decisions(*_halves(spark, d), publish=True)
    return out.join(actions, "id", "left").select("id", "title", "published_date", "source_origin", "status", F.coalesce("action", F.lit("kept")).alias("action"))


@query(f"""with {HALVES} select coalesce(t.id, n.id) as id, coalesce(n.title, t.title) as title, coalesce(t.published_date, n.published_date) as published_date, coalesce(t.status, n.status) as status,
    case when n.id is null then 'kept' when t.id is null then 'inserted' when n.title <> t.title or (t.published_date is null and n.published_date is not null) then 'updated' else 'skipped' end as action
    from target t full join incoming n on t.municipality_id = n.municipality_id and t.category = n.category and t.dedup_key = n.dedup_key""")
def merge_documents(spark, d):
    out, actions = merges.merge_documents(*_halves(spark, d))
    return out.join(actions, "id", "left").select("id", "title", "published_date", "status", F.coalesce("action", F.lit("kept")).alias("action"))


@query(f"""with {HALVES} select n.id, case when n.id % 7 = 0 then 'skipped' when t.id is null then 'inserted' when n.title <> t.title or (t.published_date is null and n.published_date is not null) then 'updated' else 'skipped' end as action
    from incoming n left join target t on t.id = n.id where n.id % 7 <> 0 or n.id % 2 = 1 or true""".replace("n.id % 7 = 0 then 'skipped'", "n.id % 7 = 0 and n.id % 2 = 0 then 'skipped'"))
def merge_url_conflicts(spark, d):
    """Every seventh incoming row comes under another key: its URL is taken, so it is skipped."""
    target, incoming = _halves(spark, d)
    moved = incoming.withColumn("dedup_key", F.when(F.col("id") % 7 == 0, F.concat("dedup_key", F.lit("x"))).otherwise(F.col("dedup_key")))
    return merges.merge_documents(target, moved)[1]


@query("""with own as (select id, municipality_id, published_date, cast(id % 50 as varchar) as number, substr(sha1(lower(title)), 1, 12) as h from v_item where category = 'Vendime'),
    keys as (select id, municipality_id, cast(municipality_id as varchar) || '|' || coalesce(cast(published_date as varchar), 'unknown') || '|' || number || '|' || h as dated, cast(municipality_id as varchar) || '|unknown|' || number || '|' || h as unknown, published_date from own)
    select id, case when published_date is not null and id % 3 = 0 then unknown else dated end as dedup_key from keys""")
def decision_key_resolution(spark, d):
    """Every third decision is stored without a date: its dated row adopts that key."""
    own = view(spark, d, "v_item").where("category = 'Vendime'").withColumn("number", (F.col("id") % 50).cast("string")).withColumn("title_normalized", S.normalize_title(F.col("title")))
    stored = own.where("id % 3 = 0").withColumn("dedup_key", S.decision_key(F.col("municipality_id"), F.lit(None).cast("date"), F.col("number"), F.col("title_normalized")))
    return merges.resolve_decision_keys(own, stored).select("id", "dedup_key")


@query("select item_id, cast(amount_value * (case when item_id % 3 = 0 then 2 else 1 end) as decimal(18,2)) as amount_value, supplier_name from v_rec")
def record_upsert(spark, d):
    """Even items have a record; odd ones and every third come in, each after an older row of its own."""
    r = view(spark, d, "v_rec").select("item_id", "amount_value", "supplier_name")
    last = r.where("item_id % 2 = 1 or item_id % 3 = 0").withColumn("amount_value", F.when(F.col("item_id") % 3 == 0, F.col("amount_value") * 2).otherwise(F.col("amount_value")).cast("decimal(18,2)"))
    older = last.withColumn("amount_value", F.lit(0).cast("decimal(18,2)")).withColumn("at", F.lit(1))
    return merges.upsert(r.where("item_id % 2 = 0"), last.withColumn("at", F.lit(2)).unionByName(older), ["item_id"], ["at"])


@query("""select status, count(*) as n, count(*) filter (turned) as turned from (select case when municipality_id = 7 and category = 'Prokurime' and year(published_date) = 1996 then 'published' else status end as status,
    coalesce(municipality_id = 7 and category = 'Prokurime' and year(published_date) = 1996 and status <> 'published', false) as turned from v_item) x group by 1""")
def publish_transition(spark, d):
    before = view(spark, d, "v_item")
    after = merges.publish(before.withColumn("was", F.col("status")), municipality_id=7, category="Prokurime", year=1996)
    return after.groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("status") != F.col("was")).alias("turned"))


@query("""with t as (select i.id from v_item i where municipality_id = 7 and category = 'Prokurime' and status <> 'published'), a as (select item_id, count(*) as n from v_att group by 1)
    select count(*) as published, count(n) as with_attachments, cast(coalesce(sum(n), 0) as bigint) as attachments_public from t left join a on a.item_id = t.id""")
def publish_stats(spark, d):
    before = view(spark, d, "v_item")
    return aggs.publish_stats(before, merges.publish(before, municipality_id=7, category="Prokurime"), view(spark, d, "v_att"))


@query("select id, case when rn = 1 and item_id % 2 = 1 then 'stored' else 'duplicate' end as action from (select *, row_number() over (partition by item_id, sha256 order by id) as rn from v_att) x")
def attachment_actions(spark, d):
    """Attachments of even items are there already."""
    a = view(spark, d, "v_att").select("id", "item_id", "sha256")
    return merges.add_attachments(a.where("item_id % 2 = 0"), a)[1]


@query("select id, id as found from v_item")
def item_lookup(spark, d):
    """Odd rows are asked for by a wrong key: their URL finds them."""
    items = view(spark, d, "v_item")
    wanted = items.select(F.col("id").alias("wanted"), "municipality_id", "category", F.when(F.col("id") % 2 == 1, "none").otherwise(F.col("dedup_key")).alias("dedup_key"), "source_url")
    return merges.lookup_items(wanted, items).select(F.col("wanted").alias("id"), F.col("id").alias("found"))


@query("select id, name_key, case when id % 2 = 0 then 'old-' || cast(id as varchar) end as alias from v_m")
def key_regeneration(spark, d):
    m = view(spark, d, "v_m")
    stale = m.withColumn("name_key", F.when(F.col("id") % 2 == 0, F.concat(F.lit("old-"), F.col("id").cast("string"))).otherwise(F.col("name_key")))
    new, alias = merges.regenerate_keys(stale, view(spark, d, "v_alias").where("false"))
    return new.join(alias.select(F.col("municipality_id").alias("id"), F.col("alias_key").alias("alias")), "id", "left").select("id", "name_key", "alias")


# Source state

ATTEMPTS = """s as (select source_id, count(*) as attempts, min(ts) as first_ts, max(ts) as last_ts, max(ts) filter (ok) as last_ok, arg_max(ok, (ts, id)) as ok, arg_max_null(error_type, (ts, id)) as err,
    arg_max(case when ok then 'OK' when error_type = 'HTTP_403' then 'BLOCKED' when error_type = 'TIMEOUT' then 'ERROR' end, (ts, id)) as st,
    count(distinct strftime(ts, '%Y-%m-%dT%H')) as hours, min(strftime(ts, '%Y-%m-%dT%H')) as first_hour from v_attempt group by 1)"""


def _states(spark, d):
    r = view(spark, d, "v_reg")
    none = F.lit(None)
    return r.select(
        "source_id", (F.col("source_id") % 9).alias("attempt_count"), none.cast("timestamp_ntz").alias("first_seen"), none.cast("timestamp_ntz").alias("last_checked"), none.cast("timestamp_ntz").alias("last_seen"), "last_error_type",
        none.cast("timestamp_ntz").alias("cooldown_until"), "homepage_status", F.array().cast("array<string>").alias("hour_buckets"),
    )


@query(f"with {ATTEMPTS} select source_id, attempts, first_ts, last_ts, last_ok, hours, first_hour from s")
def attempt_bookkeeping(spark, d):
    s = merges.attempt_summary(view(spark, d, "v_attempt"))
    return s.select("source_id", "attempts", "first_ts", "last_ts", "last_ok", F.size("hours").cast("long").alias("hours"), F.array_min("hours").alias("first_hour"))


@query("""select source_id, count(*) filter (error_type = 'TIMEOUT') as timeouts, count(*) filter (error_type = 'HTTP_403') as blocked, max(ts) as last_failure, arg_max(error_type, (ts, id)) as last_error from v_attempt where not ok group by 1""")
def failure_counts(spark, d):
    return aggs.failures_by_source(view(spark, d, "v_attempt"))


@query(f"""with {ATTEMPTS} select r.source_id, r.source_id % 9 + coalesce(attempts, 0) as attempt_count, first_ts as first_seen, last_ts as last_checked, last_ok as last_seen,
    case when s.ok then null when s.ok is not null then err else last_error_type end as last_error_type, case when s.ok or s.ok is null then null when err = 'HTTP_403' then last_ts + interval '10080' minute else last_ts + interval '30' minute end as cooldown_until,
    coalesce(st, homepage_status) as homepage_status, coalesce(hours, 0) as hours from v_reg r left join s on s.source_id = r.source_id""")
def registry_after_failures(spark, d):
    return merges.apply_attempts(_states(spark, d), view(spark, d, "v_attempt")).withColumn("hours", F.size("hour_buckets").cast("long")).drop("hour_buckets")


@query("select source_id, strftime(ts, '%Y-%m-%dT%H') as hour, count(*) as attempts, count(*) filter (not ok) as errors from v_attempt group by 1, 2")
def hour_buckets(spark, d):
    return streams.hour_activity(view(spark, d, "v_attempt"))


@query("select case error_type when 'ENOTFOUND' then 'UPSTREAM_DOWN' when 'TIMEOUT' then 'TIMEOUT' when 'HTTP_403' then 'HTTP_403' else 'SCRAPE_ERROR' end as class, count(*) as n from v_attempt group by 1")
def error_classes(spark, d):
    return view(spark, d, "v_attempt").groupBy(S.error_class(F.col("error_type"), F.lit(None).cast("string")).alias("class")).agg(F.count("*").alias("n"))


# Quality and audits


@query("""with bad as (select *, case when id % 17 = 0 then not date_unknown else date_unknown end as du, case when id % 13 = 0 then null else source_url end as su, case when id % 19 = 0 then 'other' else category end as cat,
    case when id % 13 = 0 then 'k' || cast(id % 130 as varchar) else dedup_key end as dk, case when id % 13 = 0 then 1 else municipality_id end as mm from v_item)
    select id, 'unknown_category' as rule from bad where cat = 'other' union all select id, 'date_flag' from bad where status = 'published' and du <> (published_date is null) union all select id, 'missing_source' from bad where status = 'published' and su is null
    union all select b.id, 'dedup_key_not_unique' from bad b join (select mm, cat, dk from bad where su is null group by 1, 2, 3 having count(*) > 1) k on b.mm = k.mm and b.cat = k.cat and b.dk = k.dk where b.su is null""")
def quality_violations(spark, d):
    i = F.col("id")
    items = view(spark, d, "v_item").withColumns({
        "date_unknown": F.when(i % 17 == 0, ~F.col("date_unknown")).otherwise(F.col("date_unknown")),
        "source_url": F.when(i % 13 == 0, None).otherwise(F.col("source_url")),
        "category": F.when(i % 19 == 0, "other").otherwise(F.col("category")),
        "dedup_key": F.when(i % 13 == 0, F.concat(F.lit("k"), (i % 130).cast("string"))).otherwise(F.col("dedup_key")),
        "municipality_id": F.when(i % 13 == 0, 1).otherwise(F.col("municipality_id")),
    })
    return predicates.quality_violations(items)


@query("select id as municipality_id, 'missing' as side from v_m where id not in (select municipality_id from v_reg where is_primary) union all select distinct municipality_id, 'extra' from v_reg where is_primary and municipality_id >= 20")
def missing_extra_members(spark, d):
    found = view(spark, d, "v_reg").where("is_primary").select("municipality_id")
    expected = view(spark, d, "v_m").select(F.col("id").alias("municipality_id"))
    both = joins.missing_and_extra(found, expected, "municipality_id")
    return both.where("side = 'missing'").unionByName(joins.missing_and_extra(found, expected.where("municipality_id < 20"), "municipality_id").where("side = 'extra'"))


@query("""select i.id, case when r.item_id is null then 'missing_record' when amount_value is null then 'missing_amount' else 'missing_currency' end as reason from v_item i left join (select * from v_rec where item_id % 4 <> 0) r on r.item_id = i.id
    where category = 'Prokurime' and year(published_date) = 1997 and (r.item_id is null or amount_value is null or trim(coalesce(amount_currency, '')) = '')""")
def repair_candidates(spark, d):
    return predicates.repair_candidates(view(spark, d, "v_item"), view(spark, d, "v_rec").where("item_id % 4 <> 0"), 1997).select("id", "reason")


AUDIT = """audit as (select m.id as municipality_id, name_key, count(i.id) as items, count(r.item_id) as records, count(amount_value) as with_amount, count(r.item_id) filter (amount_value is null) as missing_amount,
    count(amount_value) filter (cur <> 'ALL') as other_currency, cast(coalesce(sum(amount_value) filter (cur = 'ALL'), 0) as decimal(18,2)) as total from v_m m left join v_item i on i.municipality_id = m.id and category = 'Prokurime'
    left join (select *, coalesce(nullif(trim(upper(amount_currency)), ''), 'ALL') as cur from v_rec where item_id % 6 <> 0) r on r.item_id = i.id group by 1, 2)"""


def _audit(spark, d):
    return aggs.procurement_audit(view(spark, d, "v_m"), view(spark, d, "v_item"), view(spark, d, "v_rec").where("item_id % 6 <> 0"))


@query(f"with {AUDIT} select * from audit")
def procurement_audit(spark, d):
    return _audit(spark, d)


@query(f"""with {AUDIT}, served as (select municipality_id, case when municipality_id % 5 = 0 then total + 1 else total end as total from audit where municipality_id % 7 <> 0)
    select case when s.total is null then 'missing_served' when abs(a.total - s.total) <= 0.01 then 'match' else 'total_mismatch' end as reason, count(*) as n from audit a left join served s on s.municipality_id = a.municipality_id group by 1""")
def audit_reasons(spark, d):
    stored = _audit(spark, d).select("municipality_id", "total")
    served = stored.where("municipality_id % 7 <> 0").withColumn("total", F.when(F.col("municipality_id") % 5 == 0, F.col("total") + 1).otherwise(F.col("total")))
    return aggs.reason_histogram(joins.reconcile(stored, served), "reason")


# Evidence and scores


@query("""select municipality_id, count(distinct i.id) as items, count(distinct a.item_id) as items_with_attachment, count(a.id) as attachments from v_item i left join v_att a on a.item_id = i.id
    where status = 'published' and category = 'Konsultime publike' group by 1""")
def evidence_counts(spark, d):
    return aggs.consultation_counts(view(spark, d, "v_item"), view(spark, d, "v_att"))


@query("""select municipality_id, id, attachment_id from (select i.municipality_id, i.id, a.id as attachment_id, row_number() over (partition by i.municipality_id order by case when a.file_name like 'kalendari-vjetor%' then 25 else 0 end desc,
    published_date desc nulls last, title, a.source_url, a.id) as rn from v_item i join v_att a on a.item_id = i.id where status = 'published' and category = 'Konsultime publike' and a.file_name like 'kalendari-vjetor%') x where rn = 1""")
def evidence_pick(spark, d):
    e = joins.evidence_rows(view(spark, d, "v_item"), view(spark, d, "v_att"))
    i, t = F.col("item_text"), F.col("document_text")
    return scoring.pick_evidence(e, predicates.annual_calendar(i, t), scoring.calendar_rank(i, t, F.col("published_date"))).select("municipality_id", "id", "attachment_id")


SCORES = """primary_row as (select * from (select *, row_number() over (partition by municipality_id order by updated_at desc, id desc) as rn from v_reg where is_primary) x where rn = 1),
    ev as (select municipality_id, max(case when file_name like 'kalendari%' then 10 else 0 end) as annual, max(case when file_name like 'projekt%' then 10 else 0 end) as draft, max(case when file_name like 'raport%' then 10 else 0 end) as response
    from v_item i join v_att a on a.item_id = i.id where status = 'published' and category = 'Konsultime publike' group by 1),
    any_item as (select distinct municipality_id from v_item where status = 'published' and category = 'Konsultime publike'),
    scores as (select m.id as municipality_id, name_key, coalesce(annual, 0) as ind1_auto, case when coalesce(trim(konsultime_url), '') <> '' then 10 else 0 end as ind2_auto,
    case when draft = 10 then 10 when s.municipality_id is not null then 5 else 0 end as ind3_auto, 0 as ind4_auto, coalesce(response, 0) as ind5_auto
    from v_m m left join ev on ev.municipality_id = m.id left join any_item s on s.municipality_id = m.id left join primary_row p on p.municipality_id = m.id)"""
AUTO = [f"ind{k}_auto" for k in range(1, 6)]


def _scores(spark, d):
    return scoring.indicator_scores(view(spark, d, "v_m"), view(spark, d, "v_reg"), view(spark, d, "v_item"), view(spark, d, "v_att"))


@query(f"with {SCORES} select * from scores")
def indicator_scores(spark, d):
    return _scores(spark, d).select("municipality_id", "name_key", *AUTO)


def _stored(fresh):
    """Scores as stored: of every third municipality a reviewer has raised the fourth indicator."""
    own = fresh.select("municipality_id", *AUTO)
    for k in range(1, 6):
        over = (F.col("municipality_id") % 3 == 0) & F.lit(k == 4)
        own = own.withColumn(f"ind{k}_final", F.when(over, 10).otherwise(F.col(f"ind{k}_auto"))).withColumn(f"ind{k}_overridden", over)
    return own


@query(f"""with {SCORES}, t as (select municipality_id, ind1_auto + ind2_auto + ind3_auto + ind5_auto + case when municipality_id % 3 = 0 then 10 else 0 end as total from scores)
    select municipality_id, total, case when total >= 90 then 'Excellent' when total >= 75 then 'Good' when total >= 60 then 'Moderate' when total >= 40 then 'Weak' else 'Critical' end as tier from t""")
def score_effective(spark, d):
    return scoring.effective_scores(_stored(_scores(spark, d))).select("municipality_id", "total", "tier")


@query(f"""with {SCORES} select municipality_id, ind1_auto as ind1_final, case when municipality_id % 3 = 0 and municipality_id < 20 then 10 else 0 end as ind4_final, municipality_id % 3 = 0 and municipality_id < 20 as ind4_overridden from scores""")
def score_upsert(spark, d):
    """Municipalities up to 19 are stored, with zero automatic values; all are computed anew."""
    fresh = _scores(spark, d)
    stored = _stored(fresh).where("municipality_id < 20").withColumn("ind1_auto", F.lit(0))
    new = _stored(fresh).withColumn("ind4_final", F.col("ind4_auto")).withColumn("ind4_overridden", F.lit(False))
    return merges.upsert_scores(stored, new).select("municipality_id", "ind1_final", "ind4_final", "ind4_overridden")


@query(f"with {SCORES} select municipality_id, ind1_auto + ind2_auto + ind3_auto + ind4_auto + ind5_auto + case when municipality_id % 3 = 0 and municipality_id < 10 then 10 else 0 end as total from scores")
def score_preview(spark, d):
    fresh = _scores(spark, d)
    return scoring.preview(_stored(fresh).where("municipality_id < 10"), fresh).select("municipality_id", "total")


# Pages

LINKS = """links as (select page_id, url, unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"[^>]*>([^<]*)</a>', 1)) as href, unnest(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"[^>]*>([^<]*)</a>', 2)) as text,
    unnest(range(len(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"[^>]*>([^<]*)</a>')))) as pos from v_page),
    abs_links as (select *, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || href as abs_url from links)"""
WORDS = ["the", "tion", "and"]


@query(f"with {LINKS} select page_id, cast(pos as int) as pos, href, trim(text) as text, abs_url from abs_links")
def anchors(spark, d):
    return extract.anchors(view(spark, d, "v_page")).select("page_id", "pos", "href", "text", "abs_url")


@query(f"""with {LINKS}, kept as (select *, row_number() over (partition by page_id, abs_url order by pos) as r1 from abs_links where regexp_matches(lower(abs_url), 'tion|and')), firsts as (select *, row_number() over (partition by page_id order by pos) as r2 from kept where r1 = 1)
    select page_id, abs_url from firsts where r2 <= 6""")
def same_host_links(spark, d):
    return extract.same_host_links(view(spark, d, "v_page"), "tion|and").select("page_id", "abs_url")


def _candidates(spark, d):
    links = extract.anchors(view(spark, d, "v_page")).select("page_id", "pos", "text", "href", F.col("abs_url").alias("url"), F.when(F.col("pos") == 0, "common_path").otherwise("homepage_link").alias("method"))
    return scoring.candidate_score(links, WORDS)


CANDIDATES = f"""{LINKS}, scored as (select page_id, pos, abs_url as url, (case when position('the' in t) > 0 then 16 else 0 end) + (case when position('tion' in t) > 0 then 16 else 0 end) + (case when position('and' in t) > 0 then 16 else 0 end) + case when pos = 0 then 12 else 8 end as score
    from (select *, lower(strip_accents(trim(text) || ' ' || href || ' ' || abs_url)) as t from abs_links) x)"""


@query(f"with {CANDIDATES} select page_id, cast(pos as int) as pos, url, score from scored")
def candidate_scores(spark, d):
    return _candidates(spark, d).select("page_id", "pos", "url", "score")


@query(f"with {CANDIDATES} select page_id, url, score from (select *, row_number() over (partition by page_id order by score desc, pos) as rn from scored) x where rn <= 3")
def candidate_top3(spark, d):
    return windows.top_k(_candidates(spark, d), ["page_id"], [F.desc("score"), "pos"], 3).select("page_id", "url", "score")


@query(f"with {CANDIDATES} select page_id, url, max(score) + cast(least(count(*) - 1, 3) * 8 as int) as score from scored group by 1, 2")
def candidate_repeats(spark, d):
    found = scoring.repeat_boost(_candidates(spark, d)).select("page_id", "url", "score")
    return found.withColumn("score", F.col("score").cast("int"))


@query("""with n as (select page_id, len(regexp_extract_all(html, '<li[ >]')) as li, len(regexp_extract_all(html, '<article[ >]')) as articles, len(regexp_extract_all(html, 'class="[^"]*(?:row|list|post)[^"]*"')) as row_nodes,
    len(list_filter(regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"[^>]*>([^<]*)</a>', 2), lambda x: length(trim(x)) between 18 and 260)) as title_links from v_page)
    select page_id, cast(li as int) as li, cast(articles as int) as articles, cast(row_nodes as int) as row_nodes, cast(title_links as int) as title_links,
    case when li >= 8 then 8 else 0 end + case when articles >= 2 then 8 else 0 end + case when row_nodes >= 3 then 8 else 0 end + case when title_links >= 5 then 10 else 0 end as score from n""")
def list_signals(spark, d):
    return extract.list_signals(view(spark, d, "v_page"))


@query("select page_id, regexp_replace(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '^www\\.', '') as host, regexp_replace(url, '#.*$', '') as plain from v_page")
def page_hosts(spark, d):
    return view(spark, d, "v_page").select("page_id", S.compare_host(F.col("url")).alias("host"), S.normalize_url(F.col("url")).alias("plain"))


SUMMARY = r"list_filter(list_transform(regexp_extract_all(html, '(?is)<p[^>]*>(.*?)</p>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), lambda x: length(x) >= 20)[1]"


@query(f"select page_id, {SUMMARY} as summary, {SUMMARY} is not null as has_summary, page_id % 5 = 0 or regexp_matches(lower(html), 'cf-challenge|just a moment|attention required|captcha') as challenge from v_page")
def page_summaries(spark, d):
    """Every fifth page comes from an address of a challenge."""
    pages = view(spark, d, "v_page").withColumn("url", F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit("/cdn-cgi/l"))).otherwise(F.col("url")))
    summary = extract.page_summary(F.col("html"))
    return pages.select("page_id", summary.alias("summary"), summary.isNotNull().alias("has_summary"), extract.challenge_page(F.col("url"), F.col("html")).alias("challenge"))


# Search

DOCS = "docs as (select i.id, title, summary, name_sq as municipality, name_key as municipality_key, category, cast(year(published_date) as int) as year, source_url, 'm' || cast(municipality_id as varchar) || '.example.al' as source_host, epoch_ms(coalesce(cast(published_date as timestamp), collected_at)) as published_ts, epoch_ms(collected_at) as collected_ts from v_item i join v_m m on m.id = i.municipality_id where status = 'published')"


def _docs(spark, d):
    return search.search_documents(view(spark, d, "v_item"), view(spark, d, "v_m"))


@query(f"with {DOCS} select * from docs")
def search_documents(spark, d):
    return _docs(spark, d)


@query(f"with {DOCS} select id, published_ts from docs where municipality_key = 'nation-2' and category = 'Vendime' and year = 1996 order by published_ts desc, collected_ts desc, id desc limit 20")
def search_filtered(spark, d):
    return search.search_filtered(_docs(spark, d), "nation-2", "Vendime", 1996).select("id", "published_ts")


@query(f"""with {DOCS}, toks as (select id, unnest(string_split(trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')), ' ')) as term, 5 as w from docs union all select id, unnest(string_split(trim(regexp_replace(lower(summary), '[^a-z0-9]+', ' ', 'g')), ' ')), 4 from docs
    union all select id, unnest(string_split(trim(regexp_replace(lower(municipality), '[^a-z0-9]+', ' ', 'g')), ' ')), 3 from docs union all select id, unnest(string_split(trim(regexp_replace(lower(category), '[^a-z0-9]+', ' ', 'g')), ' ')), 2 from docs
    union all select id, unnest(string_split(trim(regexp_replace(lower(source_host), '[^a-z0-9]+', ' ', 'g')), ' ')), 1 from docs), posts as (select term, id, max(w) as w from toks where term <> '' group by 1, 2)
    select id, count(*) as matched, cast(sum(w) as bigint) as weight from posts where term in ('building', 'urgent', '7', 'vendime') group by 1 order by 2 desc, 3 desc, 1 limit 50""")
def search_terms(spark, d):
    return search.term_search(search.inverted(_docs(spark, d)), "Building urgent 7 Vendime")


# Streams: the same tables read as file streams, processed to their end


def _folder(spark) -> str:
    """A new folder in the shared one, for versions, files and checkpoints."""
    return f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"


def table_is_folder(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _stream(spark, d, table):
    path = f"{d}/{table}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 8)
    return reader.parquet(path) if table_is_folder(spark, path) else reader.option("pathGlobFilter", f"{table}.parquet").parquet(d)


ATTEMPT_COLUMNS = [
    "event_id as id", "user_id as source_id", "ts", "event_id % 5 not in (0, 1, 2) as ok", "case event_id % 5 when 0 then 'HTTP_403' when 1 then 'TIMEOUT' when 2 then 'ENOTFOUND' end as error_type",
]


@query("select source_id, strftime(ts, '%Y-%m-%dT%H') as hour, count(*) as attempts, count(*) filter (not ok) as errors from v_attempt group by 1, 2")
def stream_hour_buckets(spark, d):
    at = _folder(spark)
    counts = streams.hour_activity(_stream(spark, d, "events").selectExpr(*ATTEMPT_COLUMNS), "365 days")
    add = lambda target, batch: merges.upsert(batch.limit(0) if target is None else target, batch, ["source_id", "hour"])
    query_ = counts.writeStream.outputMode("update").foreachBatch(streams.versioned_merge(f"{at}/hours", add)).option("checkpointLocation", f"{at}/c").trigger(availableNow=True).start()
    query_.awaitTermination()
    return streams.current(spark, f"{at}/hours")


@query("select id, title, category from (select doc_id as id, text as title, lang as category, row_number() over (partition by source, lang, text order by doc_id) as rn from documents) x where rn = 1")
def stream_ingest(spark, d):
    at = _folder(spark)
    rows = _stream(spark, d, "documents").selectExpr("doc_id as id", "source as municipality_id", "lang as category", "text as title", "cast(null as date) as published_date", "cast(null as string) as source_url", "sha2(text, 256) as dedup_key", "'draft' as status")
    streams.run_available(rows, streams.versioned_merge(f"{at}/items", streams.ingest_documents), f"{at}/c")
    return streams.current(spark, f"{at}/items").select("id", "title", "category")


@query(ORACLE["registry_after_failures"])
def stream_health(spark, d):
    at = _folder(spark)
    streams.run_available(_stream(spark, d, "events").selectExpr(*ATTEMPT_COLUMNS), streams.versioned_merge(f"{at}/state", streams.source_state(_states(spark, d))), f"{at}/c")
    return streams.current(spark, f"{at}/state").withColumn("hours", F.size("hour_buckets").cast("long")).drop("hour_buckets")

