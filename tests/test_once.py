"""Shared values of page jobs are computed once, and texts without marks aren't folded letter by letter."""

import re

from pyspark.sql import functions as F

from registra import pipelines
from registra.functions import scalars as S
from registra.operators import extract, joins, merges

PAGE = '<h1>Vendim 3.4.2024</h1><table><tr><td>1</td><td>03.04.2024</td><td>Vendim i gjate</td><td><a href="/a.pdf">x</a></td></tr></table><a href="b?x=1">Vendim</a>'


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def searches(df, pattern: str) -> int:
    return len(re.findall(pattern, plan_of(df)))


def pages(spark):
    return spark.createDataFrame([(1, "https://x.al/l/1", PAGE)], "page_id long, url string, html string")


def test_links_are_resolved_once(spark):
    """A filter on the absolute URL repeats neither the search for anchors nor the joining of URLs."""
    links = extract.anchors(pages(spark)).where("abs_url is not null")
    assert searches(links, "mailto:") == 1
    assert [r.abs_url for r in links.orderBy("pos").collect()] == ["https://x.al/a.pdf", "https://x.al/l/b?x=1"]


def test_pages_are_read_once(spark):
    """Items, years, dates and listing rows read their pages once, without meeting them again."""
    p = pages(spark).repartition(2)
    profile = spark.createDataFrame([("x.al", None, 0, 1, 2, None, 2000, "decision")], "host string, path_pattern string, number_cell int, date_cell int, title_cell int, title_template string, year_floor int, kind string")
    for found in (extract.post_items(p), extract.year_categories(p, 2024), extract.profile_items(p, profile)[0], extract.document_links(p)):
        assert plan_of(found).count("Repartition") == 1
    assert [(r.number, str(r.published_date), r.source_url) for r in extract.profile_items(p, profile)[0].collect()] == [("1", "2024-04-03", "https://x.al/a.pdf")]


def test_fold_beyond_ascii(spark):
    texts = ["plain", "Çorovodë", "ë", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(S.fold(F.col("t")).alias("f"), S.fold_text(F.col("t")).alias("x")).collect()
    assert [r.f for r in rows] == ["plain", "Corovode", "e", "", None]
    assert [r.x for r in rows] == ["plain", "corovode", "e", "", ""]


def test_dates_are_searched_once(spark):
    df = spark.createDataFrame([("am 03.04.24",)], "t string").where(S.numeric_date(F.col("t")).isNotNull())
    assert df.count() == 1 and len(re.findall(r"regexp_extract\(t#", plan_of(df))) == 1


def marked(df, column: str):
    """df with a filter that keeps all rows and is found in plans."""
    return df.where(~F.coalesce(F.col(column), F.lit("")).rlike("only-once"))


def test_merges_read_incoming_rows_once(spark):
    """Conflicts, duplicates and skipped rows are marked in one pass over the incoming rows."""
    item = "id long, municipality_id long, category string, dedup_key string, title string, published_date date, source_url string, status string"
    target = spark.createDataFrame([(1, 1, "a", "k1", "old", None, "u1", "draft")], item)
    new = [(2, 1, "a", "k2", "x", None, "u1", "draft"), (3, 1, "a", "k3", "y", None, "u2", "draft"), (4, 1, "a", "k4", "z", None, "u2", "draft"), (5, 1, "a", "k1", "new", None, None, "draft")]
    incoming = marked(spark.createDataFrame(new, item), "title")
    for conflict, second in (("skip", "skipped"), ("reconcile", "updated")):
        out, actions = merges.merge_documents(target, incoming, on_url_conflict=conflict)
        assert searches(out, "only-once") == searches(actions, "only-once") == 1
        assert dict(actions.collect())[2] == second and dict(actions.collect())[4] == "skipped" and out.count() == 2
    done = merges.upsert(target, incoming, ["id"])
    assert searches(done, "only-once") == 1 and done.count() == 5


def test_authorities_are_matched_by_distinct_name(spark):
    """Names meet the terms once each: rows are read for their distinct names and to take the outcome."""
    m = spark.createDataFrame([(1, "Fier", "fier")], "id long, name_sq string, name_key string")
    terms = joins.authority_terms(m, spark.createDataFrame([], "alias_key string, municipality_id long"))
    rows = spark.createDataFrame([(1, "Bashkia Fier"), (2, "Bashkia Fier"), (3, None), (4, "else")], "id long, authority string")
    found = joins.match_authorities(marked(rows, "authority"), terms)
    assert "Aggregate [authority" in plan_of(found)
    assert {r.id: (r.municipality_id, r.reason) for r in found.collect()} == {1: (1, "matched_bashkia"), 2: (1, "matched_bashkia"), 3: (None, "missing_authority"), 4: (None, "missing_municipality_marker")}


def test_rebuild_reads_items_once(spark):
    """Items keep their columns through the match, and rows their fields, so neither is met again."""
    page = "https://data.app.gov.al/GetData/ExportDocument?f=0"
    items = spark.createDataFrame([(1, page, "P1", None, "t"), (2, "https://x.al/1", None, None, "t"), (3, page, None, None, "t")], "id long, source_url string, procedure_id string, published_date date, title string")
    rows = spark.createDataFrame([(page, 7, "P1", "P1", None, "t", 5)], "export_url string, row_index long, procedure_id string, procedure_ref string, published_date date, title string, amount_value long")
    records, report = pipelines.rebuild_records(marked(items, "title"), rows, spark.createDataFrame([], "export_url string, reason string"), spark.createDataFrame([(1, 9, None), (2, 8, None)], "item_id long, amount_value long, procedure_ref string"))
    assert searches(records, "only-once") == searches(report, "only-once") == 1
    assert {r.item_id: r.amount_value for r in records.collect()} == {1: 5, 2: 8}
    assert {r.id: (r.status, r.reason) for r in report.collect()} == {1: ("upserted", "record_upserted"), 2: ("skipped", "source_not_exportdocument"), 3: ("skipped", "missing_fallback_identifiers")}


def test_streamed_rows_are_computed_once(spark, tmp_path):
    from registra.plans.incremental import as_stream

    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    as_stream(spark.range(100).mapInArrow(counted, "id long"), "id", str(tmp_path / "in"), 4)
    assert seen.value == 100


def test_source_state_takes_rows_in_any_order():
    """One event at a time, without a table for each source."""
    from types import SimpleNamespace

    from pyspark.sql import Row

    from registra.streaming import health

    held = {}
    state = SimpleNamespace(get=lambda: held.get("x"), update=lambda v: held.update(x=v))
    handle = SimpleNamespace(getValueState=lambda *_: state, registerTimer=lambda t: None, deleteTimer=lambda t: None)
    at = health.SourceState(10, 1)
    at.init(handle)
    events = [Row(ts=30, id=3, ok=False, error_type="ENOTFOUND", hour="h1"), Row(ts=10, id=1, ok=True, error_type=None, hour="h0"), Row(ts=20, id=2, ok=False, error_type="HTTP_403", hour="h0")]
    (out,) = at.handleInputRows((5,), iter(events), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0))
    assert (out.source_id, out.attempt_count, out.first_seen, out.last_checked, out.last_seen, out.last_error_type, out.homepage_status, out.hour_buckets) == (5, 3, 10, 30, 10, "ENOTFOUND", "BLOCKED", ["h0", "h1"])
