import datetime
import time

import pytest
from pyspark.sql import functions as F

from registra import pipelines
from registra.operators import aggs, extract, joins, merges, predicates, scoring, search, windows
from registra.sources import io
from registra.streaming import streams

D = datetime.date
ITEM = "id long, municipality_id int, category string, title string, published_date date, date_unknown boolean, source_url string, source_origin string, dedup_key string, status string"


def item(i, **k):
    row = dict(id=i, municipality_id=1, category="Vendime", title=f"t{i}", published_date=None, date_unknown=True, source_url=f"u{i}", source_origin="vendime.al", dedup_key=f"k{i}", status="draft") | k
    return tuple(row.values())


def items(spark, *rows):
    return spark.createDataFrame(list(rows), ITEM)


def acts(df):
    return {r.id: r.action for r in df.collect()}


def test_decision_merge(spark):
    target = items(spark, item(1), item(2, source_origin="official.al", published_date=D(2024, 1, 1)), item(3))
    incoming = items(spark, item(11, dedup_key="k1", source_origin="official.al", title="new"), item(12, dedup_key="k2", title="x", published_date=D(2025, 1, 1)), item(13, dedup_key="k3", published_date=D(2024, 5, 5)), item(14))
    out, actions = merges.merge_decisions(target, incoming)
    assert acts(actions) == {11: "updated", 12: "skipped", 13: "updated", 14: "inserted"}
    rows = {r.dedup_key: r for r in out.collect()}
    assert rows["k1"].title == "new" and rows["k2"].title == "t2" and rows["k2"].published_date == D(2024, 1, 1) and rows["k3"].published_date == D(2024, 5, 5) and rows["k3"].title == "t3"
    again = merges.merge_decisions(out, incoming)[1]
    assert set(acts(again).values()) == {"skipped"}


def test_document_merge_never_lowers(spark):
    target = items(spark, item(1, status="published", published_date=D(2024, 1, 1)), item(2))
    incoming = items(spark, item(11, dedup_key="k1", source_url="other", published_date=D(2020, 1, 1)), item(12, dedup_key="new", source_url="u2"))
    out, actions = merges.merge_documents(target, incoming)
    assert acts(actions) == {11: "updated", 12: "skipped"}
    row = {r.dedup_key: r for r in out.collect()}["k1"]
    assert (row.status, row.published_date, row.source_url, row.title) == ("published", D(2024, 1, 1), "u1", "t11")
    out, actions = merges.merge_documents(target, incoming, on_url_conflict="reconcile")
    assert acts(actions) == {11: "updated", 12: "updated"}
    assert set(acts(merges.merge_documents(out, incoming, on_url_conflict="reconcile")[1]).values()) == {"skipped"}


def test_score_overrides(spark):
    cols = ", ".join(f"ind{k}_auto int, ind{k}_final int, ind{k}_overridden boolean" for k in range(1, 6))
    scores = spark.createDataFrame([(1, *[5, 5, False] * 5)], f"municipality_id int, {cols}")
    patches = spark.createDataFrame([(1, 4, "set", 10, "seen"), (1, 2, "set", 7, "odd"), (9, 1, "set", 10, "none"), (1, 1, "set", 10, " ")], "municipality_id int, indicator int, action string, value int, argument string")
    out, rejected = merges.override_scores(scores, patches)
    assert out.first().ind4_final == 10 and out.first().ind4_overridden and out.first().ind2_final == 5 and rejected.count() == 3
    fresh = scores.withColumn("ind4_auto", F.lit(0))
    kept = merges.upsert_scores(out, fresh).first()
    assert (kept.ind4_final, kept.ind4_auto) == (10, 0)
    cleared, _ = merges.override_scores(out, spark.createDataFrame([(1, 4, "clear", None, None)], patches.schema))
    assert cleared.first().ind4_final is None and merges.upsert_scores(cleared, fresh).first().ind4_final == 0


def test_automatic_total_is_weak_at_most(spark):
    cols = ", ".join(f"ind{k}_auto int, ind{k}_final int" for k in range(1, 6))
    s = spark.createDataFrame([(1, 10, None, 10, None, 10, None, 0, None, 10, None)], f"municipality_id int, {cols}")
    assert scoring.effective_scores(s).select("total", "tier").first() == (40, "Weak")


def test_authorities(spark):
    m = spark.createDataFrame([(1, "Tiranë", "tirane"), (2, "Korçë", "korce"), (3, "Fier", "fier")], "id int, name_sq string, name_key string")
    alias = spark.createDataFrame([("tirana", 1)], "alias_key string, municipality_id int")
    names = ["Bashkia Tiranë", "Bashkia e Tiranës", "Municipality of Fier", "Ministria Tiranë", "", "Qendra e Artit dhe e Kultures Korçë", "Ndërmarrja Rruga Fier", "Ndermarrja Rruga Fier Korce", "Ndermarrja Rruga X", "Bashkia Fierza", None]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, authority string")
    got = {r.id: (r.municipality_id, r.reason) for r in joins.match_authorities(rows, joins.authority_terms(m, alias)).collect()}
    assert got == {
        0: (1, "matched_bashkia"), 1: (1, "matched_bashkia"), 2: (3, "matched_municipality_of"), 3: (None, "missing_municipality_marker"), 4: (None, "missing_authority"), 5: (2, "exact_override"),
        6: (3, "matched_operator_suffix"), 7: (2, "matched_operator_suffix"), 8: (None, "operator_suffix_not_unique"), 9: (None, "unclear_authority_name"), 10: (None, "missing_authority"),
    }


def test_export_source(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text('﻿"Autoriteti Kontraktor","Objekti i Kontratës","Data e publikimit","Vlera e fondit","Link"\n"Bashkia Fier","Rrugë, faza 1","31/12/2025","1.000,50",""\n"X","","2025-01-02","","https://a.al/1"\n', encoding="utf-8")
    df = io.read_export(spark, str(path))
    got = predicates.procurement_items(df, "https://a.al/e.csv").orderBy("row_index").collect()
    assert [(r.title, r.published_date, r.authority, r.source_url) for r in got] == [("Rrugë, faza 1", D(2025, 12, 31), "Bashkia Fier", "https://a.al/e.csv"), ("Procurement row 2", D(2025, 1, 2), "X", "https://a.al/1")]
    assert [str(r.amount_value) for r in predicates.procurement_records(df).orderBy("row_index").collect()] == ["1000.50", "None"]
    semi = tmp_path / "s.csv"
    semi.write_text("a;b\n1;2,3\n", encoding="utf-8")
    assert io.read_export(spark, str(semi)).first()["b"] == "2,3"
    ragged = tmp_path / "r.csv"
    ragged.write_text("a,b\n1\n", encoding="utf-8")
    with pytest.raises(Exception):
        io.read_export(spark, str(ragged)).collect()
    empty = tmp_path / "n.csv"
    empty.write_text("\n", encoding="utf-8")
    with pytest.raises(ValueError):
        io.read_export(spark, str(empty))


def test_pages(spark):
    html = """<a href="/a.pdf">Akti nr 5</a><iframe src="/viewer?file=https%3A%2F%2Fx.al%2Fb.pdf"></iframe><a onclick="window.open('/c.docx')">c</a>
      <table><tr><th>Nr</th><th>Data</th><th>Titulli</th></tr><tr><td>12</td><td>3.4.2024</td><td><a href="/d.html">Vendim per buxhetin</a></td></tr></table>
      <script type="application/ld+json">{"@graph":[{"headline":"H","datePublished":"2024-05-06T10:00:00"}]}</script><p>short</p><p>A paragraph that is long enough.</p><a href="?page=3">3</a><a href="?page=2">2</a>"""
    pages = spark.createDataFrame([(1, "https://x.al/list", html), (2, "https://x.al/raw", "see https://x.al/raw.pdf here"), (3, "https://x.al/e", None)], "page_id long, url string, html string")
    docs = {(r.page_id, r.branch, r.url) for r in extract.document_links(pages).collect()}
    assert docs == {(1, 0, "https://x.al/a.pdf"), (1, 1, "https://x.al/b.pdf"), (1, 4, "https://x.al/c.docx"), (2, 5, "https://x.al/raw.pdf")}
    rows = [(r.title, r.href, r.date) for r in extract.table_rows(pages).orderBy("row").collect()]
    assert rows[-1] == ("Vendim per buxhetin", "https://x.al/d.html", D(2024, 4, 3))
    assert [tuple(r) for r in extract.json_ld(pages.withColumn("html", F.regexp_replace("html", r'json">\{', 'json">[{')).withColumn("html", F.regexp_replace("html", r"\}\]\}</script>", "}]}]</script>"))).collect()] == [(1, "H", D(2024, 5, 6))]
    assert extract.next_page(pages).where("page_id = 1").first().next_url == "https://x.al/list?page=2"
    assert pages.where("page_id = 1").select(extract.page_summary(F.col("html"))).first()[0] == "A paragraph that is long enough."
    profile = spark.createDataFrame([("x.al", None, 0, 1, 2, "Vendim nr. {number}", 2000, "decision")], "host string, path_pattern string, number_cell int, date_cell int, title_cell int, title_template string, year_floor int, kind string")
    good, bad = extract.profile_items(pages, profile)
    assert [(r.number, r.title, r.published_date) for r in good.collect()] == [("12", "Vendim nr. 12", D(2024, 4, 3))] and [r.reason for r in bad.collect()] == ["missing_number"]
    year = spark.createDataFrame([(1, "https://x.al/", '<a href="/e2025.csv">CSV 2025</a><a href="/e2024.csv">CSV 2024</a>'), (2, "https://x.al/", '<a href="/export.csv">CSV</a>')], "page_id long, url string, html string")
    assert [(r.page_id, r.abs_url, r.score) for r in extract.year_export_link(year, 2025).collect()] == [(1, "https://x.al/e2025.csv", 360)]


def test_windows(spark):
    df = spark.createDataFrame([(1, "a", 2), (2, "a", 1), (3, None, 1), (4, None, 0)], "id int, k string, o int")
    assert sorted(r.id for r in windows.keep_first(df, ["k"], ["o"]).collect()) == [2, 4]
    assert [r.id for r in windows.row_window(df.withColumnRenamed("id", "row_index"), 2, 2).select(F.col("row_index").alias("id")).collect()] == [2, 3]


def test_parameters():
    predicates.check_parameters(2, 50, year=2024, key="vau-i-dejes", top=5, sort="newest", q="x")
    for bad in (dict(page=0), dict(limit=101), dict(year=1999), dict(key="A b"), dict(top=21), dict(sort="up"), dict(q="x" * 121)):
        with pytest.raises(ValueError):
            predicates.check_parameters(**bad)


def test_batches_take_effect_once(spark, tmp_path):
    calls = []
    add = lambda target, batch: (calls.append(1), batch if target is None else target.unionByName(batch))[1]
    run = streams.versioned_merge(str(tmp_path / "t"), add)
    batch = spark.createDataFrame([(1,)], "x int")
    run(batch, 0)
    run(batch, 0)
    run(batch, 1)
    assert streams.current(spark, str(tmp_path / "t")).count() == 2 and len(calls) == 2
    run(batch, 2)
    assert streams.current(spark, str(tmp_path / "t")).count() == 3 and streams.versions(spark, str(tmp_path / "t")) == [2, 3]


def test_late_attempts_are_dropped(spark, tmp_path):
    def at(hour, minute):
        return datetime.datetime(2024, 1, 1, hour, minute)

    schema = "id long, source_id long, ts timestamp, ok boolean"
    batches = [[(1, 7, at(10, 0), True), (2, 7, at(13, 5), False)], [(3, 7, at(9, 0), True), (4, 7, at(13, 30), True)], [(5, 7, at(10, 30), True), (6, 7, at(12, 40), True)]]
    for rows in batches:  # the file source takes older files first
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = streams.hour_activity(stream, "1 hour")
    add = lambda target, batch: merges.upsert(batch.limit(0) if target is None else target, batch, ["source_id", "hour"])
    query = counts.writeStream.outputMode("update").foreachBatch(streams.versioned_merge(str(tmp_path / "t"), add)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.hour: (r.attempts, r.errors) for r in streams.current(spark, str(tmp_path / "t")).collect()}
    # the first batch moves the watermark to 12:05; the third one drops 10:30 by it, as its hour is over, and takes 12:40
    assert got == {"2024-01-01T10": (1, 0), "2024-01-01T13": (2, 1), "2024-01-01T09": (1, 0), "2024-01-01T12": (1, 0)}


def test_exports_of_many_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(4):
        sep = ";" if k % 2 else ","
        (folder / f"f{k}.csv").write_text(f"Titulli{sep}Vlera\n" + "".join(f"t{k}-{i}{sep}{i}\n" for i in range(10)), encoding="utf-8")
    for multiline in (True, False):
        rows = io.read_export(spark, str(folder), multiline).orderBy("row_index").collect()
        assert [r.row_index for r in rows] == list(range(40)) and {r.Titulli for r in rows} == {f"t{k}-{i}" for k in range(4) for i in range(10)}
    parts = [windows.row_window(io.read_export(spark, str(folder)), o, 10).count() for o in (0, 10, 20, 30, 40)]
    assert parts == [10, 10, 10, 10, 0]


def test_long_terms_and_folded_queries(spark):
    name = "Njesia e re e qytetit te vogel prane lumit te madh"
    m = spark.createDataFrame([(1, name, "njesia")], "id int, name_sq string, name_key string")
    alias = spark.createDataFrame([], "alias_key string, municipality_id int")
    rows = spark.createDataFrame([(1, f"Bashkia {name}")], "id int, authority string")
    terms = joins.authority_terms(m, alias)
    assert joins.match_authorities(rows, terms).first().municipality_id == 1 and joins.mention_gap(rows, terms).first().mentions == 1
    postings = spark.createDataFrame([("keshilli", 1, 5), ("bashkiak", 1, 5), ("tjeter", 2, 5)], "term string, id long, weight int")
    assert [(r.id, r.matched) for r in search.term_search(postings, "Këshilli, BASHKIAK").collect()] == [(1, 2)]


def test_records_without_exports(spark):
    items = spark.createDataFrame([(1, "https://x.app.gov.al/GetData/ExportDocument?a#procedure=R-1", None, None, "t"), (2, "https://x.al/", None, None, "t"), (3, None, None, None, None), (4, "https://x.app.gov.al/GetData/ExportDocument?b", None, None, "t")], "id long, source_url string, procedure_id string, published_date date, title string")
    rows = spark.createDataFrame([("https://x.app.gov.al/GetData/ExportDocument?a", 0, "R-1", "R-1", None, "t", None)], "export_url string, row_index long, procedure_id string, procedure_ref string, published_date date, title string, amount_value decimal(18,2)")
    rejects = spark.createDataFrame([("https://x.app.gov.al/GetData/ExportDocument?b", "export_not_csv")], "export_url string, reason string")
    records = spark.createDataFrame([], "item_id long, amount_value decimal(18,2), procedure_ref string, source_export_url string")
    done, status = pipelines.rebuild_records(items, rows, rejects, records)
    assert {r.id: r.reason for r in status.collect()} == {1: "record_upserted_amount_null", 2: "source_not_exportdocument", 3: "source_not_exportdocument", 4: "export_not_csv"}
    assert [(r.item_id, r.procedure_ref) for r in done.collect()] == [(1, "R-1")]


def test_run_log_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(datetime.datetime(2026, 2, 14, 19, 30), "Fier", "1", "OK", 5, 4, 3, 1, None, "u", 12, 200, None)], io.RUN_LOG)
    io.write_run_log(rows, str(tmp_path / "log"))
    assert io.read_run_log(spark, str(tmp_path / "log")).collect() == rows.collect()


def test_attachments_source(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"no pdf")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-" + b"x" * 100)
    got = {r.path[-5:]: (r.type, r.accepted) for r in io.read_attachments(spark, str(tmp_path), cap=50).collect()}
    assert got == {"a.pdf": ("pdf", True), "b.pdf": (None, False), "c.pdf": (None, False)}


NAMES = ["Cërrik", "Çorovodë", "Devoll", "Dibër", "Durrës", "Dhërmi", "Elbasan", "Ëmbël", "Gramsh", "Gjirokastër", "Xarrë", "Xhafzotaj", "Zogaj"]


def test_albanian_order_and_lookup(spark):
    m = spark.createDataFrame([((7 * k) % 13, n, f"k{k}", "c", k % 2) for k, n in enumerate(NAMES)], "id int, name_sq string, name_key string, county string, total int")
    assert [r.name_sq for r in windows.municipality_list(m, "sq").collect()] == NAMES
    assert [r.name_sq for r in windows.score_table(m, collation="sq").collect()] == NAMES[1::2] + NAMES[::2]
    assert [r.name_sq for r in windows.score_table(m, "name_sq", False, "sq").collect()] == NAMES
    asked = spark.createDataFrame([("DURRES",), ("emBEL",), ("Durrësi",), (None,), ("DURRES",)], "name string")
    assert {r.name: r.municipality_id for r in joins.resolve_names(asked, m).collect()} == {"DURRES": 28 % 13, "emBEL": 49 % 13, "Durrësi": None, None: None}


def test_observed_counters(spark, tmp_path):
    """The job that writes rows counts them: the same numbers as a second reading gives."""
    seen = spark.createDataFrame([(None, "primary"), (None, None), ("wrong_year", "operator_suffix"), ("missing_date", "exact_override")], "skip_reason string, match_mode string")
    actions = spark.createDataFrame([("inserted",), ("skipped",), ("inserted",)], "action string")
    counts = []
    for rows, seen_by in (aggs.observed_rows(seen), aggs.observed_actions(actions), aggs.observed_actions(actions.limit(0))):
        rows.write.mode("overwrite").parquet(str(tmp_path / "x"))
        counts.append(seen_by.get)
    assert counts[0] | counts[1] == aggs.ingest_counters(seen, actions).first().asDict()
    assert counts[2] == {"inserted": 0, "updated": 0, "skipped": 0}
