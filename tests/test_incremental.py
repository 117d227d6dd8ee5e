"""Bucketed tables, source state by event, coverage from changes, deep pages and trigram postings against whole-table results."""

import random
import re
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from registra.operators import aggs, cells, merges, paging, predicates, trigrams, windows
from registra.streaming import buckets, health, streams

ITEM = "id bigint, municipality_id bigint, category string, title string, published_date date, source_url string, source_origin string, dedup_key string, status string"


def docs(spark, rows):
    """(id, key, title, url) rows, some with a date."""
    full = [(i, i % 3 if k is None else hash(k) % 3, "Vendime", t, None, u, "o", k, "draft") for i, k, t, u in rows]
    return spark.createDataFrame([(i, 1, c, t, d, u, o, k, s) for i, _, c, t, d, u, o, k, s in full], ITEM)


def rows_of(df):
    return sorted(map(str, df.collect()))


def batches(seed):
    """Batches of rows whose keys and URLs meet stored ones and each other's."""
    some = random.Random(seed)
    out = []
    for b in range(4):
        out.append([(100 * b + i, f"k{some.randrange(25)}", f"t{some.randrange(4)}", some.choice([None, f"u{some.randrange(25)}"])) for i in range(12)])
    return out


@pytest.mark.parametrize("on_url_conflict", ["skip", "reconcile"])
def test_bucket_merges_equal_whole_merges(spark, tmp_path, on_url_conflict):
    """After each batch, items are those of a merge into the whole table, and addresses are those of the items."""
    path = str(tmp_path / "t")
    whole = docs(spark, [])
    buckets.create_items(spark, path, whole.schema, 16)
    run = buckets.ingest(path, on_url_conflict=on_url_conflict)
    for b, rows in enumerate(batches(3)):
        batch = docs(spark, rows)
        whole = spark.createDataFrame(merges.merge_documents(whole, batch, on_url_conflict=on_url_conflict)[0].collect(), whole.schema)
        run(batch, b)
        now = buckets.snapshot(spark, path)
        assert now.batch == b
        assert rows_of(now.read(spark, buckets.ITEMS).select(whole.columns)) == rows_of(whole)
        assert rows_of(now.read(spark, buckets.ADDRESSES)) == rows_of(whole.where("source_url is not null").select(*buckets.ADDRESS))


def written_buckets(path, batch):
    return [p.name for p in path.glob(f"data/*/v={batch}/bucket=*")]


def test_a_small_batch_writes_few_buckets(spark, tmp_path):
    """Ten rows change at most ten buckets of each table of 64; the same rows again change none; a batch runs once."""
    path = tmp_path / "t"
    buckets.create_items(spark, str(path), docs(spark, []).schema, 64)
    run = buckets.ingest(str(path))
    run(docs(spark, [(i, f"k{i}", "t", f"u{i}") for i in range(500)]), 0)
    few = docs(spark, [(900 + i, f"n{i}" if i < 5 else f"k{i}", "other", f"w{i}") for i in range(10)])
    run(few, 1)
    assert 0 < len(written_buckets(path, 1)) <= 20
    assert buckets.snapshot(spark, str(path)).counters == {"inserted": 5, "updated": 5, "skipped": 0}
    before = rows_of(buckets.snapshot(spark, str(path)).read(spark, buckets.ITEMS))
    run(few, 1)
    assert buckets.snapshot(spark, str(path)).batch == 1
    run(few, 2)
    assert written_buckets(path, 2) == [] and buckets.snapshot(spark, str(path)).batch == 2
    assert buckets.snapshot(spark, str(path)).counters == {"inserted": 0, "updated": 0, "skipped": 10}
    assert rows_of(buckets.snapshot(spark, str(path)).read(spark, buckets.ITEMS)) == before and len(before) == 505
    run(docs(spark, []), 3)
    assert rows_of(buckets.snapshot(spark, str(path)).read(spark, buckets.ITEMS)) == before


RECORDS, SCORES = "item_id bigint, amount_value int", "municipality_id bigint, ind1_auto int, ind1_final int, ind1_overridden boolean"


def test_tables_of_a_batch_change_together(spark, tmp_path, monkeypatch):
    """A batch that is lost after one table is written leaves all as they were; run again, it changes items, records and
    scores under one number."""
    path, record = str(tmp_path / "t"), docs(spark, [(1, "k1", "a", "u1"), (2, "k2", "b", None), (3, "k1", "a", "u1")]).withColumn("amount_value", F.col("id").cast("int"))
    empty = spark.createDataFrame([], SCORES)
    buckets.create_register(spark, path, docs(spark, []).schema, spark.createDataFrame([], RECORDS).schema, empty.schema, 8)
    fresh = lambda batch, now, change: change.after.groupBy("municipality_id").agg(F.count("*").cast("int").alias("ind1_auto")).select("municipality_id", "ind1_auto", F.col("ind1_auto").alias("ind1_final"), F.lit(False).alias("ind1_overridden"))
    monkeypatch.setattr(merges, "upsert_scores", lambda target, rows, real=merges.upsert_scores: real(target, rows, 1))
    run = buckets.register(path, fresh)
    real, calls = buckets._publish, []

    def lost(spark, made):
        calls.append(made.batch)
        raise RuntimeError("lost")

    monkeypatch.setattr(buckets, "_publish", lost)
    with pytest.raises(RuntimeError):
        run(record, 0)
    monkeypatch.setattr(buckets, "_publish", real)
    now = buckets.snapshot(spark, path)
    assert calls == [0] and now.batch == -1 and written_buckets(tmp_path / "t", 0)
    assert [now.read(spark, t).count() for t in ("items", "addresses", "records", "scores")] == [0, 0, 0, 0]
    run(record, 0)
    now = buckets.snapshot(spark, path)
    assert [now.read(spark, t).count() for t in ("items", "addresses", "records", "scores")] == [2, 1, 2, 1]
    assert rows_of(now.read(spark, "scores")) == ["Row(municipality_id=1, ind1_auto=2, ind1_final=2, ind1_overridden=False)"]


def test_a_batch_is_not_held_in_memory(spark, tmp_path):
    """What a batch reads again comes from files, also for more tables, and the files go with the batch, done or lost."""
    path, seen = tmp_path / "t", []
    buckets.create_items(spark, str(path), docs(spark, []).schema, 4)

    def each(batch, batch_id, now, change):
        seen.append([df._jdf.queryExecution().executedPlan().toString() for df in (batch, change.after, change.actions)])
        if len(seen) == 2:
            raise RuntimeError("lost")
        return {}

    run = buckets.ingest(str(path), each=each)
    untyped = docs(spark, [(1, "k1", "a", "u1"), (2, "k2", "b", None)]).withColumns({"published_date": F.lit(None), "more": F.lit(None)})
    run(untyped, 0)
    with pytest.raises(RuntimeError):
        run(docs(spark, [(3, "k3", "c", "u3")]), 1)
    assert len(seen) == 2 and not [p for plans in seen for p in plans if "InMemoryTableScan" in p]
    assert [p for p in path.rglob("*.parquet") if "work" in p.parts] == []
    assert buckets.snapshot(spark, str(path)).read(spark, buckets.ITEMS).count() == 2


def test_writers_of_large_buckets_hold_small_row_groups(spark, tmp_path, monkeypatch):
    """A writer's memory is one row group, whatever a bucket holds."""
    monkeypatch.setattr(buckets, "ROW_GROUP", 1 << 18, raising=False)
    path = tmp_path / "t"
    buckets.create_items(spark, str(path), docs(spark, []).schema, 1)
    rows = spark.range(40_000).selectExpr("id", "1L as municipality_id", "'c' as category", "sha2(string(id), 256) as title", "cast(null as date) as published_date", "sha2(string(-id), 256) as source_url", "'o' as source_origin", "string(id) as dedup_key", "'draft' as status")
    buckets.ingest(str(path))(rows, 0)
    files = [pq.ParquetFile(p).metadata for p in path.glob("data/items/v=0/bucket=*/*.parquet")]
    assert sum(f.num_rows for f in files) == 40_000
    assert max(f.row_group(k).total_byte_size for f in files for k in range(f.num_row_groups)) < 1 << 19


def test_the_last_record_of_a_key_wins_in_shuffled_joins(spark, tmp_path):
    path, n = str(tmp_path / "t"), 3000
    buckets.create_register(spark, path, docs(spark, []).schema, spark.createDataFrame([], RECORDS).schema, spark.createDataFrame([], SCORES).schema, 4)
    rows = spark.range(0, n, 1, 7).selectExpr("id", "1L as municipality_id", "'c' as category", "'t' as title", "cast(null as date) as published_date", "cast(null as string) as source_url", "'o' as source_origin", "string(id % 5) as dedup_key", "'draft' as status", "int(id) as amount_value")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        buckets.register(path)(rows, 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    found = buckets.snapshot(spark, path).read(spark, "records").collect()
    assert sorted(map(tuple, found)) == [(k, n - 5 + k) for k in range(5)]


def test_old_buckets_go(spark, tmp_path):
    path = tmp_path / "t"
    buckets.create_items(spark, str(path), docs(spark, []).schema, 4)
    run = buckets.ingest(str(path))
    for b in range(5):
        run(docs(spark, [(1, "k", f"title {b}", None), (10 + b, f"own {b}", "t", None)]), b)
    now = buckets.snapshot(spark, str(path))
    held = {(t, v, k) for t, x in now.tables.items() for k, v in x["held"].items()}
    left = {(p.parts[-3], int(p.parts[-2][2:]), p.name[7:]) for p in path.glob("data/*/v=*/bucket=*")}
    assert held <= left and len(left - held) <= 2  # what the commit before the last holds
    assert now.read(spark, buckets.ITEMS).where("id = 1").first().title == "title 4" and now.read(spark, buckets.ITEMS).count() == 6


def test_repeated_deliveries_are_dropped_within_the_watermark(spark, tmp_path):
    rows = spark.createDataFrame([(1, "k1", "2024-01-01 00:00:00"), (2, "k1", "2024-01-01 00:00:01"), (3, "k2", "2024-01-01 00:00:02")], "id int, k string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    for i in range(3):
        rows.where(F.col("id") == i + 1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    streams.run_available(buckets.once_within(stream, "ts", "1 hour", ["k"]), lambda b, k: seen.extend(r.id for r in b.collect()), str(tmp_path / "c"))
    assert seen == [1, 3]


# Source state


def test_source_changes(spark, tmp_path):
    """Out-of-order and late attempts, cooldowns that end by timer, a registry with and without earlier state."""
    registry = spark.createDataFrame(
        [(1, 3, "2023-01-01 00:00:00", "OK", ["2023-01-01T00"]), (2, 0, None, None, []), (3, 7, None, "DOWN", [])], "source_id bigint, attempt_count bigint, first_seen string, homepage_status string, hour_buckets array<string>"
    )
    none = F.lit(None).cast("timestamp")
    registry = registry.withColumn("first_seen", F.col("first_seen").cast("timestamp")).withColumns({"last_checked": none, "last_seen": none, "cooldown_until": none, "last_error_type": F.lit(None).cast("string")})
    kinds = "source_id bigint, id bigint, ts string, ok boolean, error_type string"
    arrivals = [
        [(1, 1, "2024-01-01 10:00:00", False, "HTTP_403"), (2, 2, "2024-01-01 10:10:00", False, "TIMEOUT"), (2, 3, "2024-01-01 10:12:00", True, None)],
        [(1, 4, "2024-01-01 11:30:00", False, "TIMEOUT"), (2, 5, "2024-01-01 09:50:00", False, "HTTP_403")],  # the last one is older than its source's
        [(2, 6, "2024-01-01 14:00:00", False, "ENOTFOUND")],
        [(1, 7, "2024-01-01 10:30:00", True, None), (3, 8, "2024-01-01 18:00:00", True, None)],  # the first is too late by now
    ]
    for rows in arrivals:
        spark.createDataFrame(rows, kinds).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with health.rocksdb(spark):
        changes = health.source_changes(stream, registry, "1 hour")
        streams.run_available(changes, lambda b, k: b.write.mode("overwrite").parquet(str(tmp_path / f"out/batch={k}")), str(tmp_path / "c"))
    got = spark.read.schema(changes.schema).parquet(str(tmp_path / "out"))
    kept = spark.createDataFrame([r for rows in arrivals for r in rows if r[1] != 7], kinds).withColumn("ts", F.col("ts").cast("timestamp"))
    want = merges.apply_attempts(registry, kept)
    for a, b in zip(rows_of(health.latest_state(got, registry).select(want.columns)), rows_of(want), strict=True):
        assert a == b
    over = [(r.source_id, str(r.at), r.cooling) for r in got.where("event = 'cooldown_over'").orderBy("at").collect()]
    assert over == [(1, "2024-01-01 12:00:00", False), (2, "2024-01-01 14:30:00", False)]
    first = got.where("event = 'attempt' and source_id = 1").orderBy("attempt_count").collect()
    assert [(r.attempt_count, r.cooling, str(r.cooldown_until)) for r in first] == [(4, True, "2024-01-08 10:00:00"), (5, True, "2024-01-01 12:00:00")]


# Coverage


def items_at(spark, rows):
    return spark.createDataFrame(rows, "id bigint, municipality_id bigint, category string, status string, published_date string, collected_at string").withColumns({c: F.col(c).cast("timestamp") for c in ("published_date", "collected_at")})


@pytest.mark.parametrize("seed", [1, 2])
def test_coverage_from_changes(spark, seed):
    """After every batch of changes the cells are those of the whole tables."""
    some = random.Random(seed)
    row = lambda i: (i, some.randrange(3), some.choice(["Vendime", "Prokurime"]), some.choice(["published", "draft", "archived"]), some.choice([None, f"2024-01-0{some.randint(1, 9)}"]), f"2024-02-0{some.randint(1, 9)}")
    rows = {i: row(i) for i in range(25)}
    files = {100 + k: (100 + k, some.randrange(25), f"2024-03-0{some.randint(1, 9)}") for k in range(30)}
    table = lambda: (items_at(spark, list(rows.values())), spark.createDataFrame(list(files.values()), "id bigint, item_id bigint, created_at string"))
    items, attachments = table()
    state = spark.createDataFrame(cells.cells(items, attachments).collect(), cells.cells(items, attachments).schema)
    for _ in range(3):
        touched = set(some.sample(sorted(rows), min(5, len(rows))))
        for i in touched:
            rows[i] = row(i)
        for i in some.sample(sorted(rows), 3):
            touched.add(i)
            del rows[i]
        new = max(rows) + 50
        rows[new] = row(new)
        owner = some.choice(sorted(rows))
        files[new + 100] = (new + 100, owner, "2024-03-09")
        touched |= {new, owner}
        own = lambda t, c: t.where(F.col(c).isin(sorted(touched)))
        after, attachments_after = table()
        done = cells.apply_changes(state, own(items, "id"), own(after, "id"), own(attachments, "item_id"), own(attachments_after, "item_id"))
        state = cells.refreshed(spark.createDataFrame(done.collect(), done.schema), after, attachments_after)
        state = spark.createDataFrame(state.collect(), state.schema)
        whole = cells.cells(after, attachments_after)
        assert rows_of(state.where("latest_collected is not null").select(whole.columns)) == rows_of(whole)
        items, attachments = after, attachments_after
    want = aggs.consultation_counts(items.withColumn("category", F.lit("Konsultime publike")), attachments)
    got = cells.consultation_counts(cells.cells(items.withColumn("category", F.lit("Konsultime publike")), attachments))
    assert rows_of(got) == rows_of(want)


def test_changed_rows(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "id int, t string"), spark.createDataFrame([(2, "z"), (1, "x"), (3, None)], "id int, t string")
    assert [rows_of(x) for x in cells.changed_rows(a, b)] == [["Row(id=2, t='y')"], ["Row(id=2, t='z')", "Row(id=3, t=None)"]]


# Pages


def test_deep_pages(spark, tmp_path):
    """Every page equals that of the whole order; the plan of a page names few of the folders."""
    rows = [(i, None if i % 7 == 0 else f"2024-01-{i % 28 + 1:02d}", f"2024-02-{i % 5 + 1:02d} 00:00:00") for i in range(503)]
    items = spark.createDataFrame(rows, "id int, published_date string, collected_at string").withColumns({"published_date": F.col("published_date").cast("date"), "collected_at": F.col("collected_at").cast("timestamp_ntz")})
    path = str(tmp_path / "p")
    paging.write_pages(items, paging.feed_order(), path, 16)
    assert paging.total(spark, path) == 503 and paging.last_page(spark, path, 20) == 26
    every = [r.id for r in items.orderBy(*paging.feed_order()).collect()]
    for page in (1, 2, 13, 25, 26, 27):
        got = paging.read_page(spark, path, page, 20).collect()
        assert [r.id for r in got] == every[(page - 1) * 20 : page * 20] == [r.id for r in windows.feed_page(items, page, 20).collect()]
        assert [r["rank"] for r in got] == list(range((page - 1) * 20, (page - 1) * 20 + len(got)))
    page = paging.read_page(spark, path, 13, 20)
    assert len({f.rsplit("/", 2)[-2] for f in spark.read.parquet(f"{path}/rows").inputFiles()}) >= 8
    assert re.search(r"PartitionFilters: \[[^\]]*__range", page._jdf.queryExecution().toString())
    assert page.select(F.input_file_name()).distinct().count() <= 3


def test_pages_of_no_rows(spark, tmp_path):
    items = spark.createDataFrame([], "id int, published_date date, collected_at timestamp_ntz")
    paging.write_pages(items, paging.feed_order(), str(tmp_path / "p"), 4)
    assert paging.last_page(spark, str(tmp_path / "p"), 20) == 1


# Trigrams

WORDS = ["Vendim", "nr", "12", "për", "Ëmbëlsi", "50%", "a_b", "rruga", "e", "re", "\\x"]


def test_trigrams_give_what_a_scan_gives(spark, tmp_path):
    some = random.Random(4)
    rows = [(i, some.choice([None, "", " ".join(some.choices(WORDS, k=some.randint(1, 6)))]), " ".join(some.choices(WORDS, k=2)), "published") for i in range(300)]
    items = spark.createDataFrame(rows, "id bigint, title string, summary string, status string")
    trigrams.write_postings(items, str(tmp_path / "p"), buckets=8)
    posts = trigrams.Postings(str(tmp_path / "p"), 8)
    for text in ["vendim nr", "NR 12", "ëmbël", "përËmb", "r%12", "a_b", "50\\%", "a\\_b", "zzz", "ven%zzz", "re", "%", "_ndi_", "rruga e re rruga e re"]:
        want = predicates.feed_filter(items, text=text)
        assert rows_of(trigrams.matching(items, posts, text)) == rows_of(want), text
        found = posts.candidates(spark, f"%{text}%")
        if found is not None:
            assert found.count() >= want.count()
    assert posts.candidates(spark, "%zzz%").count() == 0
    assert 0 < posts.candidates(spark, "%rruga e%").count() < items.count()
    assert posts.candidates(spark, "%re%") is None and posts.candidates(spark, "%%") is None


def test_literals():
    assert trigrams.literals("%a b_c%%d\\%e\\") == ["a b", "c", "d%e\\"] and trigrams.literals("%_") == []


def test_postings_hold_each_gram_once(spark, tmp_path):
    items = spark.createDataFrame([(1, "aaaa aaaa", None), (2, "ab", "")], "id bigint, title string, summary string")
    trigrams.write_postings(items, str(tmp_path / "p"), buckets=4)
    held = defaultdict(list)
    for r in spark.read.parquet(str(tmp_path / "p/postings")).collect():
        held[r.gram].append((r.field, r.id))
    assert held == {"aaa": [(0, 1)], "aa ": [(0, 1)], "a a": [(0, 1)], " aa": [(0, 1)]}


def test_changes_share_one_exchange(spark):
    """Both sides of a change come from one grouping, repeated rows included; counted items need no attachments."""
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "id int, t string").repartition(2)
    gone, new = cells.changed_rows(a, a.where("id = 1").union(a.where("id = 1")))
    assert sorted(map(tuple, gone.collect())) == [(2, "y")] and sorted(map(tuple, new.collect())) == [(1, "x"), (1, "x")]
    assert "Except" not in gone._jdf.queryExecution().analyzed().toString()
    items = spark.sql("select 1 as id, 2 as municipality_id, 'c' as category, 'published' as status, date '2024-01-01' as published_date, timestamp '2024-01-02' as collected_at")
    files = spark.sql("select 7 as id, 1 as item_id, timestamp '2024-01-03' as created_at")
    assert cells.cells(cells.counted(items, files)).collect() == cells.cells(items, files).collect()
