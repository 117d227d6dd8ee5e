"""Tables that batches change in place of a few buckets: what a merge needs of the target is read by bucket, and only
buckets that change are written.

A set of tables lives in one folder. A table's rows are dealt into buckets by a hash of its key columns; a batch writes
the buckets that it changes under its own number (`data/<table>/v=<batch>/bucket=<k>`), all tables of the batch first,
and then one small commit that names, for each bucket of each table, the batch that holds it. The commit is renamed
into place, so all tables change together or not at all: a batch that is lost before has written folders that no commit
names, and is run again; one that is run again after does nothing.

The lists of buckets that pass through the driver have at most as many entries as a table has buckets. What a batch reads
several times is written beside the tables until the batch ends (`work/batch=<batch>`), not held in executors' memory.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType, StructType

from registra.operators import aggs, merges

BUCKET = "bucket"
#: Tasks that write a bucket.
TASKS = 2
#: Bytes of a row group. A writer holds one in memory that Spark doesn't count; Parquet's own size is four times this.
ROW_GROUP = 32 << 20
#: Place of a row in its batch.
ROW = "__row"


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


@dataclass
class Snapshot:
    """A commit: the batch, the number of buckets, for each table its schema, its keys and the batch of each bucket, and how
    many rows of the batch were inserted, updated and skipped."""

    path: str
    batch: int = -1
    buckets: int = 64
    tables: dict[str, dict] = field(default_factory=dict)
    counters: dict[str, int] = field(default_factory=dict)

    def keys(self, table: str) -> list[str]:
        return self.tables[table]["keys"]

    def read(self, spark: SparkSession, table: str, wanted: list[int] | None = None) -> DataFrame:
        """Rows of a table, of all buckets or of those that are wanted; other buckets' files aren't opened."""
        schema = StructType.fromJson(self.tables[table]["schema"])
        held = {int(k): v for k, v in self.tables[table]["held"].items()}
        paths = [f"{self.path}/data/{table}/v={held[k]}/{BUCKET}={k}" for k in (sorted(held) if wanted is None else wanted) if k in held]
        return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _commits(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the commits: that of a batch is one more than the batch's, 0 is that of the empty tables."""
    fs, at = _fs(spark, f"{path}/commits")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n) for n in names if n.isdigit())


def _commit(spark: SparkSession, path: str, number: int) -> Snapshot:
    return Snapshot(**json.loads(spark.read.option("wholetext", True).text(f"{path}/commits/{number}").first()[0]))


def snapshot(spark: SparkSession, path: str) -> Snapshot | None:
    """The newest commit; None if there is none."""
    found = _commits(spark, path)
    return _commit(spark, path, found[-1]) if found else None


def create(spark: SparkSession, path: str, schemas: dict[str, tuple[StructType, list[str]]], buckets: int = 64) -> Snapshot:
    """An empty set of tables: schema and key columns of each. A bucket is one task's work, so their number should put
    some 100 MB into each."""
    made = Snapshot(path, -1, buckets, {t: {"schema": s.jsonValue(), "keys": keys, "held": {}} for t, (s, keys) in schemas.items()})
    _publish(spark, made)
    return made


def _publish(spark: SparkSession, made: Snapshot) -> None:
    fs, to = _fs(spark, f"{made.path}/commits/{made.batch + 1}")
    _, new = _fs(spark, f"{made.path}/commits/.{made.batch + 1}.new")
    out = fs.create(new, True)
    out.write(bytearray(json.dumps({"path": made.path, "batch": made.batch, "buckets": made.buckets, "tables": made.tables, "counters": made.counters}).encode()))
    out.close()
    if not fs.rename(new, to):
        raise OSError(f"commit {made.batch + 1} of {made.path} is there already")


def commit(spark: SparkSession, before: Snapshot, batch: int, changes: dict[str, tuple[DataFrame, list[int]]], keep: int = 2, counters: dict[str, int] | None = None) -> Snapshot:
    """Write the changed buckets of each table (rows, buckets: the rows of other buckets are left out; a bucket without
    rows becomes empty) and let them take effect together. Buckets that neither the new commit nor the `keep` - 1 before
    it hold are deleted."""
    tables = {t: {**x, "held": dict(x["held"])} for t, x in before.tables.items()}
    for table, (rows, changed) in changes.items():
        if not changed:
            continue
        at = f"{before.path}/data/{table}/v={batch}"
        own = rows.withColumn(BUCKET, bucket_of(before.keys(table), before.buckets)).where(F.col(BUCKET).isin(changed))
        # each bucket is dealt evenly to TASKS tasks: a hash of the few buckets would put several into one
        place = F.array_position(F.array(*map(F.lit, changed)), F.col(BUCKET)) - 1
        share = F.pmod(F.xxhash64(*before.keys(table), F.lit(1)), F.lit(TASKS))
        own.repartitionById(len(changed) * TASKS, (place * TASKS + share).cast("int")).write.mode("overwrite").option("parquet.block.size", ROW_GROUP).partitionBy(BUCKET).parquet(at)
        fs, _ = _fs(spark, at)
        for k in changed:
            if fs.exists(_fs(spark, f"{at}/{BUCKET}={k}")[1]):
                tables[table]["held"][str(k)] = batch
            else:
                tables[table]["held"].pop(str(k), None)
    after = Snapshot(before.path, batch, before.buckets, tables, counters or {})
    _publish(spark, after)
    _forget(spark, before.path, keep)
    return after


def _forget(spark: SparkSession, path: str, keep: int) -> None:
    found = _commits(spark, path)
    kept = [_commit(spark, path, b) for b in found[-keep:]]
    held = {(t, k, v) for s in kept for t, x in s.tables.items() for k, v in x["held"].items()}
    for b in found[:-keep]:
        for t, x in _commit(spark, path, b).tables.items():
            for k, v in x["held"].items():
                if (t, k, v) not in held:
                    fs, at = _fs(spark, f"{path}/data/{t}/v={v}/{BUCKET}={k}")
                    fs.delete(at, True)
        fs, at = _fs(spark, f"{path}/commits/{b}")
        fs.delete(at, True)


def _kept(rows: DataFrame, at: str) -> DataFrame:
    """rows as a table at a path, computed once."""
    rows.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def _typed(rows: DataFrame, now: Snapshot) -> DataFrame:
    """rows with the tables' types for columns that hold nothing but untyped nulls: files have no such type."""
    types = {f.name: f.dataType for x in now.tables.values() for f in StructType.fromJson(x["schema"])}
    return rows.withColumns({f.name: F.col(f.name).cast(types.get(f.name, "string")) for f in rows.schema if isinstance(f.dataType, NullType)})


def buckets_in(rows: DataFrame, keys: list[str], buckets: int) -> list[int]:
    return sorted(r[0] for r in rows.select(bucket_of(keys, buckets)).distinct().collect())


# Documents: items by key, and which key holds which address

ITEMS, ADDRESSES = "items", "addresses"
ADDRESS = ["source_url", *merges.ITEM_KEY]


def create_items(spark: SparkSession, path: str, schema: StructType, buckets: int = 64) -> Snapshot:
    """Tables for ingest(): items, bucketed by municipality, category and dedup key, and addresses, bucketed by URL."""
    urls = StructType([schema[c] for c in ADDRESS])
    return create(spark, path, {ITEMS: (schema, merges.ITEM_KEY), ADDRESSES: (urls, ["source_url"])}, buckets)


@dataclass
class Change:
    """What a batch did: the rows of the read buckets before and after, an action for each incoming id, and the changed
    buckets."""

    before: DataFrame
    after: DataFrame
    actions: DataFrame
    changed: dict[str, list[int]]


def changed_items(spark: SparkSession, now: Snapshot, batch: DataFrame, at: str, publish: bool = False, on_url_conflict: str = "skip") -> tuple[Change, dict[str, tuple[DataFrame, list[int]]]]:
    """merge_documents of a batch against the buckets of its keys and of the rows that hold its URLs. Only the merge
    itself is written, at a path of the caller's. Gives the change, and what commit() takes."""
    n, key = now.buckets, merges.ITEM_KEY
    with_url = batch.where("source_url is not null")
    at_url = buckets_in(with_url, ["source_url"], n)
    urls = now.read(spark, ADDRESSES, at_url)
    owners = urls.join(with_url.select("source_url").distinct(), "source_url", "left_semi")
    at_key = buckets_in(batch, key, n)
    at_owner = buckets_in(owners, key, n)
    before = now.read(spark, ITEMS, sorted({*at_key, *at_owner}))
    merged = _kept(merges.merged_documents(before, batch.select(*before.columns), publish, on_url_conflict), at)  # read for the buckets, both tables, and by the caller
    after, actions = merged.where("row is not null").select("row.*"), merged.where("action is not null").select("id", "action")
    acted = batch.join(actions.where("action <> 'skipped'").select("id"), "id", "left_semi")
    changed = buckets_in(acted, key, n)
    if on_url_conflict == "reconcile":  # a row may have left the bucket of its old key
        changed = sorted({*changed, *buckets_in(owners.join(acted.select("source_url"), "source_url", "left_semi"), key, n)})
    old = urls.join(before.where("source_url is not null").select(*ADDRESS), ADDRESS, "left_anti")
    new = old.unionByName(after.where("source_url is not null").select(*ADDRESS)).distinct()
    change = Change(before, after, actions, {ITEMS: changed, ADDRESSES: buckets_in(acted.where("source_url is not null"), ["source_url"], n)})
    return change, {ITEMS: (after, change.changed[ITEMS]), ADDRESSES: (new, change.changed[ADDRESSES])}


def ingest(path: str, publish: bool = False, on_url_conflict: str = "skip", each: Callable[[DataFrame, int, Snapshot, Change], dict[str, tuple[DataFrame, list[int]]]] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over tables of create_items(): a batch costs its own keys' and URLs' buckets, whatever the
    tables hold. The actions are written under path/actions; the job that writes them counts them for the commit. each: (batch with the place of its rows as `ROW`, batch_id, snapshot, change) to changes of more tables of the set,
    which take effect with the items."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        now = snapshot(spark, path)
        if now.batch >= batch_id:
            return
        work = f"{path}/work/batch={batch_id}"
        try:
            batch = _kept(_typed(batch, now).withColumn(ROW, F.monotonically_increasing_id()), f"{work}/rows")
            change, changes = changed_items(spark, now, batch, f"{work}/merged", publish, on_url_conflict)
            more = each(batch, batch_id, now, change) if each else {}
            actions, counts = aggs.observed_actions(change.actions)
            actions.write.mode("overwrite").parquet(f"{path}/actions/batch={batch_id}")
            commit(spark, now, batch_id, changes | more, counters=counts.get)
        finally:
            fs, at = _fs(spark, work)
            fs.delete(at, True)

    return run


def upserted(spark: SparkSession, now: Snapshot, table: str, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> tuple[DataFrame, list[int]]:
    """Changes for commit(): rows merged (by default: upserted, the last of each key) into the buckets of their keys."""
    at = buckets_in(rows, now.keys(table), now.buckets)
    target = now.read(spark, table, at)
    return (merge(target, rows) if merge else merges.upsert(target, rows, now.keys(table))), at


def create_register(spark: SparkSession, path: str, items: StructType, records: StructType, scores: StructType, buckets: int = 64) -> Snapshot:
    """Items with their addresses, records by item and scores by municipality, changed together by register()."""
    urls = StructType([items[c] for c in ADDRESS])
    tables = {ITEMS: (items, merges.ITEM_KEY), ADDRESSES: (urls, ["source_url"]), "records": (records, ["item_id"]), "scores": (scores, ["municipality_id"])}
    return create(spark, path, tables, buckets)


def register(path: str, fresh_scores: Callable[[DataFrame, Snapshot, Change], DataFrame] | None = None, publish: bool = False, on_url_conflict: str = "skip") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over tables of create_register(): rows of items that carry the fields of a record (item_id
    apart) become items and, where the item is kept under their key, its record; the last row of a key wins.
    fresh_scores gives automatic scores of the municipalities that the batch touches; overridden values stay."""

    def each(batch: DataFrame, batch_id: int, now: Snapshot, change: Change) -> dict[str, tuple[DataFrame, list[int]]]:
        spark = batch.sparkSession
        fields = [c for c in now.read(spark, "records", []).columns if c != "item_id"]
        of = change.after.select(*merges.ITEM_KEY, F.col("id").alias("item_id"))
        own = batch.select(*merges.ITEM_KEY, *[c for c in fields if c not in merges.ITEM_KEY], ROW).join(of, merges.ITEM_KEY).select("item_id", *fields, ROW)
        out = {"records": upserted(spark, now, "records", own, lambda target, rows: merges.upsert(target, rows, ["item_id"], [ROW]))}
        if fresh_scores:
            out["scores"] = upserted(spark, now, "scores", fresh_scores(batch.drop(ROW), now, change), merges.upsert_scores)
        return out

    return ingest(path, publish, on_url_conflict, each)


def once_within(stream: DataFrame, ts: str, delay: str, keys: list[str]) -> DataFrame:
    """The stream without rows whose keys have come before, as long as the watermark keeps them: deliveries that repeat
    cost no bucket. Of a batch, plain dropDuplicates."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys) if stream.isStreaming else stream.dropDuplicates(keys)
