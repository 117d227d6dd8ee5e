"""State of each source kept event by event: attempts in, a row for each change out, cooldowns ended by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from registra.functions import scalars as S

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times are microseconds here, so that no time zone of a worker takes part.
TIMES = ["first_seen", "last_checked", "last_seen", "cooldown_until"]
FIELDS = "attempt_count bigint, first_seen bigint, last_checked bigint, last_seen bigint, last_error_type string, cooldown_until bigint, homepage_status string, hour_buckets array<string>"
#: Besides the fields: whether first_seen was there before any attempt, the times and ids of the last outcome and of the
#: last that set the status, which later batches may be older than, and the timer that is set.
STATE = FIELDS + ", given boolean, last_ts bigint, last_id bigint, status_ts bigint, status_id bigint, timer bigint"
OUT = "source_id bigint, at bigint, event string, cooling boolean, " + FIELDS
NAMES, SHOWN = ([x.split()[0] for x in kinds.split(", ")] for kinds in (STATE, FIELDS))
CHANGE = Row("source_id", "at", "event", "cooling", *SHOWN)
MINUTE = 60_000_000
STATUS = {"HTTP_403": "BLOCKED", "TIMEOUT": "ERROR"}


class SourceState(StatefulProcessor):
    """Attempts (ts, id, ok, error_type, hour) of a source. Counts add up, first_seen is written once, hours are
    appended; the outcome with the greatest (ts, id) sets error, cooldown and status, in whatever order attempts come."""

    def __init__(self, block_minutes: int, minutes: int):
        self.block, self.pause = block_minutes * MINUTE, minutes * MINUTE

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("source", STATE)

    def _get(self) -> dict:
        now = dict(zip(NAMES, self.state.get() or [None] * len(NAMES), strict=True))
        return now | {"attempt_count": now["attempt_count"] or 0, "hour_buckets": list(now["hour_buckets"] or [])}

    def _put(self, now: dict) -> None:
        self.state.update(tuple(now[c] for c in NAMES))

    def _row(self, key, at: int, event: str, now: dict) -> Row:
        return CHANGE(key[0], at, event, now["timer"] is not None, *[now[c] for c in SHOWN])

    def _set_timer(self, now: dict, watermark: int) -> None:
        """To the end of the cooldown, in place of the one before. The watermark is in milliseconds."""
        until = None if now["cooldown_until"] is None else -(-now["cooldown_until"] // 1000)
        if now["timer"] is not None and now["timer"] != until:
            self.handle.deleteTimer(now["timer"])
        now["timer"] = until if until is not None and until > watermark else None
        if now["timer"] is not None:
            self.handle.registerTimer(now["timer"])

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        now = dict.fromkeys(NAMES) | {c: initialState[c] for c in SHOWN}
        now |= {"attempt_count": now["attempt_count"] or 0, "hour_buckets": sorted(now["hour_buckets"] or []), "given": now["first_seen"] is not None}
        self._set_timer(now, timerValues.getCurrentWatermarkInMs())
        self._put(now)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = self._get()
        hours = set(now["hour_buckets"])
        for row in rows:
            ts = row["ts"]
            now["attempt_count"] += 1
            if not now["given"] and (now["first_seen"] is None or ts < now["first_seen"]):
                now["first_seen"] = ts
            now["last_checked"] = max(ts, now["last_checked"] or 0)
            if row["ok"]:
                now["last_seen"] = max(ts, now["last_seen"] or 0)
            hours.add(row["hour"])
            if self._newer(row, now, "last"):
                now |= self._outcome(row)
            status = "OK" if row["ok"] else STATUS.get(row["error_type"])
            if status and self._newer(row, now, "status"):
                now["homepage_status"] = status
        now["hour_buckets"] = sorted(hours)
        self._set_timer(now, timerValues.getCurrentWatermarkInMs())
        self._put(now)
        yield self._row(key, now["last_checked"], "attempt", now)

    def _newer(self, row: Row, now: dict, name: str) -> bool:
        """Whether row comes after the one whose time and id are kept under that name; if so, it takes its place."""
        at = (row["ts"], row["id"])
        if now[f"{name}_ts"] is not None and at <= (now[f"{name}_ts"], now[f"{name}_id"]):
            return False
        now[f"{name}_ts"], now[f"{name}_id"] = at
        return True

    def _outcome(self, last: Row) -> dict:
        if last["ok"]:
            return {"last_error_type": None, "cooldown_until": None}
        error = last["error_type"]
        return {"last_error_type": error, "cooldown_until": last["ts"] + (self.block if error == "HTTP_403" else self.pause)}

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = self._get()
        if now["timer"] == expiredTimerInfo.getExpiryTimeInMs():
            now["timer"] = None
            self._put(now)
            yield self._row(key, now["cooldown_until"], "cooldown_over", now)

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams that start inside keep their state in RocksDB, which source_changes() needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def source_changes(attempts: DataFrame, registry: DataFrame, delay: str = "1 hour", block_minutes: int = 10080, minutes: int = 30) -> DataFrame:
    """A stream of changes (source_id, at, event, cooling, and the fields of the state) from a stream of attempts (source_id,
    ts, id, ok, error_type): one row of event `attempt` for each source of a batch, and one of event `cooldown_over` when
    the watermark passes the end of a cooldown, which no attempt has to follow. cooling: a cooldown runs, by event time.

    registry: the first state, as in apply_attempts; sources that it lacks start empty. Attempts later than the watermark
    are dropped. The last row of each source is the state that apply_attempts gives for all attempts. The session's state
    store must be RocksDB's (see rocksdb())."""
    timed = attempts.withColumn("time", F.col("ts").cast("timestamp")).withWatermark("time", delay)
    rows = timed.select("source_id", "time", F.unix_micros("time").alias("ts"), "id", "ok", "error_type", S.hour_bucket(F.col("ts")).alias("hour"))
    first = registry.select("source_id", *[F.unix_micros(F.col(c).cast("timestamp")).alias(c) if c in TIMES else F.col(c) for c in SHOWN])
    out = rows.groupBy("source_id").transformWithState(SourceState(block_minutes, minutes), OUT, "Append", "EventTime", initialState=first.groupBy("source_id"))
    times = {c: F.timestamp_micros(c).cast("timestamp_ntz" if dict(attempts.dtypes)["ts"] == "timestamp_ntz" else "timestamp") for c in ("at", *TIMES)}
    return out.withColumns(times)


def latest_state(changes: DataFrame, registry: DataFrame) -> DataFrame:
    """registry after a table of changes: the last state of each of its sources, or that of the registry. Every change of
    a source counts its attempts or, after them, the end of its cooldown."""
    last = changes.groupBy("source_id").agg(F.max_by(F.struct(*SHOWN), F.struct("attempt_count", F.col("event") == "cooldown_over")).alias("x"))
    met = registry.join(last, "source_id", "left")
    return met.select("source_id", *[F.when(F.col("x").isNull(), F.col(c)).otherwise(F.col(f"x.{c}")).alias(c) for c in SHOWN])
