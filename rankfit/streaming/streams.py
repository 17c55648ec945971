"""Structured Streaming forms: new-best detection with keyed state, and keyed upserts.

State lies in Spark's RocksDB store: every batch writes what changed, and Spark makes snapshots and removes what they
replace. After a restart a query goes on from its last committed batch.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PR_SCHEMA = "user_id bigint, event string, ts timestamp, time_sec double, old_best double"
# moments are microseconds since 1970
FOUND = Row("user_id", "event", "at", "time_sec", "old_best")
FOUND_SCHEMA = "user_id bigint, event string, at bigint, time_sec double, old_best double"
STATE_SCHEMA = "best double, announced bigint, seen bigint"
HOUR = 3_600_000_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(df: DataFrame) -> DataFrame:
    """The stream, in a session whose new streams keep their state in RocksDB."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return df


# rows of a key that are held before its staircase is taken again
HELD = 65_536


def staircase(steps: list[tuple[int, float]]) -> list[tuple[int, float]]:
    """Of (moment, value) those that are smaller than all before them in that order."""
    out, low = [], float("inf")
    for at, value in sorted(steps):
        if value < low:
            out.append((at, value))
            low = value
    return out


class NewBests(StatefulProcessor):
    """Per (user, event): announces a value that beats the stored best when the last announcement is old enough.

    A key's rows come one by one in any order. From time to time only their staircase is kept, so a task holds the new bests
    of a key and some rows, not all of them. Rows, not data frames: most keys have a few rows a batch, and a frame costs more.
    """

    def __init__(self, gate_hours: float, ttl_hours: float | None, idle_hours: float | None):
        self.gate, self.ttl = int(gate_hours * HOUR), None if ttl_hours is None else int(ttl_hours * HOUR)
        self.idle_ms = None if idle_hours is None else int(idle_hours * 3_600_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("best", STATE_SCHEMA, ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best, announced, seen = self.state.get() or (None, None, None)
        steps, latest, most = [], seen, HELD
        for row in rows:
            at, value = row["at"], row["time_sec"]
            if at is None or value is None or value != value:
                continue
            latest = at if latest is None or at > latest else latest
            steps.append((at, value))
            if len(steps) >= most:
                steps = staircase(steps)
                most = max(HELD, 2 * len(steps))
        out = []
        for at, value in staircase(steps):
            if best is not None and not value < best:
                continue
            late = seen is not None and at < seen
            if not late and (announced is None or at - announced >= self.gate):
                out.append(FOUND(*key, at, value, best))
                announced = at
            best = value
        if latest is not None:
            self.state.update((best, announced, latest))
            if self.ttl is not None and next(iter(self.handle.listTimers()), None) is None:
                self.handle.registerTimer(self._due(latest, timerValues))
        return iter(out)

    def _due(self, seen: int, timers) -> int:
        return max((seen + self.ttl) // 1000, timers.getCurrentWatermarkInMs() + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, _, seen = self.state.get() or (None, None, None)
        if seen is not None and (seen + self.ttl) // 1000 > expiredTimerInfo.getExpiryTimeInMs():
            # rows came since: one timer per key, moved when it fires
            self.handle.registerTimer(self._due(seen, timerValues))
        else:
            self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


def pr_detect_stream(events: DataFrame, gate_hours: float = 0.0, ttl_hours: float | None = None, idle_hours: float | None = None) -> DataFrame:
    """New bests per (user, event) of a stream of (user_id, event, ts, time_sec).

    `gate_hours`: how long after an announced best the next one of the key is held back. A row that is older than one the
    key has already seen in an earlier batch counts for the best, but is not announced. `ttl_hours`: a key's state goes that
    long after its last row, by the watermark that the stream must then have. `idle_hours`: it goes when no row has come for
    that long by the clock. Rows without a time or a value take no part.
    """
    if ttl_hours is not None and idle_hours is not None:
        raise ValueError("ttl_hours goes by the watermark, idle_hours by the clock; give one of them")
    mode = "None" if ttl_hours is None and idle_hours is None else "EventTime" if idle_hours is None else "ProcessingTime"
    # the watermark goes by ts itself
    moments = [F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), *(["ts"] if ttl_hours is not None else [])]
    rows = with_store(events).select("user_id", "event", F.col("time_sec").cast("double").alias("time_sec"), *moments)
    found = rows.groupBy("user_id", "event").transformWithState(NewBests(gate_hours, ttl_hours, idle_hours), FOUND_SCHEMA, "Append", mode)
    return found.select("user_id", "event", F.timestamp_micros("at").alias("ts"), "time_sec", "old_best")


def upsert_stream(changes: DataFrame, keys: list[str], updated: str, tie: str, checkpoint: str):
    """Last write per key as the state of a streaming maximum, reduced before the shuffle and kept in `checkpoint`.
    A batch stores the keys it changed; nothing is rewritten or read again. Start the result to run it."""
    rest = [c for c in changes.columns if c not in (*keys, updated, tie)]
    last = with_store(changes).groupBy(*keys).agg(F.max(F.struct(updated, tie, *rest)).alias("last"))
    return last.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint)


def read_upserted(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The upserted table as of the last committed batch: the last write of every key."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.*", F.col("value.max").alias("last")).select("*", "last.*").drop("last")
