"""Streaming de-duplication, login throttling, revenue and counts."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo,
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

from marquee import fixed_values as V
from marquee.operators.skew import micros

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_CONF = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}


def dedup_within_watermark(events: DataFrame, delay: str) -> DataFrame:
    """First event per payment; repeats within at least `delay` are dropped.

    Repeats shortly after the delay may be dropped too, and `delay` is also the lateness: what comes later than that is
    lost. `dedup_exact` follows the rule exactly and takes events up to a day late.
    """
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["payment_id"])


def anchored(rows: DataFrame, key: str, ts: str, tie: str, seconds: int, position: str = "position", lateness: str = "1 day") -> DataFrame:
    """The streaming form of `anchored_windows`: the place of each row in the window its key opened.

    Exact for rows in order of time across micro-batches; a late row counts where it arrives.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(position, T.LongType())])
    keyed = rows.filter(F.col(key).isNotNull()).withColumn("_t", micros(ts)).withWatermark(ts, lateness)
    return keyed.groupBy(key).transformWithState(
        _Anchored(tie, seconds * 1_000_000, position), schema, "Append", "EventTime", eventTimeColumnName=ts
    )


class _Anchored(StatefulProcessor):
    """State per key: when its window opened and how many rows it took."""

    def __init__(self, tie: str, length_us: int, position: str):
        self.tie, self.length, self.position = tie, length_us, position

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened long, taken long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        opened, taken = self.window.get() if self.window.exists() else (None, 0)
        # The rows of one key in one micro-batch, bounded by the size of the trigger.
        for row in sorted(rows, key=lambda r: (r["_t"], r[self.tie])):
            if opened is None or row["_t"] >= opened + self.length:
                opened, taken = row["_t"], 0
            taken += 1
            kept = row.asDict()
            del kept["_t"]
            yield Row(**kept, **{self.position: taken})
        self.window.update((opened, taken))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((opened + self.length) // 1000 + 1)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.window.clear()
        yield from ()

    def close(self) -> None:
        pass


def dedup_exact(events: DataFrame, ttl_seconds: int = V.DEDUP_SECONDS) -> DataFrame:
    return anchored(events, "payment_id", "event_time", "event_id", ttl_seconds, "_nth").filter("_nth = 1").drop("_nth")


def login_throttle(attempts: DataFrame, limit: int = V.LOGIN_LIMIT, seconds: int = V.LOGIN_SECONDS) -> DataFrame:
    placed = anchored(attempts, "login_key", "ts", "attempt_id", seconds, "attempt_no")
    return placed.withColumn("rejected", F.col("attempt_no") > limit)


def hourly_revenue(events: DataFrame) -> DataFrame:
    """Running revenue per hour, for update mode; watermarked events."""
    return (
        events.groupBy(F.window("event_time", "1 hour").alias("w"))
        .agg(F.sum("amount").alias("revenue"))
        .select(F.to_date("w.start").alias("date"), F.hour("w.start").alias("hour"), "revenue")
    )


def movie_daily_counts(events: DataFrame) -> DataFrame:
    """Running count per day and movie, for update mode; watermarked events."""
    return (
        events.groupBy(F.window("event_time", "1 day").alias("w"), "movie_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.to_date("w.start").alias("date"), "movie_id", "n")
    )
