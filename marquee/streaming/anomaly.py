"""Streaming anomaly detection: the history rules as state per user."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
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
from marquee.operators.anomaly import anomaly_logs
from marquee.operators.skew import micros

_JUDGEMENT = [
    T.StructField("is_fast", T.BooleanType()),
    T.StructField("is_device_change", T.BooleanType()),
    T.StructField("history_n", T.LongType()),
    T.StructField("history_mean", T.DoubleType()),
    T.StructField("history_sd", T.DoubleType()),
    T.StructField("z", T.DoubleType()),
]


def with_history(
    events: DataFrame,
    fast_seconds: int = V.FAST_SECONDS,
    fast_count: int = V.FAST_COUNT,
    lateness: str | None = "1 day",
    address_days: int | None = None,
) -> DataFrame:
    """The streaming form of `operators.anomaly.with_history`, columns included.

    `lateness` is None for events that have a watermark already. An event without user gets a key of its own and leaves
    no state. A user's amounts are dropped when they no longer count; the last address is kept, as a change counts after
    any time, unless `address_days` says how long: then a user who has been away that long leaves no state at all.
    """
    schema = T.StructType([*events.schema.fields, *_JUDGEMENT])
    keyed = events.withColumn("_t", micros("event_time")).withColumn(
        "_who", F.coalesce(F.concat(F.lit("u"), "user_id"), F.concat(F.lit("e"), "event_id"))
    )
    if lateness is not None:
        keyed = keyed.withWatermark("event_time", lateness)
    return keyed.groupBy("_who").transformWithState(
        _History(fast_seconds * 1_000_000, fast_count, V.HISTORY_LENGTH, V.HISTORY_MINIMUM, V.HISTORY_DAYS, address_days),
        schema, "Append", "EventTime", eventTimeColumnName="event_time",
    )


def detect(events: DataFrame, high_amount: float = V.HIGH_AMOUNT, **rules) -> DataFrame:
    """Anomaly log rows of a stream of de-duplicated events."""
    return anomaly_logs(with_history(events, **rules), high_amount)


class _History(StatefulProcessor):
    """State per user: the last amounts with their times, and the last address."""

    def __init__(self, fast_us: int, fast_count: int, length: int, minimum: int, days: int, address_days: int | None):
        self.fast_us, self.fast_count = fast_us, fast_count
        self.length, self.minimum, self.expiry_us = length, minimum, days * 86_400_000_000
        self.address_us = None if address_days is None else address_days * 86_400_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "t long, amount double")
        self.address = handle.getValueState("address", "ip string, t long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        known = key[0].startswith("u")
        recent = [tuple(r) for r in self.recent.get()] if known and self.recent.exists() else []
        ip, last = self.address.get() if known and self.address.exists() else (None, None)
        # The rows of one user in one micro-batch, bounded by the size of the trigger.
        for row in sorted(rows, key=lambda r: (r["_t"], r["event_id"])):
            t = row["_t"]
            if self.address_us is not None and last is not None and t - last >= self.address_us:
                ip = None
            near = sum(t - then <= self.fast_us for then, _ in recent[-(self.fast_count - 1) :])
            if recent and t - recent[-1][0] >= self.expiry_us:
                recent = []
            past = np.array([a for _, a in recent[-self.length :] if a is not None])
            n = len(past)
            mean = float(past.mean()) if n else None
            sd = float(past.std()) if n else None
            judged = n >= self.minimum and sd > 0 and row["amount"] is not None
            kept = row.asDict()
            del kept["_t"], kept["_who"]
            yield Row(
                **kept,
                is_fast=known and near >= self.fast_count - 1,
                is_device_change=known and ip is not None and row["device_ip"] is not None and row["device_ip"] != ip,
                history_n=n,
                history_mean=mean,
                history_sd=sd,
                z=(row["amount"] - mean) / sd if judged else None,
            )
            recent = [*recent, (t, row["amount"])][-self.length :]
            ip, last = row["device_ip"], t
        if known:
            self.recent.put(recent)
            if ip is not None:
                self.address.update((ip, last))
            else:
                self.address.clear()
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((last + self.expiry_us) // 1000 + 1)
            if self.address_us is not None:
                self.handle.registerTimer((last + self.address_us) // 1000 + 1)

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        if self.recent.exists() and max(t for t, _ in self.recent.get()) + self.expiry_us <= now:
            self.recent.clear()
        if self.address_us is not None and self.address.exists() and self.address.get()[1] + self.address_us <= now:
            self.address.clear()
        yield from ()

    def close(self) -> None:
        pass
