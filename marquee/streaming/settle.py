"""Bookings and payments settled as they come: expiry of pending bookings, spam marks, reconciliation with the gateway."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo,
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

from marquee import fixed_values as V
from marquee.operators import payments as P
from marquee.operators.skew import micros
from marquee.streaming.sinks import Writer

SETTLED = (
    "booking_id string, user_id string, show_id string, create_at timestamp, expired_at timestamp, payment_status string, "
    "new_status string, seat_status string, is_spam boolean"
)


def expire_pending(
    bookings: DataFrame, payments: DataFrame, timeout_minutes: int = V.PENDING_TIMEOUT_MINUTES, lateness: str = "10 minutes"
) -> DataFrame:
    """Streams of bookings (also of their later states) and payments -> what becomes of pending bookings as their time is up.

    The streaming form of `operators.bookings.expire_pending`. A pending booking sets a timer; when the watermark has
    passed its time, the status of its first payment decides. A booking that leaves PENDING before that takes its timer
    back. Rows may come in any batches and any order within the lateness, a payment also before its booking; payments
    made after the time was up decide nothing.
    """
    booked = bookings.select(
        "booking_id", F.col("create_at").cast("timestamp").alias("at"), "user_id", "show_id", "status",
        F.lit(None).cast("string").alias("payment_id"),
    )
    paid = payments.select(
        "booking_id", F.col("create_at").cast("timestamp").alias("at"), F.lit(None).cast("string").alias("user_id"),
        F.lit(None).cast("string").alias("show_id"), "status", "payment_id",
    )
    both = booked.unionByName(paid).filter("booking_id IS NOT NULL").withColumn("_t", micros("at")).withWatermark("at", lateness)
    return both.groupBy("booking_id").transformWithState(_Pending(timeout_minutes * 60_000_000), SETTLED, "Append", "EventTime")


def _time(us: int) -> datetime:
    return datetime.fromtimestamp(us // 1_000_000, timezone.utc).replace(microsecond=us % 1_000_000)


class _Pending(StatefulProcessor):
    """State per booking: the booking while it is pending, and its first payment."""

    def __init__(self, timeout_us: int):
        self.timeout = timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.booking = handle.getValueState("booking", "t long, user_id string, show_id string, status string")
        self.payment = handle.getValueState("payment", "t long, payment_id string, status string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        booking = tuple(self.booking.get()) if self.booking.exists() else None
        payment = tuple(self.payment.get()) if self.payment.exists() else None
        for row in rows:
            if row["payment_id"] is not None:
                payment = min(filter(None, (payment, (row["_t"], row["payment_id"], row["status"]))))
            elif booking is None or row["status"] != "PENDING":
                # the state after PENDING, whichever is told first
                booking = (row["_t"] if booking is None else booking[0], row["user_id"], row["show_id"], row["status"])
            else:
                booking = (row["_t"], *booking[1:])
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if booking:
            self.booking.update(booking)
        if payment:
            self.payment.update(payment)
        since = booking[0] if booking else payment[0]
        self.handle.registerTimer((since + self.timeout) // 1000 + (0 if booking else self.timeout // 1000))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        booking = self.booking.get() if self.booking.exists() else None
        payment = self.payment.get() if self.payment.exists() else None
        self.booking.clear()
        self.payment.clear()
        if booking is not None and booking[3] == "PENDING":
            created, user_id, show_id, _ = booking
            status = payment[2] if payment is not None and payment[0] <= created + self.timeout else None
            paid = status == "PAID"
            yield Row(
                booking_id=key[0], user_id=user_id, show_id=show_id, create_at=_time(created), expired_at=_time(created + self.timeout),
                payment_status=status, new_status="BOOKED" if paid else "CANCLED", seat_status="BOOKED" if paid else "AVAILABLE",
                is_spam=status == "CANCLED",
            )

    def close(self) -> None:
        pass


MARKS = "user_id string, n long"


def mark_spam(path: str) -> Writer:
    """Spam marks of a batch of settled bookings, by user; a replayed batch takes its own place."""

    def write(batch: DataFrame, batch_id: int) -> None:
        marks = batch.filter("is_spam").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
        marks.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def spam_so_far(spark: SparkSession, path: str) -> DataFrame:
    """All marks by user, as `operators.bookings.blacklist` takes them."""
    return spark.read.schema(MARKS).parquet(path).groupBy("user_id").agg(F.sum("n").alias("n"))


def reconcile(payments: DataFrame, responses: DataFrame, within: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """The streaming form of `operators.payments.reconcile`: pending payments settled by the gateway's answer.

    An answer (with `answered_at`) counts if it is given within the time after the payment. Both streams have a
    watermark, so a payment waits in state for that long at most: answered ones come out at once, unanswered ones, still
    pending, when their time is up. Payments that are not pending pass through.
    """
    waiting = payments.filter("status = 'PENDING'").withWatermark("create_at", lateness)
    answers = responses.withColumnRenamed("txn_ref", "_ref").withWatermark("answered_at", lateness)
    limit = F.expr(f"INTERVAL {within}")
    answered = (
        (F.col("txn_ref") == F.col("_ref"))
        & (F.col("answered_at") >= F.col("create_at"))
        & (F.col("answered_at") <= F.col("create_at") + limit)
    )
    met = waiting.join(answers, answered, "leftOuter")
    settled = P.settled(met.withColumn("_answered", F.col("_ref").isNotNull())).drop("_ref", "answered_at")
    others = payments.filter("status <> 'PENDING' OR status IS NULL").withColumn("new_status", F.col("status"))
    return settled.unionByName(others)
