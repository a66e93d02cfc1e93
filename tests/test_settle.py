"""Bookings and payments settled in streams end as the batch operators settle them."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marquee.operators import bookings as B
from marquee.operators import payments as P
from marquee.streaming import settle, sinks, source

START = datetime(2024, 5, 1)
BOOKING = "booking_id string, user_id string, show_id string, status string, create_at timestamp"
PAYMENT = "payment_id string, booking_id string, amount double, status string, txn_ref string, create_at timestamp"
RESPONSE = "txn_ref string, response_code string, amount_minor long, txn_type string, txn_status string, answered_at timestamp"


def at(minutes):
    return START + timedelta(minutes=minutes)


def in_batches(spark, rows, schema, ts, n, folder):
    """Rows written as `n` files, dealt out by time; the file stream reads one per micro-batch."""
    place = schema.split(", ").index(next(c for c in schema.split(", ") if c.startswith(ts + " ")))
    rows = sorted(rows, key=lambda r: r[place])
    size = -(-len(rows) // n)
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        random.Random(i).shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return source.event_files(spark, folder, schema, 1)


def run(df, writer, state):
    sinks.start(df, writer, state, available_now=True).awaitTermination(300)


def made(seed):
    rng = random.Random(seed)
    bookings, payments = [], []
    for i in range(120):
        created = rng.randrange(0, 600)
        status = rng.choice(["PENDING"] * 5 + ["BOOKED", "CANCLED"])
        bookings.append((f"b{i}", f"u{rng.randrange(12)}", f"s{i % 5}", status, at(created)))
        for k in range(rng.choice([0, 1, 1, 2])):
            payments.append((f"p{i}-{k}", f"b{i}", 10.0, rng.choice(["PAID", "CANCLED", "CANCLED", "PENDING"]), f"t{i}", at(created + rng.randrange(0, 14))))
    return bookings, payments


@pytest.mark.parametrize("batches", [1, 4])
def test_expiry_and_spam_equal_batch(spark, tmp_path, batches):
    bookings, payments = made(batches)
    all_bookings, all_payments = spark.createDataFrame(bookings, BOOKING), spark.createDataFrame(payments, PAYMENT)
    last = [("end", "nobody", "s", "BOOKED", at(2_000))]
    streams = (
        in_batches(spark, bookings + last, BOOKING, "create_at", batches, str(tmp_path / "b")),
        in_batches(spark, payments, PAYMENT, "create_at", batches, str(tmp_path / "p")),
    )
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")
    keep, mark = sinks.append_once(out), settle.mark_spam(marks)

    def both(batch, batch_id):
        batch = batch.persist()
        for _ in range(2):  # as if replayed
            keep(batch, batch_id)
            mark(batch, batch_id)
        batch.unpersist()

    run(settle.expire_pending(*streams, lateness="4 hours"), both, str(tmp_path / "state"))
    want = B.expire_pending(all_bookings, all_payments, at(1_999).isoformat(sep=" "))
    columns = ["booking_id", "user_id", "show_id", "payment_status", "new_status", "seat_status", "is_spam"]
    got = spark.read.schema(settle.SETTLED).parquet(out)
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert got.filter("expired_at <> create_at + INTERVAL 15 MINUTES").count() == 0
    stored = spark.createDataFrame([(f"u{i}", i % 3) for i in range(12)], "user_id string, spam_times int")
    users = spark.createDataFrame([(f"u{i}", "ACTIVE") for i in range(12)], "user_id string, status string")
    streamed = B.blacklist(stored, settle.spam_so_far(spark, marks), users)
    in_batch = B.blacklist(stored, B.spam_counts(want), users)
    assert sorted(streamed.collect()) == sorted(in_batch.collect()) and in_batch.filter("status = 'BLACKLISTED'").count() > 0


def test_booking_that_leaves_pending_is_not_expired(spark, tmp_path):
    rows = [("a", "u", "s", "PENDING", at(0)), ("a", "u", "s", "BOOKED", at(5)), ("b", "u", "s", "PENDING", at(0)), ("end", "u", "s", "BOOKED", at(900))]
    bookings = in_batches(spark, rows, BOOKING, "create_at", 4, str(tmp_path / "b"))
    # paid too late for b, and a payment whose booking never comes
    payments = in_batches(spark, [("p", "b", 1.0, "PAID", "t", at(16)), ("q", "none", 1.0, "PAID", "t", at(1))], PAYMENT, "create_at", 1, str(tmp_path / "p"))
    out = str(tmp_path / "out")
    run(settle.expire_pending(bookings, payments, lateness="1 hour"), sinks.append_once(out), str(tmp_path / "state"))
    assert [(r.booking_id, r.new_status) for r in spark.read.schema(settle.SETTLED).parquet(out).collect()] == [("b", "CANCLED")]


@pytest.mark.parametrize("batches", [1, 3])
def test_reconciliation_equals_batch(spark, tmp_path, batches):
    rng = random.Random(batches)
    payments, responses = [], []
    for i in range(150):
        created = rng.randrange(0, 900)
        payments.append((f"p{i}", f"b{i}", 10.0 + i, rng.choice(["PENDING", "PENDING", "PENDING", "PAID", "CANCLED"]), f"t{i}", at(created)))
        if i % 3:
            amount = 1000 + 100 * i + (i % 7 == 0)
            code, kind = rng.choice(["00", "00", "24"]), rng.choice(["01", "01", "02"])
            responses.append((f"t{i}", code, amount, "01", "00" if kind == "01" else kind, at(created + rng.randrange(0, 59))))
    want = P.reconcile(spark.createDataFrame(payments, PAYMENT), spark.createDataFrame(responses, RESPONSE).drop("answered_at"))
    last = [("end", "b", 1.0, "PENDING", "none", at(9_000))], [("none2", "00", 1, "01", "00", at(9_000))]
    out = str(tmp_path / "out")
    stream = settle.reconcile(
        in_batches(spark, payments + last[0], PAYMENT, "create_at", batches, str(tmp_path / "p")),
        in_batches(spark, responses + last[1], RESPONSE, "answered_at", batches, str(tmp_path / "r")),
        lateness="8 hours",
    )
    run(stream, sinks.append_once(out), str(tmp_path / "state"))
    columns = ["payment_id", "txn_ref", "status", "new_status"]
    got = spark.read.parquet(out).filter("payment_id <> 'end'")
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert {r.new_status for r in got.collect()} == {"PAID", "CANCLED", "PENDING"}


def test_answer_after_its_time_settles_nothing(spark, tmp_path):
    payments = [("p", "b", 10.0, "PENDING", "t", at(0)), ("end", "b", 1.0, "PENDING", "x", at(900))]
    responses = [("t", "00", 1000, "01", "00", at(61)), ("y", "00", 1, "01", "00", at(900))]
    out = str(tmp_path / "out")
    stream = settle.reconcile(
        in_batches(spark, payments, PAYMENT, "create_at", 1, str(tmp_path / "p")),
        in_batches(spark, responses, RESPONSE, "answered_at", 1, str(tmp_path / "r")),
    )
    run(stream, sinks.append_once(out), str(tmp_path / "state"))
    assert {r.payment_id: r.new_status for r in spark.read.parquet(out).collect()}["p"] == "PENDING"


def test_unordered_rows_of_one_batch(spark):
    """A payment row sorts by time and id, as in batch: the first one decides."""
    payments = spark.createDataFrame([("p2", "b", 1.0, "PAID", "t", at(3)), ("p1", "b", 1.0, "CANCLED", "t", at(3))], PAYMENT)
    bookings = spark.createDataFrame([("b", "u", "s", "PENDING", at(0))], BOOKING)
    got = B.expire_pending(bookings, payments, at(60).isoformat(sep=" ")).select(F.col("payment_status")).first()
    assert got.payment_status == "CANCLED"
