"""Payments: event feed, reports, notifications and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee import fixed_values as V
from marquee.functions.business import iso_minutes, minor_units
from marquee.schemas import PAYMENT_EVENT_JSON

TIME_TEXT = "yyyy-MM-dd HH:mm:ss"


def of_users(payments: DataFrame, bookings: DataFrame) -> DataFrame:
    """Payments with the user and show of their booking."""
    return payments.join(bookings.select("booking_id", "user_id", "show_id"), "booking_id")


def event_feed(payments: DataFrame, bookings: DataFrame, shows: DataFrame, device_ip: Column | None = None) -> DataFrame:
    """Payments as topic records: key = movie, value = JSON without null fields."""
    event = F.struct(
        F.col("payment_id").alias("paymentId"),
        F.col("user_id").alias("userId"),
        F.col("movie_id").cast("string").alias("movieId"),
        "amount",
        (F.lit(V.EVENT_ADDRESS) if device_ip is None else device_ip).alias("deviceIp"),
        F.col("create_at").alias("time"),
        "status",
        F.lit(V.EVENT_LOCATION).alias("location"),
    )
    options = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss'Z'", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"}
    return (
        of_users(payments, bookings)
        .join(shows.select("show_id", "movie_id"), "show_id")
        .select(F.col("movie_id").cast("string").alias("key"), F.to_json(event, options).alias("value"))
    )


def split_feed(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of records with a JSON `value`; unknown fields are ignored.

    A record that is no JSON object of the declared types, or lacks a payment,
    user, movie, amount or time, is a reject with its reason.
    """
    schema = PAYMENT_EVENT_JSON + ", _corrupt_record string"
    # Exploded rather than a plain column, so that every record is parsed once, not once per use of a field.
    event = F.from_json("value", schema, {"columnNameOfCorruptRecord": "_corrupt_record"})
    parsed = records.withColumn("_e", F.explode(F.array(event)))
    required = ["paymentId", "userId", "movieId", "amount", "time"]
    missing = F.array_compact(F.array(*[F.when(F.col(f"_e.{f}").isNull(), F.lit(f)) for f in required]))
    reason = F.when(F.col("_e").isNull() | F.col("_e._corrupt_record").isNotNull(), "not readable").when(
        F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", "))
    )
    judged = parsed.withColumn("reason", reason)
    events = judged.filter(F.col("reason").isNull()).select(
        *[c for c in records.columns if c not in ("key", "value")],
        F.col("_e.paymentId").alias("payment_id"),
        F.col("_e.userId").alias("user_id"),
        F.col("_e.movieId").alias("movie_id"),
        F.col("_e.amount").alias("amount"),
        F.col("_e.deviceIp").alias("device_ip"),
        F.col("_e.time").alias("event_time"),
        F.col("_e.status").alias("status"),
        F.col("_e.location").alias("location"),
        F.col("_e.returnCode").alias("return_code"),
    )
    rejects = judged.filter(F.col("reason").isNotNull()).select(*records.columns, "reason")
    return events, rejects


def payment_report(payments: DataFrame, booking_report: DataFrame) -> DataFrame:
    """Payments with the ticket they pay for as a nested `detail`."""
    ticket = booking_report.select(
        "booking_id",
        "username",
        "email",
        F.struct(
            F.col("movie_name").alias("movieName"),
            F.col("hall_name").alias("hallName"),
            iso_minutes(F.col("start_time")).alias("startTime"),
            F.col("seats"),
        ).alias("detail"),
    )
    return payments.select(
        "payment_id", "booking_id", F.col("amount").alias("price"), "create_at", "status"
    ).join(ticket, "booking_id")


def payload(report: DataFrame) -> DataFrame:
    """The report rows as JSON without null fields."""
    return report.select(
        "payment_id",
        F.to_json(
            F.struct(
                F.col("payment_id").alias("id"),
                "email",
                "price",
                F.date_format("create_at", TIME_TEXT).alias("createOn"),
                "status",
                "detail",
            )
        ).alias("payload"),
    )


def notifications(report: DataFrame) -> DataFrame:
    """One mail per paid payment."""
    d = "detail."
    body = F.format_string(
        V.MAIL_BODY,
        "payment_id",
        F.col("price").cast("string"),
        F.date_format("create_at", TIME_TEXT),
        d + "movieName",
        d + "hallName",
        d + "startTime",
        F.array_join(d + "seats", ", "),
    )
    return report.filter("status = 'PAID'").select(
        "payment_id", F.col("email").alias("recipient"), F.lit(V.MAIL_SUBJECT).alias("subject"), body.alias("body")
    )


def reconcile(payments: DataFrame, responses: DataFrame) -> DataFrame:
    """Pending payments settled by their gateway response; all others unchanged.

    Paid only if code, reference, amount, type and status all agree; a pending
    payment without a response stays pending.
    """
    answer = responses.withColumn("_answered", F.lit(True))
    return settled(payments.join(answer, "txn_ref", "left"))


def settled(met: DataFrame) -> DataFrame:
    """Payments with `new_status`, from payments that met their response (`_answered`) or none."""
    agrees = (
        (F.col("response_code") == "00")
        & (F.col("amount_minor") == minor_units(F.col("amount")))
        & (F.col("txn_type") == "01")
        & (F.col("txn_status") == "00")
    )
    open_ = (F.col("status") == "PENDING") & F.col("_answered")
    new = F.when(open_ & F.coalesce(agrees, F.lit(False)), "PAID").when(open_, "CANCLED").otherwise(F.col("status"))
    return met.withColumn("new_status", new).drop("response_code", "amount_minor", "txn_type", "txn_status", "_answered")
