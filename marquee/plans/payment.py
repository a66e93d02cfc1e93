from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import first_name, joined_hash, last_name, txn_ref
from marquee.operators import payments as P
from marquee.plans.booking import REPORT_SQL, REPORT_VIEWS, report
from marquee.plans.oracle import with_views
from marquee.plans.registry import plan
from marquee.sources.testdata import Views

_FEED = """SELECT CAST(movie_id AS VARCHAR) AS key,
  '{"paymentId":"' || payment_id || '","userId":"' || user_id || '","movieId":"' || CAST(movie_id AS VARCHAR)
  || '","amount":' || CAST(amount AS VARCHAR) || ',"deviceIp":"VNPay-Callback","time":"'
  || strftime(p.create_at, '%Y-%m-%dT%H:%M:%SZ') || '","status":"' || p.status || '","location":"VN"}' AS value
  FROM payments p JOIN bookings b USING (booking_id) JOIN shows USING (show_id)"""


@plan("payment_event_feed", with_views(_FEED, "payments", "bookings", "shows"))
def _feed(v: Views) -> DataFrame:
    return P.event_feed(v.payments, v.bookings, v.shows)


def damaged_feed(v: Views) -> DataFrame:
    """The feed as it might arrive: by amount, some records cut short, some without a user."""
    cents = F.get_json_object("value", "$.amount").cast("double").cast("long") % 10
    return P.event_feed(v.payments, v.bookings, v.shows).withColumn(
        "value",
        F.when(cents == 0, F.expr("left(value, length(value) - 5)"))
        .when(cents == 1, F.regexp_replace("value", '"userId":"[0-9]+",', ""))
        .otherwise(F.col("value")),
    )


@plan(
    "dlq_events",
    with_views(
        """SELECT key, CASE WHEN cents = 0 THEN left(value, length(value) - 5)
             ELSE regexp_replace(value, '"userId":"[0-9]+",', '') END AS value,
             CASE WHEN cents = 0 THEN 'not readable' ELSE 'missing userId' END AS reason
           FROM (SELECT *, CAST(trunc(CAST(regexp_extract(value, '"amount":([0-9.]+)', 1) AS DOUBLE)) AS BIGINT) % 10
                 AS cents FROM feed) WHERE cents < 2""",
        "payments",
        "bookings",
        "shows",
        feed=_FEED,
    ),
)
def _dlq(v: Views) -> DataFrame:
    return P.split_feed(damaged_feed(v))[1]


@plan(
    "user_payments",
    with_views(
        "SELECT payment_id, booking_id, user_id, amount, txn_ref, p.status FROM payments p "
        "JOIN bookings b USING (booking_id)",
        "payments",
        "bookings",
    ),
)
def _user_payments(v: Views) -> DataFrame:
    return P.of_users(v.payments, v.bookings).select("payment_id", "booking_id", "user_id", "amount", "txn_ref", "status")


_PAYMENT_REPORT = {
    **REPORT_SQL,
    "payment_report": """SELECT p.payment_id, p.booking_id, r.username, r.email, p.amount AS price, p.status,
        strftime(p.create_at, '%Y-%m-%d %H:%M:%S') AS create_on, r.movie_name, r.hall_name,
        strftime(r.start_time, '%Y-%m-%dT%H:%M') AS start_time, r.seats
        FROM payments p JOIN report r USING (booking_id)""",
}


def payment_report(v: Views) -> DataFrame:
    return P.payment_report(v.payments, report(v))


@plan("payment_report", with_views("SELECT * FROM payment_report", "payments", *REPORT_VIEWS, **_PAYMENT_REPORT))
def _payment_report(v: Views) -> DataFrame:
    return payment_report(v).select(
        "payment_id",
        "booking_id",
        "username",
        "email",
        "price",
        "status",
        F.date_format("create_at", P.TIME_TEXT).alias("create_on"),
        F.col("detail.movieName").alias("movie_name"),
        F.col("detail.hallName").alias("hall_name"),
        F.col("detail.startTime").alias("start_time"),
        F.array_join("detail.seats", ", ").alias("seats"),
    )


@plan(
    "payment_payloads",
    with_views(
        """SELECT payment_id, '{"id":"' || payment_id || '","email":"' || email || '","price":' || CAST(price AS VARCHAR)
           || ',"createOn":"' || create_on || '","status":"' || status || '","detail":{"movieName":"' || movie_name
           || '","hallName":"' || hall_name || '","startTime":"' || start_time || '","seats":['
           || CASE WHEN seats = '' THEN '' ELSE '"' || replace(seats, ', ', '","') || '"' END || ']}}' AS payload
           FROM payment_report""",
        "payments",
        *REPORT_VIEWS,
        **_PAYMENT_REPORT,
    ),
)
def _payloads(v: Views) -> DataFrame:
    return P.payload(payment_report(v))


@plan(
    "payment_notifications",
    with_views(
        """SELECT payment_id, email AS recipient, 'Ticket: Payment Information' AS subject,
           'Payment ID: ' || payment_id || chr(10) || 'Total amount: ' || CAST(price AS VARCHAR) || chr(10)
           || 'Create at: ' || create_on || chr(10) || 'Movie name: ' || movie_name || chr(10) || 'Hall name: '
           || hall_name || chr(10) || 'Start time: ' || start_time || chr(10) || 'Seats: ' || seats AS body
           FROM payment_report WHERE status = 'PAID'""",
        "payments",
        *REPORT_VIEWS,
        **_PAYMENT_REPORT,
    ),
)
def _notifications(v: Views) -> DataFrame:
    return P.notifications(payment_report(v))


@plan(
    "reconcile_payments",
    with_views(
        """SELECT p.payment_id, p.txn_ref, p.status, CASE WHEN p.status <> 'PENDING' THEN p.status
             WHEN g.response_code = '00' AND g.amount_minor = CAST(round(p.amount * 100) AS BIGINT)
               AND g.txn_type = '01' AND g.txn_status = '00' THEN 'PAID' ELSE 'CANCLED' END AS new_status
           FROM payments p JOIN gateway_responses g USING (txn_ref)""",
        "payments",
        "gateway_responses",
    ),
)
def _reconcile(v: Views) -> DataFrame:
    return P.reconcile(v.payments, v.gateway_responses).select("payment_id", "txn_ref", "status", "new_status")


@plan(
    "hashed_keys",
    with_views(
        """SELECT booking_id, sha256(booking_id || '&' || payment_id || '&' || full_name || '&' || txn_ref) AS hash
           FROM payments JOIN bookings USING (booking_id) JOIN users USING (user_id)""",
        "payments",
        "bookings",
        "users",
    ),
)
def _hashed(v: Views) -> DataFrame:
    named = P.of_users(v.payments, v.bookings).join(v.users.select("user_id", "full_name"), "user_id")
    fields = [F.col(c) for c in ("booking_id", "payment_id", "full_name", "txn_ref")]
    return named.select("booking_id", joined_hash(*fields).alias("hash"))


@plan(
    "txn_refs",
    with_views(
        """SELECT payment_id, substr(replace(payment_id || '-' || md5(booking_id), '-', ''), 1, 16)
             || lpad(CAST(CAST(booking_id AS BIGINT) % 10000 AS VARCHAR), 4, '0') AS new_ref FROM payments""",
        "payments",
    ),
)
def _txn_refs(v: Views) -> DataFrame:
    long_id = F.concat_ws("-", "payment_id", F.md5("booking_id"))
    suffix = F.lpad((F.col("booking_id").cast("long") % 10000).cast("string"), 4, "0")
    return v.payments.select("payment_id", txn_ref(long_id, suffix).alias("new_ref"))


@plan(
    "billing_names",
    with_views(
        """SELECT user_id, split_part(trim(full_name), ' ', 1) AS first_name,
             split_part(trim(full_name), ' ', -1) AS last_name FROM users""",
        "users",
    ),
)
def _billing(v: Views) -> DataFrame:
    name = F.col("full_name")
    return v.users.select("user_id", first_name(name).alias("first_name"), last_name(name).alias("last_name"))
