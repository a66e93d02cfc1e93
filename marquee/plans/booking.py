from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.business import show_time_text
from marquee.operators import bookings as B
from marquee.plans.oracle import with_views
from marquee.plans.registry import plan
from marquee.session import stored
from marquee.sources.testdata import Views

AS_OF = "1999-06-01 12:07:00"  # some of the given pending bookings are younger


@plan(
    "bookings_by_status",
    with_views("SELECT booking_id, user_id, show_id, create_at FROM bookings WHERE status = 'PENDING'", "bookings"),
)
def _by_status(v: Views) -> DataFrame:
    return B.by_status(v.bookings, "PENDING").select("booking_id", "user_id", "show_id", "create_at")


@plan(
    "user_bookings",
    with_views(
        "SELECT b.* FROM bookings b JOIN booking_lookups l ON l.booking_id = b.booking_id AND l.user_id = b.user_id",
        "bookings",
        "booking_lookups",
    ),
)
def _user_bookings(v: Views) -> DataFrame:
    return B.owned(v.bookings, v.booking_lookups).select("booking_id", "user_id", "show_id", "status", "create_at")


@plan(
    "bookings_user_movie_status",
    with_views(
        "SELECT user_id, movie_id, booking_id, show_id FROM bookings JOIN shows USING (show_id) WHERE status = 'CANCLED'",
        "bookings",
        "shows",
    ),
)
def _user_movie(v: Views) -> DataFrame:
    return B.of_user_movie(v.bookings, v.shows, "CANCLED").select("user_id", "movie_id", "booking_id", "show_id")


@plan(
    "paid_bookings_movies",
    with_views(
        "SELECT booking_id, user_id, show_id, movie_id, title FROM bookings JOIN shows USING (show_id) "
        "JOIN movies USING (movie_id) WHERE status = 'BOOKED'",
        "bookings",
        "shows",
        "movies",
    ),
)
def _paid(v: Views) -> DataFrame:
    return B.paid_with_movies(v.bookings, v.shows, v.movies).select("booking_id", "user_id", "show_id", "movie_id", "title")


def report(v: Views) -> DataFrame:
    return B.booking_report(v.bookings, v.booking_seats, v.users, v.shows, v.movies, v.halls)


# Bookings with names, seats and price; reused by the payment oracles.
REPORT_SQL = {
    "report": """SELECT b.*, u.username, u.full_name, u.email, s.hall_id, s.movie_id, s.start_time,
                   m.title AS movie_name, h.name AS hall_name, coalesce(p.price, 0) AS price,
                   coalesce((SELECT string_agg(h.name || CAST(q.row_index AS VARCHAR) || '.'
                     || CAST(q.col_index AS VARCHAR), ', ' ORDER BY q.row_index, q.col_index)
                     FROM booking_seats q WHERE q.booking_id = b.booking_id), '') AS seats
                 FROM bookings b JOIN users u USING (user_id) JOIN shows s USING (show_id)
                 JOIN movies m USING (movie_id) JOIN halls h USING (hall_id)
                 LEFT JOIN prices p USING (booking_id)""",
}
REPORT_VIEWS = ("bookings", "users", "shows", "movies", "halls", "booking_seats", "prices")


@plan(
    "booking_report",
    with_views(
        "SELECT booking_id, show_id, username, full_name, price, seats, movie_name, hall_name, "
        "strftime(start_time, '%H:%M - %d/%m/%Y') AS start_time, create_at, status FROM report",
        *REPORT_VIEWS,
        **REPORT_SQL,
    ),
)
def _report(v: Views) -> DataFrame:
    return report(v).select(
        "booking_id",
        "show_id",
        "username",
        "full_name",
        "price",
        F.array_join("seats", ", ").alias("seats"),
        "movie_name",
        "hall_name",
        show_time_text(F.col("start_time")).alias("start_time"),
        "create_at",
        "status",
    )


@plan(
    "bookings_per_show",
    with_views("SELECT show_id, count(*) AS n FROM bookings GROUP BY show_id", "bookings"),
)
def _per_show(v: Views) -> DataFrame:
    return B.per_show(v.bookings)


@plan(
    "payable_bookings",
    with_views(
        "SELECT booking_id, user_id, coalesce(price, 0) AS amount FROM bookings b LEFT JOIN prices USING (booking_id) "
        "WHERE status = 'PENDING' AND NOT EXISTS (SELECT 1 FROM payments p WHERE p.booking_id = b.booking_id)",
        "bookings",
        "prices",
        "payments",
    ),
)
def _payable(v: Views) -> DataFrame:
    return B.payable(v.bookings, v.booking_seats, v.payments).select("booking_id", "user_id", "amount")


@plan(
    "payment_requests_checked",
    with_views(
        """SELECT r.request_id, r.booking_id, r.username, j.reason IS NULL AS accepted, j.reason,
             CASE WHEN j.reason IS NULL THEN coalesce(p.price, 0) END AS amount
           FROM payment_requests r JOIN judged j USING (request_id) LEFT JOIN prices p ON p.booking_id = r.booking_id""",
        "payment_requests",
        "bookings",
        "users",
        "prices",
        "payments",
        judged="""SELECT r.request_id, CASE WHEN b.booking_id IS NULL THEN 'Ticket ID ' || r.booking_id || ' is not found'
            WHEN b.status <> 'PENDING' THEN 'This ticket have been already paid or canceled before.'
            WHEN r.booking_id IN (SELECT booking_id FROM payments) THEN 'This ticket have been already pending for payment.'
            WHEN u.username IS DISTINCT FROM r.username THEN 'Ticket ID ' || r.booking_id || ' is not found' END AS reason
            FROM payment_requests r LEFT JOIN bookings b ON b.booking_id = r.booking_id
            LEFT JOIN users u ON u.user_id = b.user_id""",
    ),
)
def _payment_requests(v: Views) -> DataFrame:
    checked = B.check_payment_requests(v.payment_requests, v.bookings, v.users, v.booking_seats, v.payments)
    return checked.select("request_id", "booking_id", "username", "accepted", "reason", "amount")


@plan(
    "booking_requests_checked",
    with_views(
        """SELECT request_id, user_id, show_id, coalesce(early, replay.reason) IS NULL AS accepted,
             coalesce(early, replay.reason) AS reason FROM judged LEFT JOIN replay USING (request_id, show_id)""",
        "booking_requests",
        "users",
        "shows",
        "request_seats",
        judged="""SELECT r.*, CASE WHEN r.n > 4 THEN 'You can not reverse more than 4 seats at the time.'
              WHEN u.status IS NULL THEN 'User is not found'
              WHEN u.status = 'BLACKLISTED' THEN 'You are not allowed to book ticket'
              WHEN r.show_id NOT IN (SELECT show_id FROM shows) THEN 'Show is not found' END AS early
            FROM (SELECT request_id, user_id, show_id, requested_at, count(*) AS n, list(DISTINCT seat_id) AS seats
                  FROM booking_requests GROUP BY request_id, user_id, show_id, requested_at) r
            LEFT JOIN users u USING (user_id)""",
        queue="""SELECT request_id, show_id, seats, row_number() OVER (PARTITION BY show_id
            ORDER BY requested_at, request_id) AS place FROM judged WHERE early IS NULL""",
        stock="""SELECT show_id, list(seat_id) AS known, list(seat_id) FILTER (status = 'AVAILABLE') AS free
            FROM request_seats WHERE show_id IN (SELECT show_id FROM queue) GROUP BY show_id""",
        # One request of every show at a time, in order, on the seats that are still free.
        replay="""SELECT q.show_id, CAST(0 AS BIGINT) AS place, CAST(NULL AS VARCHAR) AS request_id,
              coalesce(free, CAST([] AS VARCHAR[])) AS free, coalesce(known, CAST([] AS VARCHAR[])) AS known,
              CAST(NULL AS VARCHAR) AS reason
            FROM (SELECT DISTINCT show_id FROM queue) q LEFT JOIN stock USING (show_id)
            UNION ALL SELECT show_id, place, request_id,
              CASE WHEN reason IS NULL THEN list_filter(free, lambda x: NOT list_contains(seats, x)) ELSE free END, known, reason
            FROM (SELECT *, CASE WHEN len(free) = 0 THEN 'Sorry, seats of this show are full. Please choose another show'
                WHEN bad IS NULL THEN NULL WHEN list_contains(known, bad) THEN 'Seat ID ' || bad || ' is reserved'
                ELSE 'Not found seat id: ' || bad END AS reason
              FROM (SELECT q.show_id, q.place, q.request_id, q.seats, r.free, r.known,
                  list_min(list_filter(q.seats, lambda x: NOT list_contains(r.free, x))) AS bad
                FROM replay r JOIN queue q ON q.show_id = r.show_id AND q.place = r.place + 1))""",
    ),
)
def _checked(v: Views) -> DataFrame:
    requests = stored(v.booking_requests, "requests")  # derived here; requests proper are a stored table
    checked = B.check_requests(requests, v.users, v.shows, v.request_seats)
    return checked.select("request_id", "user_id", "show_id", "accepted", "reason")


@plan(
    "booking_transitions",
    with_views(
        """SELECT booking_id, user_id, to_status, old_status, reason,
             CASE WHEN reason IS NULL AND wanted IN ('PENDING', 'CANCLED') THEN wanted ELSE old_status END AS new_status,
             CASE WHEN reason IS NOT NULL THEN NULL WHEN wanted = 'PENDING' THEN 'PENDING'
                  WHEN wanted = 'CANCLED' THEN 'AVAILABLE' END AS seat_status,
             reason IS NULL AND wanted = 'BOOKED' AND paid IS NULL AS creates_payment FROM judged""",
        "status_requests",
        "payments",
        judged="""SELECT *, CASE WHEN old_status IS NULL THEN 'Ticket is not found'
             WHEN old_status = wanted THEN 'This ticket already have this status'
             WHEN wanted NOT IN ('PENDING', 'BOOKED', 'CANCLED') THEN 'Not found status ' || wanted
             WHEN wanted = 'CANCLED' AND old_status <> 'PENDING' THEN 'This ticket can not be cancled'
             WHEN wanted = 'BOOKED' AND coalesce(paid, false) = false AND old_status <> 'PENDING'
               THEN 'This ticket have been already paid or canceled before.'
             WHEN wanted = 'BOOKED' AND paid = false THEN 'This ticket have been already pending for payment.'
             END AS reason FROM (
               SELECT r.*, upper(r.to_status) AS wanted, b.status AS old_status, p.status = 'PAID' AS paid
               FROM status_requests r LEFT JOIN bookings b ON b.booking_id = r.booking_id AND b.user_id = r.user_id
               LEFT JOIN payments p ON p.booking_id = r.booking_id)""",
    ),
)
def _transitions(v: Views) -> DataFrame:
    return B.transitions(v.status_requests, v.bookings, v.payments).select(
        "booking_id", "user_id", "to_status", "old_status", "reason", "new_status", "seat_status", "creates_payment"
    )


def expired(v: Views) -> DataFrame:
    return B.expire_pending(v.bookings, v.payments, AS_OF)


def _expired_sql(due: str) -> str:
    return f"""SELECT b.booking_id, b.user_id, b.show_id, p.status AS payment_status,
        CAST(floor(epoch(TIMESTAMP '{AS_OF}' - b.create_at) / 60) AS BIGINT) AS age_minutes,
        CASE WHEN p.status = 'PAID' THEN 'BOOKED' ELSE 'CANCLED' END AS new_status,
        CASE WHEN p.status = 'PAID' THEN 'BOOKED' ELSE 'AVAILABLE' END AS seat_status,
        coalesce(p.status = 'CANCLED', false) AS is_spam
        FROM bookings b LEFT JOIN payments p USING (booking_id)
        WHERE b.status = 'PENDING' AND {due}"""


_EXPIRED = {
    "expired": _expired_sql(f"b.create_at <= TIMESTAMP '{AS_OF}' - INTERVAL 15 MINUTE"),
    "marks": "SELECT user_id, count(*) AS n FROM expired WHERE is_spam GROUP BY user_id",
}


def _expiry_oracle(body: str, *names: str) -> str:
    return with_views(body, "bookings", "payments", *names, **_EXPIRED)


_EXPIRED_COLUMNS = ["booking_id", "user_id", "age_minutes", "payment_status", "new_status", "seat_status", "is_spam"]


@plan("expire_pending", _expiry_oracle(f"SELECT {', '.join(_EXPIRED_COLUMNS)} FROM expired"))
def _expire(v: Views) -> DataFrame:
    return expired(v).select(*_EXPIRED_COLUMNS)


@plan(
    "expire_pending_mod60",
    with_views(
        f"SELECT {', '.join(_EXPIRED_COLUMNS)} FROM expired",
        "bookings",
        "payments",
        expired=_expired_sql("age_minutes % 60 >= 15"),
    ),
)
def _expire_mod60(v: Views) -> DataFrame:
    return B.expire_pending(v.bookings, v.payments, AS_OF, mode="mod60").select(*_EXPIRED_COLUMNS)


@plan(
    "expire_pending_seats",
    _expiry_oracle(
        "SELECT s.booking_id, e.show_id, s.seat_no, e.seat_status AS status FROM booking_seats s "
        "JOIN expired e USING (booking_id)",
        "booking_seats",
    ),
)
def _expire_seats(v: Views) -> DataFrame:
    return B.expired_seats(expired(v), v.booking_seats).select("booking_id", "show_id", "seat_no", "status")


@plan("spam_counts", _expiry_oracle("SELECT user_id, n FROM marks"))
def _spam(v: Views) -> DataFrame:
    return B.spam_counts(expired(v))


@plan(
    "blacklist_users",
    _expiry_oracle(
        "SELECT user_id, s.spam_times + coalesce(m.n, 0) AS spam_times, coalesce(m.n, 0) AS new_marks, "
        "CASE WHEN m.n > 0 AND s.spam_times + m.n >= 3 THEN 'BLACKLISTED' ELSE u.status END AS status "
        "FROM spam_users s JOIN users u USING (user_id) LEFT JOIN marks m USING (user_id)",
        "spam_users",
        "users",
    ),
)
def _blacklist(v: Views) -> DataFrame:
    return B.blacklist(v.spam_users, B.spam_counts(expired(v)), v.users)
