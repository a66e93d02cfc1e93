"""One hand-written case per rule edge."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from marquee.functions import business as X
from marquee.functions import text as T
from marquee.operators import anomaly as A
from marquee.operators import bookings as B
from marquee.operators import catalog as C
from marquee.operators import payments as P
from marquee.operators import quality as Q
from marquee.operators import recommend as M
from marquee.operators import revenue as R
from marquee.operators import shows as S

START = dt.datetime(2024, 3, 1, 10)
EVENTS = (
    "event_id string, payment_id string, user_id string, movie_id string, amount double, device_ip string, "
    "event_time timestamp_ntz, status string, location string, return_code string"
)


def events(spark, *rows, **same):
    """Events from (seconds, changes) pairs."""
    base = {"payment_id": None, "user_id": "u", "movie_id": "1", "amount": 1.0, "device_ip": "a", "status": "PAID",
            "location": "VN", "return_code": None, **same}
    made = []
    for i, (seconds, changes) in enumerate(rows):
        r = {**base, "event_id": f"{i:03d}", "event_time": START + dt.timedelta(seconds=seconds), **changes}
        r["payment_id"] = r["payment_id"] or f"p{i}"
        made.append(tuple(r[c.split()[0]] for c in EVENTS.split(", ")))
    return spark.createDataFrame(made, EVENTS)


def fired(df, kind):
    logs = A.anomaly_logs(A.with_history(df))
    return sorted(int(r.event_id) for r in logs.filter(F.col("type") == kind).collect())


def test_dedup_does_not_refresh(spark):
    df = events(spark, *[(t, {}) for t in (0, 1000, 3599, 3600, 3700, 7200)], payment_id="p")
    kept = sorted((r.event_time - START).seconds for r in R.dedup_events(df).collect())
    assert kept == [0, 3600, 7200]


@pytest.mark.parametrize(
    ("times", "hits"), [((0, 15, 30), [2]), ((0, 15, 30.001), []), ((5, 5, 5), [2]), ((0, 1, 2, 3), [2, 3])]
)
def test_fast_transactions(spark, times, hits):
    assert fired(events(spark, *[(t, {}) for t in times]), "MULTIPLE_FAST_TRANSACTION") == hits


def test_device_change(spark):
    df = events(spark, *[(100 * i, {"device_ip": ip}) for i, ip in enumerate("aaba")])
    assert fired(df, "DEVICE_CHANGE") == [2, 3]
    nobody = events(spark, *[(i, {"device_ip": ip}) for i, ip in enumerate("abab")], user_id=None)
    assert fired(nobody, "DEVICE_CHANGE") == fired(nobody, "MULTIPLE_FAST_TRANSACTION") == []


def amounts(*values):
    return [(100 * i, {"amount": float(a)}) for i, a in enumerate(values)]


def test_zscore(spark):
    assert fired(events(spark, *amounts(1, 2, 1, 2, 900)), "AMOUNT_ZSCORE") == []
    assert fired(events(spark, *amounts(1, 2, 1, 2, 1, 900)), "AMOUNT_ZSCORE") == [5]
    assert fired(events(spark, *amounts(5, 5, 5, 5, 5, 900)), "AMOUNT_ZSCORE") == []
    twenty = [1, 2] * 10
    assert fired(events(spark, *amounts(9000, *twenty, 20)), "AMOUNT_ZSCORE") == [21]
    late = amounts(1, 2, 1, 2, 1) + [(400 + 30 * 86_400, {"amount": 900.0})]
    assert fired(events(spark, *late), "AMOUNT_ZSCORE") == []
    in_time = amounts(1, 2, 1, 2, 1) + [(399 + 30 * 86_400, {"amount": 900.0})]
    assert fired(events(spark, *in_time), "AMOUNT_ZSCORE") == [5]


def test_high_amount(spark):
    df = events(spark, *amounts(999_999.99, 1_000_000), user_id=None)
    assert fired(df, "HIGH_AMOUNT") == [1]


def test_failed_but_charged(spark):
    cases = [("failed", "0"), ("FAILED", "00"), ("FAILED", None), ("PAID", "0")]
    df = events(spark, *[(1000 * i, {"status": s, "return_code": c}) for i, (s, c) in enumerate(cases)])
    assert fired(df, "FAILED_BUT_CHARGED") == [0]


def test_log_view_and_stats(spark):
    logs = A.anomaly_logs(A.with_history(events(spark, *amounts(2e6, 3e6))))
    view = A.log_view(logs.withColumn("description", F.lit(None).cast("string"))).collect()
    assert [(r.short_id, r.description) for r in view] == [("001-HIGH...", "N/A"), ("000-HIGH...", "N/A")]
    stats = A.anomaly_stats(logs, "2024-03-01").first()
    assert stats.by_type == {"HIGH_AMOUNT": 2} and [(r.date, r.n) for r in stats.by_date] == [(dt.date(2024, 3, 1), 2)]
    assert A.anomaly_stats(logs, "2024-03-08").first().by_date == []


def test_top_movies_ties_descend_as_text(spark):
    counts = spark.createDataFrame([("d", str(m), 2) for m in (9, 10, 3)] + [("d", "1", 5)], "date string, movie_id string, n long")
    got = [r.movie_id for r in R.top_movies(counts, 3).orderBy("place").collect()]
    assert got == ["1", "9", "3"]


def test_hourly_revenue(spark):
    base = dt.datetime(2024, 3, 1)
    shift = (base - START).total_seconds()
    df = events(spark, (shift + 3599, {"status": "CANCLED"}), (shift + 3600, {}), amount=2.0)
    hours = R.hourly_revenue(df)
    assert sorted((r.hour, r.revenue) for r in hours.collect()) == [(0, 2.0), (1, 2.0)]
    assert [(r.hour, r.revenue) for r in R.hourly_revenue(df, paid_only=True).collect()] == [(1, 2.0)]
    assert R.hourly_revenue(df, zone="Asia/Ho_Chi_Minh").agg(F.min("hour")).first()[0] == 7
    assert R.revenue_of_day_before(hours, "2024-03-02").first().revenue == 4.0
    assert R.revenue_of_day_before(hours, "2024-03-01").count() == 0


def test_cosine(spark):
    pairs = spark.createDataFrame([("u", 1), ("u", 2), ("v", 1)], "user_id string, movie_id long")
    users = spark.createDataFrame([("u", "a", 2), ("u", "b", 1)], "user_id string, genre string, weight long")
    movies = spark.createDataFrame([(1, "a", 1), (1, "c", 1)], "movie_id long, genre string, weight int")
    got = {(r.user_id, r.movie_id): r.cosine for r in M.cosines(pairs, users, movies).collect()}
    assert got[("u", 1)] == pytest.approx(2 / (math.sqrt(5) * math.sqrt(2)))
    assert got[("u", 2)] == got[("v", 1)] == 0.0


def test_recommend_fills_and_cold_start(spark):
    watched = spark.createDataFrame([("u", 1, 1), ("w", 9, 1)], "user_id string, movie_id long, n long")
    genre = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c")], "movie_id long, genre string")
    got = M.recommend(watched, genre, 3).orderBy("place").collect()
    assert [(r.user_id, r.movie_id, r.score) for r in got] == [("u", 2, 1.0), ("u", 3, 0.0), ("u", 4, 0.0)]
    movies = spark.range(12).selectExpr("id AS movie_id", "timestamp_ntz'2024-01-01' + make_dt_interval(id) AS created_at")
    users = spark.createDataFrame([("u",), ("w",), ("x",)], "user_id string")
    cold = M.recommend_cold(users, watched, genre, movies).collect()
    assert {r.user_id for r in cold} == {"w", "x"}  # w watched only a movie without genres
    assert sorted(r.movie_id for r in cold if r.user_id == "x") == list(range(2, 12))


def shows(spark, *rows):
    """(id, start minute, end minute) in one hall."""
    made = [(i, "h", START + dt.timedelta(minutes=s), START + dt.timedelta(minutes=e)) for i, s, e in rows]
    return spark.createDataFrame(made, "show_id string, hall_id string, start_time timestamp_ntz, end_time timestamp_ntz")


def test_show_conflicts(spark):
    old = shows(spark, ("a", 0, 60), ("b", 100, 110))
    new = shows(spark, ("touch", 60, 70), ("enclose", 90, 120), ("free", 61, 99))
    got = {r.show_id: (r.n_conflicts, r.conflict_with) for r in S.conflicts(new, old).collect()}
    assert got == {"touch": (1, "a"), "enclose": (1, "b"), "free": (0, None)}
    endpoint = S.conflicting_shows(new, old, mode="endpoint").collect()
    assert [(r.candidate_id, r.show_id) for r in endpoint] == [("touch", "a")]
    assert S.conflicts(old, old).filter("n_conflicts > 0").count() == 0


def test_show_updates(spark):
    at = lambda m: (START + dt.timedelta(minutes=m)).strftime("%d/%m/%Y %H:%M")
    old = shows(spark, ("a", 0, 70), ("b", 100, 170)).withColumn("movie_id", F.lit(1).cast("long"))
    halls = spark.createDataFrame([("h",), ("g",)], "hall_id string")
    movies = spark.createDataFrame([(1, 60)], "movie_id long, duration_mins int")
    asked = [("a", "h", 1, at(10)), ("b", "h", 1, at(60)), ("c", "h", 1, at(0)), ("a", "q", 1, at(0)), ("b", "h", 9, at(0)), ("b", "g", 1, "x")]
    updates = spark.createDataFrame(asked, "show_id string, hall_id string, movie_id long, start_text string")
    got = {(r.show_id, r.hall_id, r.movie_id): (r.reason, r.resets_seats) for r in S.update_shows(old, updates.filter("start_text = '%s'" % at(10)), halls, movies).collect()}
    assert got == {("a", "h", 1): (None, False)}  # overlaps only its own old time
    got = S.update_shows(old, updates, halls, movies).collect()
    assert sorted((r.show_id, r.hall_id, r.reason, r.resets_seats) for r in got if r.reason) == [
        ("a", "q", "Hall is not found", False),
        ("b", "h", "Conflict start/end time with show ID: a", False),
        ("b", "h", "Movie is not found", False),
        ("c", "h", "Show not found", False),
    ]
    moved = next(r for r in got if r.hall_id == "g")
    assert moved.resets_seats and moved.start_time == START + dt.timedelta(minutes=100)


BOOKINGS = "booking_id string, user_id string, show_id string, status string, create_at timestamp_ntz"
PAYMENTS = "payment_id string, booking_id string, amount double, status string, txn_ref string, create_at timestamp_ntz"


def test_update_that_overlaps_its_own_time_names_the_other_show(spark):
    at = lambda m: (START + dt.timedelta(minutes=m)).strftime("%d/%m/%Y %H:%M")
    old = shows(spark, ("a", 0, 70), ("b", 80, 150), ("c", 155, 220)).withColumn("movie_id", F.lit(1).cast("long"))
    halls, movies = spark.createDataFrame([("h",)], "hall_id string"), spark.createDataFrame([(1, 60)], "movie_id long, duration_mins int")
    schema = "show_id string, hall_id string, movie_id long, start_text string"
    for start, reason in ((60, "a"), (90, "c"), (84, None), (10, "a"), (75, None)):
        update = spark.createDataFrame([("b", "h", 1, at(start))], schema)
        got = S.update_shows(old, update, halls, movies).first().reason
        assert got == (reason and f"Conflict start/end time with show ID: {reason}"), start


def test_pending_expiry(spark):
    minutes = {"b14": 14, "b15": 15, "b62": 62, "b80": 80}
    made = [(b, "u", "s", "PENDING", START - dt.timedelta(minutes=m)) for b, m in minutes.items()]
    bookings = spark.createDataFrame([*made, ("done", "u", "s", "BOOKED", START - dt.timedelta(days=1))], BOOKINGS)
    payments = spark.createDataFrame(
        [("p1", "b15", 1.0, "PAID", "t", START), ("p2", "b62", 1.0, "CANCLED", "t", START), ("p3", "b80", 1.0, "PENDING", "t", START)],
        PAYMENTS,
    )
    at = START.isoformat(sep=" ")
    got = {r.booking_id: (r.new_status, r.seat_status, r.is_spam) for r in B.expire_pending(bookings, payments, at).collect()}
    assert got == {
        "b15": ("BOOKED", "BOOKED", False),
        "b62": ("CANCLED", "AVAILABLE", True),
        "b80": ("CANCLED", "AVAILABLE", False),
    }
    assert {r.booking_id for r in B.expire_pending(bookings, payments, at, mode="mod60").collect()} == {"b15", "b80"}


def test_blacklist(spark):
    stored = spark.createDataFrame([("a", 2), ("b", 0), ("c", 5)], "user_id string, spam_times int")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("d", 3)], "user_id string, n long")
    users = spark.createDataFrame([(u, "ACTIVE") for u in "abcd"], "user_id string, status string")
    got = {r.user_id: (r.spam_times, r.status) for r in B.blacklist(stored, new, users).collect()}
    assert got == {"a": (3, "BLACKLISTED"), "b": (2, "ACTIVE"), "c": (5, "ACTIVE"), "d": (3, "BLACKLISTED")}


def test_login_throttle(spark):
    times = [0, 10, 20, 30, 40, 50, 59.9, 60, 61]
    made = [(f"a{i}", "ip:user", START + dt.timedelta(seconds=t)) for i, t in enumerate(times)]
    df = spark.createDataFrame(made, "attempt_id string, login_key string, ts timestamp_ntz")
    got = {r.attempt_id: (r.attempt_no, r.rejected) for r in Q.login_throttle(df).collect()}
    assert [a for a, (_, rejected) in sorted(got.items()) if rejected] == ["a5", "a6"]
    assert got["a7"] == (1, False) and got["a8"] == (2, False)


def check(spark, *requests):
    """Requests (id, user, show, minute, seats) against one show s of seats 1-6, seat 6 taken, and a full show f."""
    made = [(i, u, s, START + dt.timedelta(minutes=m), seats) for i, u, s, m, seats in requests]
    df = spark.createDataFrame(
        made, "request_id string, user_id string, show_id string, requested_at timestamp_ntz, seat_ids array<string>"
    )
    users = spark.createDataFrame([("u", "ACTIVE"), ("bad", "BLACKLISTED")], "user_id string, status string")
    seats = [("s", str(i), "AVAILABLE") for i in range(1, 6)] + [("s", "6", "BOOKED"), ("f", "f1", "PENDING")]
    show_seats = spark.createDataFrame(seats, "show_id string, seat_id string, status string")
    checked = B.check_requests(df, users, show_seats.select("show_id").distinct(), show_seats)
    return {r.request_id: r.reason for r in checked.collect()}


def test_booking_requests(spark):
    got = check(
        spark,
        ("five", "u", "s", 0, ["1", "2", "3", "4", "5"]),
        ("nobody", "x", "s", 0, ["1"]),
        ("barred", "bad", "s", 0, ["1"]),
        ("noshow", "u", "q", 0, ["1"]),
        ("full", "u", "f", 0, ["f1"]),
        ("taken", "u", "s", 0, ["6"]),
        ("unknown", "u", "s", 0, ["7"]),
        ("twice", "u", "s", 0, ["1", "1"]),
    )
    assert got == {
        "five": "You can not reverse more than 4 seats at the time.",
        "nobody": "User is not found",
        "barred": "You are not allowed to book ticket",
        "noshow": "Show is not found",
        "full": "Sorry, seats of this show are full. Please choose another show",
        "taken": "Seat ID 6 is reserved",
        "unknown": "Not found seat id: 7",
        "twice": None,
    }


def test_competing_requests_in_order_of_time(spark):
    chain = [
        ("a", "u", "s", 1, ["1", "2"]),
        ("b", "u", "s", 2, ["2", "3"]),  # loses 2 to a, so 3 stays free
        ("c", "u", "s", 3, ["3", "4"]),  # gets it
        ("d", "u", "s", 4, ["4"]),  # a, c and e have all five seats
        ("e", "u", "s", 0, ["5"]),
        ("z", "u", "s", 0, ["5"]),  # same instant: id decides
    ]
    assert check(spark, *chain) == {
        "a": None, "b": "Seat ID 2 is reserved", "c": None, "e": None, "z": "Seat ID 5 is reserved",
        "d": "Sorry, seats of this show are full. Please choose another show",
    }


def test_find_halls(spark):
    halls = spark.createDataFrame([(1, "A", 5, 6), (2, "B", 7, 8)], "hall_id long, name string, total_row int, total_col int")
    by_id = S.find_halls(halls, spark.createDataFrame([(1,), (3,), (None,)], "hall_id long"), "hall_id")
    assert {(r.hall_id, r.name, r.capacity, r.reason) for r in by_id.collect()} == {
        (1, "A", 30, None), (3, None, None, "Hall is not found"), (None, None, None, "Hall is not found"),
    }
    by_name = S.find_halls(halls, spark.createDataFrame([("B",), ("b",)], "name string"), "name")
    assert {(r.name, r.hall_id, r.reason) for r in by_name.collect()} == {("B", 2, None), ("b", None, "Hall is not found")}


def test_requests_for_a_show_that_fills_up(spark):
    full = "Sorry, seats of this show are full. Please choose another show"
    got = check(
        spark,
        ("a", "u", "s", 1, ["1", "2", "3", "4"]),
        ("b", "u", "s", 2, ["5", "9"]),  # no seat 9, so 5 stays free
        ("c", "u", "s", 3, ["4", "5"]),
        ("d", "u", "s", 4, ["5"]),  # the last one
        ("e", "u", "s", 5, ["5"]),
        ("f", "u", "s", 6, ["9"]),
        ("g", "x", "s", 7, ["9"]),
    )
    assert got == {
        "a": None, "b": "Not found seat id: 9", "c": "Seat ID 4 is reserved", "d": None, "e": full, "f": full,
        "g": "User is not found",
    }


def test_the_first_reserved_seat_is_named(spark):
    got = check(
        spark,
        ("a", "u", "s", 1, ["3"]),
        ("b", "u", "s", 2, ["3", "4"]),
        ("c", "u", "s", 3, ["1", "4"]),  # decided after d has lost to a
        ("d", "u", "s", 4, ["1", "3"]),
        ("e", "u", "s", 5, ["2", "4", "6"]),  # 6 is reserved from the start, 4 before it
    )
    assert got == {
        "a": None, "b": "Seat ID 3 is reserved", "c": None, "d": "Seat ID 1 is reserved", "e": "Seat ID 4 is reserved",
    }


def test_payment_requests(spark):
    bookings = spark.createDataFrame([(b, "u", "s", x, START) for b, x in
        [("p", "PENDING"), ("q", "PENDING"), ("r", "PENDING"), ("b", "BOOKED"), ("c", "CANCLED")]], BOOKINGS)
    users = spark.createDataFrame([("u", "ann")], "user_id string, username string")
    seats = spark.createDataFrame([("p", 1.5), ("p", 2.0)], "booking_id string, price double")
    payments = spark.createDataFrame([("1", "q", 1.0, "CANCLED", "t", START), ("2", "q", 1.0, "PENDING", "t", START)], PAYMENTS)
    asked = [("p", "ann"), ("p", "bob"), ("p", None), ("q", "bob"), ("r", "ann"), ("b", "ann"), ("c", "bob"), ("z", "ann")]
    requests = spark.createDataFrame(asked, "booking_id string, username string")
    got = {(r.booking_id, r.username): (r.amount, r.reason)
           for r in B.check_payment_requests(requests, bookings, users, seats, payments).collect()}
    settled, missing = "This ticket have been already paid or canceled before.", "Ticket ID %s is not found"
    assert got == {
        ("p", "ann"): (3.5, None), ("p", "bob"): (None, missing % "p"), ("p", None): (None, missing % "p"),
        ("q", "bob"): (None, "This ticket have been already pending for payment."), ("r", "ann"): (0.0, None),
        ("b", "ann"): (None, settled), ("c", "bob"): (None, settled), ("z", "ann"): (None, missing % "z"),
    }


def test_transitions(spark):
    bookings = spark.createDataFrame(
        [("p", "u", "s", "PENDING", START), ("b", "u", "s", "BOOKED", START), ("c", "u", "s", "CANCLED", START),
         ("q", "u", "s", "PENDING", START), ("r", "u", "s", "PENDING", START)], BOOKINGS)
    payments = spark.createDataFrame([("1", "q", 1.0, "PENDING", "t", START), ("2", "r", 1.0, "PAID", "t", START)], PAYMENTS)
    asked = [("p", "x", "BOOKED"), ("p", "u", "pending"), ("p", "u", "cancled"), ("b", "u", "cancled"), ("p", "u", "booked"),
             ("c", "u", "booked"), ("q", "u", "booked"), ("r", "u", "booked"), ("b", "u", "pending"), ("p", "u", "gone")]
    requests = spark.createDataFrame(asked, "booking_id string, user_id string, to_status string")
    got = {
        (r.booking_id, r.user_id, r.to_status): (r.new_status, r.seat_status, r.creates_payment, r.reason)
        for r in B.transitions(requests, bookings, payments).collect()
    }
    assert got == {
        ("p", "x", "BOOKED"): (None, None, False, "Ticket is not found"),
        ("p", "u", "pending"): ("PENDING", None, False, "This ticket already have this status"),
        ("p", "u", "cancled"): ("CANCLED", "AVAILABLE", False, None),
        ("b", "u", "cancled"): ("BOOKED", None, False, "This ticket can not be cancled"),
        ("p", "u", "booked"): ("PENDING", None, True, None),
        ("c", "u", "booked"): ("CANCLED", None, False, "This ticket have been already paid or canceled before."),
        ("q", "u", "booked"): ("PENDING", None, False, "This ticket have been already pending for payment."),
        ("r", "u", "booked"): ("PENDING", None, False, None),
        ("b", "u", "pending"): ("PENDING", "PENDING", False, None),
        ("p", "u", "gone"): ("PENDING", None, False, "Not found status GONE"),
    }


def test_reconcile(spark):
    good = ("00", 1050, "01", "00")
    answers = {"ok": good, "code": ("24", *good[1:]), "amount": ("00", 1051, "01", "00"), "type": ("00", 1050, "02", "00"),
               "state": ("00", 1050, "01", "02"), "late": good}
    payments = [(i, "b", 10.5, "PAID" if i == "late" else "PENDING", i, START) for i in [*answers, "unanswered"]]
    responses = spark.createDataFrame(
        [(i, *a) for i, a in answers.items()],
        "txn_ref string, response_code string, amount_minor long, txn_type string, txn_status string",
    )
    got = {r.payment_id: r.new_status for r in P.reconcile(spark.createDataFrame(payments, PAYMENTS), responses).collect()}
    assert got == {"ok": "PAID", "late": "PAID", "unanswered": "PENDING", **dict.fromkeys(("code", "amount", "type", "state"), "CANCLED")}


def test_feed_rejects(spark):
    good = '{"paymentId":"p","userId":"u","movieId":"1","amount":2.5,"time":"2024-03-01T10:00:00Z","extra":1}'
    records = spark.createDataFrame(
        [("1", good), ("1", "nonsense"), ("1", good.replace('"userId":"u",', "")), ("1", good.replace("2.5", '"x"'))], "key string, value string"
    )
    events_, rejects = P.split_feed(records)
    row = events_.first()
    assert events_.count() == 1 and (row.payment_id, row.amount, row.return_code) == ("p", 2.5, None)
    assert sorted(r.reason for r in rejects.collect()) == ["missing userId", "not readable", "not readable"]


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_show_times(spark):
    start = X.parse_request_time(F.lit("08/06/2023 14:00"))
    assert one(spark, X.show_end(start, F.lit(92))) == dt.datetime(2023, 6, 8, 15, 42)
    for bad in ("x", "31/02/2023 14:00", ""):
        assert one(spark, X.parse_request_time(F.lit(bad))) is None
    assert one(spark, X.show_time_text(start)) == "14:00 - 08/06/2023"
    assert one(spark, X.iso_minutes(start)) == "2023-06-08T14:00"


def test_text_functions(spark):
    assert "duong" in one(spark, T.fold_accents(F.lit("Đường")))
    assert one(spark, T.fold_accents(F.lit("ÀÉỊỖỰỸ"))) == "aeiouy"
    assert one(spark, T.escape_html(F.lit("a<b&\"c\">'"))) == "a&lt;b&amp;&#34;c&#34;&gt;&#39;"
    assert one(spark, T.duration_text(F.lit(59))) == "59 phút" and one(spark, T.duration_text(F.lit(125))) == "2 giờ 5 phút"
    assert one(spark, T.role_text(F.array(F.lit("ROLE_USER"), F.lit("ADMIN")))) == "USER, ADMIN"
    assert one(spark, T.txn_ref(F.lit("12345678-9abc-def0-1234"), F.lit("0042"))) == "123456789abcdef00042"
    assert one(spark, T.stars(F.lit(3))) == "♥♥♥" and one(spark, T.stars(F.lit(-1))) == ""
    assert one(spark, T.first_name(F.lit(" An Binh Chi "))) == "An" and one(spark, T.last_name(F.lit(" An Binh Chi "))) == "Chi"
    assert one(spark, T.joined_hash(F.lit("a"), F.lit("b"))) == one(spark, F.sha2(F.lit("a&b"), 256))


@pytest.mark.parametrize(
    ("value", "flags"),
    [
        ("a.b@c.org", {"is_email"}),
        ("please SELECT one", {"has_sql"}),
        ("selected", {"is_normal_text", "is_username"}),
        ("1 union", {"has_sql"}),
        ("text\nwith drop table", {"has_sql"}),
        ("a<b", {"has_xss"}),
        ("ends with >", set()),
        ("Passw0rd!", {"is_good_password", "is_normal_text"}),
        ("Passw0rd+x", {"is_good_password"}),
        ("Pass w0rd+", set()),
        ("", {"is_normal_text"}),
    ],
)
def test_quality_flags(spark, value, flags):
    row = spark.createDataFrame([(value,)], "v string").select(*[c.alias(n) for n, c in T.quality_flags(F.col("v")).items()]).first()
    found = {n for n, hit in row.asDict().items() if hit}
    assert found == flags


def test_halls_and_seats(spark):
    halls = spark.createDataFrame([("h", "H", 2, 3)], "hall_id string, name string, total_row int, total_col int")
    seats = S.hall_seats(halls)
    assert sorted(r.seat_name for r in seats.collect()) == ["H0.0", "H0.1", "H0.2", "H1.0", "H1.1", "H1.2"]
    assert {(r.seat_type, r.status, r.price) for r in seats.collect()} == {("REGULAR", "AVAILABLE", 10000.0)}
    edits = spark.createDataFrame(
        [("h", 0, 0, "premium", "unavailable"), ("h", 0, 1, "vip", "AVAILABLE"), ("h", 9, 9, "REGULAR", "AVAILABLE"), ("h", 0, 2, "REGULAR", "?")],
        "hall_id string, row_index int, col_index int, new_type string, new_status string",
    )
    got = {(r.row_index, r.col_index): (r.seat_type, r.status, r.price, r.reason) for r in S.edit_seats(seats, edits).collect()}
    assert got[(0, 0)] == ("PREMIUM", "UNAVAILABLE", 20000.0, None)
    assert got[(0, 1)][:3] == ("REGULAR", "AVAILABLE", 10000.0) and got[(0, 1)][3].startswith("Invalid seat type")
    assert got[(9, 9)] == (None, None, None, "Seat not found") and got[(0, 2)][3].startswith("Status is not found")
    assert got[(1, 1)] == ("REGULAR", "AVAILABLE", 10000.0, None)


def test_hall_checks(spark):
    halls = spark.createDataFrame(
        [("1", "A", 5, 5), ("2", "B", 4, 9), ("3", "C", 9, 9), ("4", "C", 9, 9), ("5", "x; drop", 4, 9), ("6", None, 9, 4)],
        "hall_id string, name string, total_row int, total_col int",
    )
    got = {r.hall_id: r.reason for r in Q.invalid_halls(halls).collect()}
    small = "Row/Column number must be greater than 5"
    assert got == {
        "2": small, "3": "This hall is existed", "4": "This hall is existed", "5": "Illeagal charaters in name", "6": small,
    }


def test_search(spark):
    movies = spark.createDataFrame([(1, "Đường 100%"), (2, "Duong"), (3, "x")], "movie_id long, title string")
    genre = spark.createDataFrame([(1, "Drama"), (1, "Dream"), (2, "Drama"), (3, "War")], "movie_id long, genre string")
    ids = lambda df: sorted(r.movie_id for r in df.collect())
    assert ids(C.title_search(movies, "0%")) == [1]  # % is no wildcard here
    assert ids(C.folded_search(movies, "DUONG")) == [1, 2]
    assert ids(C.genre_search(movies, genre, "dr")) == [1, 2]  # once each
    assert ids(C.genre_search(movies, genre, "w_r")) == [3]  # wildcard here
    assert ids(C.with_all_genres(movies, genre, ["Drama", "Dream"])) == [1]
    assert ids(C.contains_filter(movies, "title", "duong")) == []


def test_comment_edits(spark):
    comments = spark.createDataFrame([("1", "u", 9), ("2", "u", 3)], "comment_id string, user_id string, rated int")
    edits = [("1", "u", 9), ("2", "u", 6), ("2", "u", 0), ("2", "x", 1), ("7", "u", 1)]
    got = C.edit_comments(comments, spark.createDataFrame(edits, "comment_id string, user_id string, new_rated int"))
    assert [(r.rated, r.reason) for r in got.orderBy("comment_id", "user_id", F.desc("new_rated")).collect()] == [
        (9, None),  # unchanged, so not checked
        (3, "Rating number must be in range 0 and 5"),
        (0, None),
        (3, "This comment is not belonged to you"),
        (None, "Comment is not found"),
    ]


def test_missing_fields(spark):
    df = spark.createDataFrame([(1, "x"), (None, " "), (2, None)], "a long, b string")
    got = [r.missing for r in Q.missing_fields(df, ["a", "b"]).collect()]
    assert sorted(got) == [["a", "b"], ["b"]]


def test_chain_of_losers_in_one_job(spark):
    """Each request wants a seat of the one before it: every other one loses, and its second seat stays free."""
    n = 500
    asked = [(f"r{i:03}", "u", "s", START + dt.timedelta(seconds=i), [str(i), str(i + 1)]) for i in range(n)]
    asked += [("none", "u", "s", START, []), ("null", "u", "s", START, None)]
    df = spark.createDataFrame(
        asked, "request_id string, user_id string, show_id string, requested_at timestamp_ntz, seat_ids array<string>"
    )
    users = spark.createDataFrame([("u", "ACTIVE")], "user_id string, status string")
    seats = spark.createDataFrame([("s", str(i), "AVAILABLE") for i in range(2 * n)], "show_id string, seat_id string, status string")
    checked = B.check_requests(df, users, seats.select("show_id").distinct(), seats)
    got = {r.request_id: r.reason for r in checked.collect()}
    assert got == {"none": None, "null": None} | {f"r{i:03}": f"Seat ID {i} is reserved" if i % 2 else None for i in range(n)}


def test_many_requests_for_the_same_seats_come_down_to_one(spark):
    turns = spark.range(20_000).select(
        F.col("id").cast("string").alias("request_id"), F.lit("s").alias("show_id"), F.lit(9).alias("_open"),
        F.timestamp_seconds(20_000 - F.col("id")).alias("requested_at"), F.array((F.col("id") % 3).cast("string")).alias("seats"),
    )
    given = B._given(turns)
    assert sorted((r.request_id, r.seat_id) for r in given.collect()) == [("19997", "2"), ("19998", "0"), ("19999", "1")]
