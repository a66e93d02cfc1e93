"""Bookings: reports, request checks and set-wise state changes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee import fixed_values as V
from marquee.session import stored


def by_status(bookings: DataFrame, status: str) -> DataFrame:
    return bookings.filter(F.col("status") == status)


def owned(bookings: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked (booking, user) pairs that exist."""
    return bookings.join(asked, ["booking_id", "user_id"], "left_semi")


def of_user_movie(bookings: DataFrame, shows: DataFrame, status: str) -> DataFrame:
    """Bookings in `status` keyed by user and movie."""
    return by_status(bookings, status).join(shows.select("show_id", "movie_id"), "show_id")


def paid_with_movies(bookings: DataFrame, shows: DataFrame, movies: DataFrame) -> DataFrame:
    return of_user_movie(bookings, shows, "BOOKED").join(movies, "movie_id")


def seat_lists(booking_seats: DataFrame) -> DataFrame:
    """Price and seats of every booking; a booking cannot hold more seats than its hall."""
    return booking_seats.groupBy("booking_id").agg(
        F.sum("price").alias("price"),
        F.sort_array(F.collect_set(F.struct("row_index", "col_index"))).alias("places"),
    )


def seat_names(hall_name: Column, places: Column) -> Column:
    return F.transform(places, lambda p: F.concat(hall_name, p["row_index"].cast("string"), F.lit("."), p["col_index"].cast("string")))


def booking_report(
    bookings: DataFrame, booking_seats: DataFrame, users: DataFrame, shows: DataFrame, movies: DataFrame, halls: DataFrame
) -> DataFrame:
    """Bookings with the names behind their keys, their seats and their price."""
    return (
        bookings.join(seat_lists(booking_seats), "booking_id", "left")
        .join(users.select("user_id", "username", "full_name", "email"), "user_id")
        .join(shows.select("show_id", "hall_id", "movie_id", "start_time"), "show_id")
        .join(movies.select("movie_id", F.col("title").alias("movie_name")), "movie_id")
        .join(halls.select("hall_id", F.col("name").alias("hall_name")), "hall_id")
        .withColumn("price", F.coalesce("price", F.lit(0.0)))
        .withColumn("seats", F.coalesce(seat_names(F.col("hall_name"), F.col("places")), F.array().cast("array<string>")))
        .drop("places")
    )


def per_show(bookings: DataFrame) -> DataFrame:
    return bookings.groupBy("show_id").agg(F.count(F.lit(1)).alias("n"))


def payable(bookings: DataFrame, booking_seats: DataFrame, payments: DataFrame) -> DataFrame:
    """Pending bookings without a payment, with the amount one would charge."""
    prices = booking_seats.groupBy("booking_id").agg(F.sum("price").alias("amount"))
    return (
        by_status(bookings, "PENDING")
        .join(payments.select("booking_id"), "booking_id", "left_anti")
        .join(prices, "booking_id", "left")
        .withColumn("amount", F.coalesce("amount", F.lit(0.0)))
    )


# -- request checks -----------------------------------------------------------


def check_payment_requests(
    requests: DataFrame, bookings: DataFrame, users: DataFrame, booking_seats: DataFrame, payments: DataFrame
) -> DataFrame:
    """Payment requests (booking_id, username) with the `amount` to charge, or the first reason against them."""
    known = bookings.join(users.select("user_id", F.col("username").alias("_owner")), "user_id", "left")
    prices = booking_seats.groupBy("booking_id").agg(F.sum("price").alias("_price"))
    paying = payments.select("booking_id", F.lit(True).alias("_paying")).distinct()
    missing = F.format_string(V.TICKET_ID_NOT_FOUND, "booking_id")
    reason = (
        F.when(F.col("_status").isNull(), missing)
        .when(F.col("_status") != "PENDING", V.ALREADY_SETTLED)
        .when(F.col("_paying"), V.ALREADY_PENDING)
        .when(~F.col("username").eqNullSafe(F.col("_owner")), missing)
    )
    return (
        requests.join(known.select("booking_id", F.col("status").alias("_status"), "_owner"), "booking_id", "left")
        .join(paying, "booking_id", "left")
        .join(prices, "booking_id", "left")
        .withColumn("reason", reason)
        .withColumn("accepted", F.col("reason").isNull())
        .withColumn("amount", F.when(F.col("accepted"), F.coalesce("_price", F.lit(0.0))))
        .drop("_status", "_owner", "_paying", "_price")
    )



def check_requests(
    requests: DataFrame, users: DataFrame, shows: DataFrame, show_seats: DataFrame, max_seats: int = V.MAX_SEATS_PER_REQUEST
) -> DataFrame:
    """Every booking request with `accepted` and the first reason against it.

    Requests for a show are served in order of time (then of id), exactly as if they came one after the other: a seat
    is reserved once an earlier request got it, and a show is full once all its open seats are given away.
    """
    asked_shows = requests.select("show_id").distinct()
    show_seats = show_seats.join(asked_shows, "show_id", "left_semi")
    # A request meets the seats of its show as one list, no longer than the hall has seats.
    stock = show_seats.groupBy("show_id").agg(
        F.count_if(F.col("status") == "AVAILABLE").alias("_open"), F.collect_list(F.struct("seat_id", "status")).alias("_stock")
    )
    met = (
        requests.join(shows.select("show_id", F.lit(True).alias("_show")), "show_id", "left")
        .join(stock, "show_id", "left")
        .withColumn("_bad", _problem(F.col("seat_ids"), F.col("_stock")))
        .drop("_stock")
    )
    of_request = F.min("_bad").over(Window.partitionBy("request_id"))
    judged = stored(
        met.withColumn("_seat", F.when(F.col("request_id").isNotNull(), of_request))
        .join(users.select("user_id", F.col("status").alias("_user")), "user_id", "left")
        .select(
            *[F.col(c) for c in requests.columns],
            "_open",
            "_seat",
            F.when(F.size("seat_ids") > max_seats, V.TOO_MANY_SEATS)
            .when(F.col("_user").isNull(), V.USER_NOT_FOUND)
            .when(F.col("_user") == "BLACKLISTED", V.NOT_ALLOWED)
            .when(F.col("_show").isNull(), V.SHOW_NOT_FOUND)
            .when(F.coalesce("_open", F.lit(0)) == 0, V.SHOW_FULL)
            .alias("_reason"),
        ),
        "judged",
    )
    served = judged.filter(F.col("_reason").isNull())
    wants = served.select(
        "request_id", "requested_at", "show_id", "_open", "_seat", F.explode(F.array_distinct("seat_ids")).alias("seat_id")
    )
    free = served.filter(F.col("_seat").isNull() & (F.size("seat_ids") > 0))
    given = stored(_given(free.withColumn("seats", F.array_sort(F.array_distinct("seat_ids")))), "given")
    turn = F.struct("requested_at", "request_id")
    # an open seat is given once, so the show is full from its last one on
    filled = (
        given.groupBy("show_id")
        .agg(F.count(F.lit(1)).alias("_n"), F.max(turn).alias("_filled"), F.max("_open").alias("_open"))
        .filter("_n = _open")
        .select("show_id", "_filled")
    )
    reserved = F.struct("seat_id", F.format_string(V.SEAT_RESERVED, "seat_id").alias("text"))
    taken = (
        wants.join(given.select("show_id", "seat_id", turn.alias("_by")), ["show_id", "seat_id"])
        .filter(F.col("_by") < turn)
        .groupBy("request_id")
        .agg(F.min(reserved).alias("_taken"))
    )
    full = F.coalesce(F.col("_filled") < turn, F.lit(False))
    reason = F.coalesce("_reason", F.when(full, V.SHOW_FULL), F.least("_seat", "_taken")["text"])
    return (
        judged.join(filled, "show_id", "left")
        .join(taken, "request_id", "left")
        .withColumn("reason", reason)
        .withColumn("accepted", F.col("reason").isNull())
        .drop("_reason", "_open", "_seat", "_taken", "_filled")
    )


def _problem(seat_ids: Column, stock: Column) -> Column:
    """The least (seat_id, text) of the asked seats that the show does not have or that are not available."""
    kind = "array<struct<seat_id:string,text:string>>"
    has = F.coalesce(stock, F.array().cast("array<struct<seat_id:string,status:string>>"))

    def of_seat(seat: Column) -> Column:
        missing = F.struct(seat.alias("seat_id"), F.concat(F.lit(V.SEAT_NOT_FOUND), seat).alias("text"))
        reserved = F.struct(seat.alias("seat_id"), F.format_string(V.SEAT_RESERVED, seat).alias("text"))
        same = F.filter(has, lambda s: s["seat_id"] == seat)
        bad = F.filter(same, lambda s: s["status"].isNull() | (s["status"] != "AVAILABLE"))
        said = F.transform(bad, lambda s: F.when(s["status"].isNull(), missing).otherwise(reserved))
        return F.when(F.size(same) == 0, F.array(missing)).otherwise(said).cast(kind)

    return F.array_min(F.flatten(F.transform(F.coalesce(F.array_distinct(seat_ids), F.array().cast("array<string>")), of_seat)))


def _given(wants: DataFrame) -> DataFrame:
    """(request_id, requested_at, show_id, _open, seat_id) of the requests that get all their `seats`.

    Of requests for the same seats only the first can get them: if it does not, one of them is gone.  So a show comes
    down to its distinct sets of seats (combined map-side, however many ask), and these are decided in order of time in
    one scan that keeps the seats given so far; nothing else is carried from row to row.
    """
    first = wants.groupBy("show_id", "seats").agg(
        F.min(F.struct("requested_at", "request_id")).alias("_turn"), F.first("_open").alias("_open")
    )
    turns = first.select("show_id", "_turn.*", "_open", "seats").repartition("show_id")
    ordered = turns.sortWithinPartitions("show_id", "requested_at", "request_id")
    got = ordered.mapInArrow(_served, ordered.schema)
    return got.select("request_id", "requested_at", "show_id", "_open", F.explode("seats").alias("seat_id"))


def _served(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The requests that get their seats, of rows sorted by show and turn."""
    show, taken = None, set()
    for batch in batches:
        wins = []
        for this, seats in zip(batch.column("show_id").to_pylist(), batch.column("seats").to_pylist()):
            if this != show:
                show, taken = this, set()
            wins.append(taken.isdisjoint(seats))
            if wins[-1]:
                taken.update(seats)
        yield batch.filter(pa.array(wins, pa.bool_()))


def transitions(requests: DataFrame, bookings: DataFrame, payments: DataFrame) -> DataFrame:
    """Status-change requests with their effect on booking, seats and payment, or a reason."""
    paid = payments.groupBy("booking_id").agg(F.max(F.col("status") == "PAID").alias("_paid"))
    current = bookings.select("booking_id", "user_id", F.col("status").alias("old_status"))
    old, to, paid_flag = F.col("old_status"), F.upper("to_status"), F.col("_paid")
    reason = (
        F.when(old.isNull(), V.TICKET_NOT_FOUND)
        .when(old == to, V.SAME_STATUS)
        .when(~to.isin(V.BOOKING_STATUSES), F.concat(F.lit(V.UNKNOWN_STATUS), to))
        .when((to == "CANCLED") & (old != "PENDING"), V.NOT_CANCELLABLE)
        .when((to == "BOOKED") & F.coalesce(~paid_flag, F.lit(True)) & (old != "PENDING"), V.ALREADY_SETTLED)
        .when((to == "BOOKED") & ~paid_flag, V.ALREADY_PENDING)
    )
    done = F.col("reason").isNull()
    return (
        requests.join(current, ["booking_id", "user_id"], "left")
        .join(paid, "booking_id", "left")
        .withColumn("reason", reason)
        .withColumn("new_status", F.when(done & to.isin("PENDING", "CANCLED"), to).otherwise(old))
        .withColumn("seat_status", F.when(done & (to == "PENDING"), "PENDING").when(done & (to == "CANCLED"), "AVAILABLE"))
        .withColumn("creates_payment", done & (to == "BOOKED") & paid_flag.isNull())
        .drop("_paid")
    )


# -- expiry and blacklist -----------------------------------------------------


def expire_pending(
    bookings: DataFrame, payments: DataFrame, as_of: str, timeout: int = V.PENDING_TIMEOUT_MINUTES, mode: str = "total"
) -> DataFrame:
    """Pending bookings whose time is up at `as_of`, with what becomes of them.

    `mode="mod60"` looks only at the minutes past the full hour.
    """
    age = F.floor(
        (F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("create_at").cast("timestamp"))) / 60
    )
    due = age % 60 if mode == "mod60" else age
    paying = payments.groupBy("booking_id").agg(F.min_by("status", F.struct("create_at", "payment_id")).alias("payment_status"))
    paid = F.coalesce(F.col("payment_status") == "PAID", F.lit(False))
    return (
        by_status(bookings, "PENDING")
        .withColumn("age_minutes", age)
        .filter(due >= timeout)
        .join(paying, "booking_id", "left")
        .withColumn("new_status", F.when(paid, "BOOKED").otherwise("CANCLED"))
        .withColumn("seat_status", F.when(paid, "BOOKED").otherwise("AVAILABLE"))
        .withColumn("is_spam", F.coalesce(F.col("payment_status") == "CANCLED", F.lit(False)))
    )


def expired_seats(expired: DataFrame, booking_seats: DataFrame) -> DataFrame:
    return booking_seats.join(expired.select("booking_id", "show_id", F.col("seat_status").alias("status")), "booking_id")


def spam_counts(expired: DataFrame) -> DataFrame:
    return expired.filter("is_spam").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


def blacklist(stored: DataFrame, new: DataFrame, users: DataFrame, limit: int = V.SPAM_LIMIT) -> DataFrame:
    """Spam marks after the new ones, and the status of their users."""
    marks = stored.join(new, "user_id", "full_outer")
    total = F.coalesce("spam_times", F.lit(0)) + F.coalesce("n", F.lit(0))
    return (
        marks.select("user_id", total.alias("spam_times"), F.coalesce("n", F.lit(0)).alias("new_marks"))
        .join(users.select("user_id", "status"), "user_id")
        .withColumn(
            "status",
            F.when((F.col("new_marks") > 0) & (F.col("spam_times") >= limit), "BLACKLISTED").otherwise(F.col("status")),
        )
    )
