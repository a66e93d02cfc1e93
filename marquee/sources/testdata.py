"""The ticketing tables as views over the given parquet tables.

Each property is a lazy DataFrame over whole tables; timestamps stay without a
zone, as in the files.  `marquee/plans/oracle.py` states the same views in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.functions.business import minutes, seat_price


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


class Views:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    # -- events ---------------------------------------------------------------

    @cached_property
    def payment_events(self) -> DataFrame:
        k = F.col("k")
        return (
            self.table("events")
            .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
            .select(
                _text("event_id").alias("event_id"),
                F.concat(_text("user_id"), F.lit("-"), _text(k % 10)).alias("payment_id"),
                _text("user_id").alias("user_id"),
                _text(k).alias("movie_id"),
                (F.col("value") * 10000).alias("amount"),
                F.concat(F.lit("10.0.0."), _text(k % 4)).alias("device_ip"),
                F.col("ts").alias("event_time"),
                F.when(F.col("event_type") == "purchase", "PAID")
                .when(F.col("event_type") == "error", "FAILED")
                .when(F.col("event_type") == "signup", "CANCLED")
                .otherwise("PENDING")
                .alias("status"),
                F.lit("VN").alias("location"),
                F.when(k % 10 == 0, "0").otherwise("24").alias("return_code"),
            )
        )

    @cached_property
    def arrivals(self) -> DataFrame:
        """Payment events with the time they arrived: some two days late, some without their payment."""
        n = F.col("event_id").cast("long")
        delay = F.expr("make_dt_interval(0, 0, 0, (n * 7919 % 90000) / 1000.0)")
        lost = F.expr("make_dt_interval(CASE WHEN n % 97 = 0 THEN 2 ELSE 0 END)")
        return (
            self.payment_events.withColumn("n", n)
            .withColumn("arrived_at", F.col("event_time") + delay + lost)
            .withColumn("payment_id", F.when(n % 101 != 0, F.col("payment_id")))
            .drop("n")
        )

    @cached_property
    def login_attempts(self) -> DataFrame:
        return (
            self.table("events")
            .filter(F.col("event_type").isin("signup", "error"))
            .select(_text("event_id").alias("attempt_id"), _text("user_id").alias("login_key"), "ts")
        )

    # -- catalogue ------------------------------------------------------------

    @cached_property
    def movies(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("movie_id"),
            F.col("p_name").alias("title"),
            (60 + F.col("p_size")).alias("duration_mins"),
            (F.expr("timestamp_ntz'2023-01-01 00:00:00'") + minutes(F.col("p_partkey"))).alias("created_at"),
            F.col("p_brand").alias("country"),
        )

    @cached_property
    def movie_genre(self) -> DataFrame:
        words = F.array_distinct(F.concat(F.split("p_name", " "), F.array(F.lower("p_type"))))
        return self.table("part").select(F.col("p_partkey").alias("movie_id"), F.explode(words).alias("genre"))

    @cached_property
    def genres(self) -> DataFrame:
        return self.movie_genre.select("genre").distinct()

    @cached_property
    def incoming_movies(self) -> DataFrame:
        known = F.col("p_partkey") % 3 == 0
        return self.table("part").select(
            F.col("p_partkey").alias("incoming_id"),
            F.when(known, F.col("p_name"))
            .otherwise(F.concat("p_name", F.lit(" "), _text(F.col("p_partkey") % 500)))
            .alias("title"),
            F.array_distinct(F.concat(F.split("p_name", " "), F.array("p_brand"))).alias("genres"),
        )

    @cached_property
    def comments(self) -> DataFrame:
        n = F.col("n_chars")
        return self.table("documents").select(
            _text("doc_id").alias("comment_id"),
            (F.col("doc_id") % 200).alias("movie_id"),
            _text(F.col("doc_id") % 100).alias("user_id"),
            F.col("text").alias("comment"),
            (n % 7).cast("int").alias("rated"),
            (n % 10).cast("int").alias("liked"),
            (n % 3).cast("int").alias("disliked"),
            (F.expr("timestamp_ntz'2024-01-01 00:00:00'") + minutes(n)).alias("update_at"),
        )

    @cached_property
    def comment_edit_requests(self) -> DataFrame:
        d = F.col("doc_id")
        return self.table("documents").select(
            F.when(d % 50 == 0, F.concat(F.lit("x"), _text(d))).otherwise(_text(d)).alias("comment_id"),
            _text(F.when(d % 6 == 0, d % 100 + 1).otherwise(d % 100)).alias("user_id"),
            (F.col("n_chars") % 8).cast("int").alias("new_rated"),
        )

    @cached_property
    def comment_requests(self) -> DataFrame:
        d = F.col("doc_id")
        return self.table("documents").select(
            _text(d).alias("request_id"),
            F.when(d % 14 != 0, d % 200).alias("movie_id"),
            F.when(d % 9 == 0, " ").otherwise(F.col("text")).alias("comment"),
        )

    # -- halls, seats, shows --------------------------------------------------

    @cached_property
    def halls(self) -> DataFrame:
        s = F.col("s_suppkey")
        return self.table("supplier").select(
            s.alias("hall_id"),
            F.col("s_name").alias("name"),
            (3 + s % 5).cast("int").alias("total_row"),
            (4 + s % 6).cast("int").alias("total_col"),
        )

    @cached_property
    def hall_names_asked(self) -> DataFrame:
        return self.halls.select(
            F.concat(F.lit("ask-"), _text("hall_id")).alias("request_id"),
            F.when(F.col("hall_id") % 7 == 0, F.upper("name")).otherwise(F.col("name")).alias("name"),
        )

    @cached_property
    def hall_changes(self) -> DataFrame:
        h = F.col("hall_id")
        return self.halls.select(
            "hall_id",
            F.concat("name", F.lit("+")).alias("new_name"),
            (F.col("total_row") + h % 2).cast("int").alias("new_row"),
            (F.col("total_col") + h % 3).cast("int").alias("new_col"),
        )

    @cached_property
    def shows(self) -> DataFrame:
        day = F.to_date("l_shipdate")
        slots = self.table("lineitem").select("l_suppkey", "l_partkey", day.alias("day")).distinct()
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
        start = F.col("day").cast("timestamp_ntz") + minutes((F.col("l_partkey") % 24) * 60)
        return slots.join(part, "l_partkey").select(
            _show_id(F.col("day")).alias("show_id"),
            F.col("l_suppkey").alias("hall_id"),
            F.col("l_partkey").alias("movie_id"),
            start.alias("start_time"),
            (start + minutes(F.col("p_size") + 70)).alias("end_time"),
        )

    @cached_property
    def show_requests(self) -> DataFrame:
        m = F.col("movie_id")
        moved = F.col("start_time") + minutes(F.when(m % 2 == 0, 57600).otherwise(30))
        return self.shows.select(
            F.col("show_id").alias("request_id"),
            F.when(m % 23 == 0, -1).otherwise(F.col("hall_id")).alias("hall_id"),
            "movie_id",
            F.when(m % 17 == 0, "x")
            .when(m % 19 == 0, "31/02/2023 14:00")
            .otherwise(F.date_format(moved, "dd/MM/yyyy HH:mm"))
            .alias("start_text"),
        )

    @cached_property
    def show_updates(self) -> DataFrame:
        """Every show moved, in time, hall or neither; some updates name what does not exist."""
        m, h = F.col("movie_id"), F.col("hall_id")
        moved = F.col("start_time") + minutes(F.when(m % 3 == 0, 45).when(m % 3 == 1, 1440).otherwise(0))
        return self.shows.select(
            F.when(m % 29 == 0, F.concat(F.lit("no-"), "show_id")).otherwise(F.col("show_id")).alias("show_id"),
            F.when(m % 23 == 0, -1).when(m % 5 == 0, F.when(h == 0, 1).otherwise(h - 1)).otherwise(h).alias("hall_id"),
            F.when(m % 31 == 0, -1).otherwise(m).alias("movie_id"),
            F.when(m % 17 == 0, "x").otherwise(F.date_format(moved, "dd/MM/yyyy HH:mm")).alias("start_text"),
        )

    @cached_property
    def show_deletes(self) -> DataFrame:
        by_id = F.col("start_time") < F.expr("timestamp_ntz'1997-01-01 00:00:00'")
        by_key = F.col("start_time") >= F.expr("timestamp_ntz'2000-01-01 00:00:00'")
        return self.shows.filter(by_id | by_key).select(
            F.when(by_id, F.col("show_id")).alias("show_id"),
            F.when(~by_id, F.col("hall_id")).alias("hall_id"),
            F.when(~by_id, F.col("movie_id")).alias("movie_id"),
            F.when(~by_id, F.date_format("start_time", "dd/MM/yyyy HH:mm")).alias("start_text"),
        )

    @cached_property
    def show_seats(self) -> DataFrame:
        """Every show times the grid of its hall; the seats of a show lie together, so that grouping by show moves none."""
        halls = self.halls.select("hall_id", "total_row", "total_col")
        # The halls meet the shows before they become grids: a grid is many times the size its file tells.
        placed = self.shows.select("show_id", "hall_id", "movie_id").join(halls, "hall_id")
        # A number of partitions, and a higher one, as a show is some thirty rows; Spark would size them by the shows.
        parts = 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = placed.repartition(parts, "show_id").withColumn("row_index", F.explode(F.expr("sequence(0, total_row - 1)")))
        seats = rows.withColumn("col_index", F.explode(F.expr("sequence(0, total_col - 1)")))
        h, m, r, c = (F.col(n) for n in ("hall_id", "movie_id", "row_index", "col_index"))
        full = (h % 7 == 0) & (m % 20 == 0)
        return seats.select(
            F.concat("show_id", F.lit("#"), _text(r), F.lit("."), _text(c)).alias("seat_id"),
            "show_id",
            "hall_id",
            "row_index",
            "col_index",
            F.when(full | ((m + 7 * r + c) % 5 == 0), "BOOKED")
            .when((m + r + c) % 7 == 0, "PENDING")
            .otherwise("AVAILABLE")
            .alias("status"),
        )

    # -- users ----------------------------------------------------------------

    @cached_property
    def users(self) -> DataFrame:
        return self.table("customer").select(
            _text("c_custkey").alias("user_id"),
            F.col("c_name").alias("username"),
            F.concat("c_name", F.lit(" of "), "c_mktsegment").alias("full_name"),
            F.concat(F.lit("user"), _text("c_custkey"), F.lit("@example.com")).alias("email"),
            F.when(F.col("c_acctbal") < 0, "BLACKLISTED").otherwise("ACTIVE").alias("status"),
        )

    @cached_property
    def user_roles(self) -> DataFrame:
        roles = F.array_compact(
            F.array(
                F.lit("ROLE_USER"),
                F.when(F.col("c_nationkey") % 5 == 0, "ROLE_ADMIN"),
                F.when(F.col("c_mktsegment") == "MACHINERY", "ROLE_SUPER_ADMIN"),
            )
        )
        return self.table("customer").select(_text("c_custkey").alias("user_id"), F.explode(roles).alias("role"))

    @cached_property
    def spam_users(self) -> DataFrame:
        return self.table("customer").select(
            _text("c_custkey").alias("user_id"), (F.col("c_custkey") % 3).alias("spam_times")
        )

    # -- bookings and payments ------------------------------------------------

    @cached_property
    def bookings(self) -> DataFrame:
        first = (
            self.table("lineitem")
            .groupBy(F.col("l_orderkey").alias("o_orderkey"))
            .agg(F.min(F.struct("l_partkey", "l_suppkey", "l_shipdate")).alias("_f"))
            .select("o_orderkey", "_f.*")
        )
        return (
            self.table("orders")
            .join(first, "o_orderkey")
            .select(
                _text("o_orderkey").alias("booking_id"),
                _text("o_custkey").alias("user_id"),
                _show_id(F.to_date("l_shipdate")).alias("show_id"),
                F.when(F.col("o_orderstatus") == "P", "PENDING")
                .when(F.col("o_orderstatus") == "F", "BOOKED")
                .otherwise("CANCLED")
                .alias("status"),
                (F.col("o_orderdate") + minutes(F.col("o_orderkey") % 1440)).alias("create_at"),
            )
        )

    @cached_property
    def _lines(self) -> DataFrame:
        return (
            self.table("lineitem")
            .groupBy("l_orderkey", "l_linenumber")
            .agg(F.min(F.struct("l_partkey", "l_suppkey", "l_shipdate")).alias("_f"))
            .select("l_orderkey", "l_linenumber", "_f.*")
        )

    @cached_property
    def booking_seats(self) -> DataFrame:
        kind = F.when(F.col("l_partkey") % 3 == 0, "PREMIUM").otherwise("REGULAR")
        return self._lines.select(
            _text("l_orderkey").alias("booking_id"),
            F.col("l_linenumber").alias("seat_no"),
            (F.col("l_linenumber") - 1).alias("row_index"),
            (F.col("l_partkey") % 4).cast("int").alias("col_index"),
            kind.alias("seat_type"),
            seat_price(kind).alias("price"),
        )

    @cached_property
    def payments(self) -> DataFrame:
        p = F.col("o_orderpriority")
        return (
            self.table("orders")
            .filter(p != "4-NOT SPECIFIED")
            .select(
                F.concat(F.lit("pay-"), _text("o_orderkey")).alias("payment_id"),
                _text("o_orderkey").alias("booking_id"),
                F.col("o_totalprice").alias("amount"),
                F.concat(F.lit("T"), _text("o_orderkey")).alias("txn_ref"),
                F.when(p.isin("1-URGENT", "2-HIGH"), "PAID")
                .when(p == "3-MEDIUM", "CANCLED")
                .otherwise("PENDING")
                .alias("status"),
                (F.col("o_orderdate") + minutes(F.col("o_orderkey") % 1440 + 5)).alias("create_at"),
            )
        )

    @cached_property
    def gateway_responses(self) -> DataFrame:
        o = F.col("o_orderkey")
        return self.table("orders").select(
            F.concat(F.lit("T"), _text(o)).alias("txn_ref"),
            F.when(o % 7 == 0, "24").otherwise("00").alias("response_code"),
            (F.round(F.col("o_totalprice") * 100).cast("long") + F.when(o % 11 == 0, 1).otherwise(0)).alias(
                "amount_minor"
            ),
            F.lit("01").alias("txn_type"),
            F.when(o % 13 == 0, "02").otherwise("00").alias("txn_status"),
        )

    @cached_property
    def booking_lookups(self) -> DataFrame:
        o = F.col("booking_id").cast("long")
        return self.bookings.select(
            "booking_id", F.when(o % 4 == 0, F.concat(F.lit("not-"), "user_id")).otherwise(F.col("user_id")).alias("user_id")
        )

    @cached_property
    def busy_shows(self) -> DataFrame:
        """The first show of each hall, for which many ask."""
        return self.shows.groupBy("hall_id").agg(F.min("show_id").alias("show_id"))

    @cached_property
    def request_seats(self) -> DataFrame:
        """The seats that requests meet: a busy show has six at most, so some fill up."""
        busy = F.broadcast(self.busy_shows.select("show_id", F.lit(True).alias("_busy")))  # one row per hall
        closed = F.col("_busy") & ((F.col("row_index") > 2) | (F.col("col_index") > 1))
        return (
            self.show_seats.join(busy, "show_id", "left")
            .withColumn("status", F.when(closed, "UNAVAILABLE").otherwise(F.col("status")))
            .drop("_busy")
        )

    @cached_property
    def booking_requests(self) -> DataFrame:
        """One per booking; every fourth is for the busy show of its hall instead."""
        o = F.col("booking_id").cast("long")
        row = F.when(F.col("l_linenumber") == 7, 9).otherwise((F.col("l_linenumber") - 1) % 3)
        col = F.col("l_partkey") % F.when(F.col("l_orderkey") % 4 == 0, 2).otherwise(4)
        places = self._lines.groupBy(_text("l_orderkey").alias("booking_id")).agg(
            F.sort_array(F.collect_list(F.concat(F.lit("#"), _text(row), F.lit("."), _text(col)))).alias("_p")
        )
        halls = self.shows.select("show_id", "hall_id").join(
            F.broadcast(self.busy_shows.withColumnRenamed("show_id", "_busy")), "hall_id"
        )
        show = F.when(o % 29 == 0, "no-show").when(o % 4 == 0, F.col("_busy")).otherwise(F.col("show_id"))
        return (
            self.bookings.join(places, "booking_id")
            .join(halls.select("show_id", "_busy"), "show_id")
            .withColumn("show_id", show)
            .select(
                F.col("booking_id").alias("request_id"),
                F.when(o % 23 == 0, "nobody").otherwise(F.col("user_id")).alias("user_id"),
                "show_id",
                F.col("create_at").alias("requested_at"),
                F.transform("_p", lambda p: F.concat(F.col("show_id"), p)).alias("seat_ids"),
            )
        )

    @cached_property
    def payment_requests(self) -> DataFrame:
        """A request for each booking, some by another user or for a booking that is not there."""
        o = F.col("booking_id").cast("long")
        return self.bookings.join(self.users.select("user_id", "username"), "user_id").select(
            _text("booking_id").alias("request_id"),
            F.when(o % 31 == 0, F.concat(F.lit("no-"), "booking_id")).otherwise(F.col("booking_id")).alias("booking_id"),
            F.when(o % 5 == 0, "somebody").otherwise(F.col("username")).alias("username"),
        )

    @cached_property
    def status_requests(self) -> DataFrame:
        o = F.col("booking_id").cast("long")
        return self.bookings.select(
            "booking_id",
            F.when(o % 10 == 0, "nobody").otherwise(F.col("user_id")).alias("user_id"),
            F.when(o % 7 < 2, "pending").when(o % 7 < 4, "cancled").when(o % 7 < 6, "BOOKED").otherwise("lost").alias("to_status"),
        )


def _show_id(day: Column) -> Column:
    return F.concat_ws("-", _text("l_suppkey"), _text("l_partkey"), _text(day))
