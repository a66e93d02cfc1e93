"""Halls, seats and shows: lookups, availability, schedules and their changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee import fixed_values as V
from marquee.functions.business import capacity, parse_request_time, seat_name, seat_price, show_end
from marquee.operators.skew import BROADCAST_KEYS, ROWS_PER_CHUNK, apart, chunk_carry, chunked, hot_keys, micros
from marquee.session import materialize, stored

#: Up to so many seats of halls are broadcast with their attributes, some 170 bytes each.
BROADCAST_SEATS = 2_000_000

# -- seats --------------------------------------------------------------------


def hall_seats(halls: DataFrame) -> DataFrame:
    """The seat grid of every hall: regular, available, numbered from 0."""
    grid = halls.select(
        "hall_id", "name", "total_col", F.explode(F.expr("sequence(0, total_row - 1)")).alias("row_index")
    ).select("hall_id", "name", "row_index", F.explode(F.expr("sequence(0, total_col - 1)")).alias("col_index"))
    return grid.select(
        "hall_id",
        "row_index",
        "col_index",
        F.lit("REGULAR").alias("seat_type"),
        F.lit("AVAILABLE").alias("status"),
        seat_price(F.lit("REGULAR")).alias("price"),
        seat_name(F.col("name"), F.col("row_index"), F.col("col_index")).alias("seat_name"),
    )


def seat_exists(asked: DataFrame, seats: DataFrame) -> DataFrame:
    """The asked (hall, row, col) that exist."""
    return asked.join(seats, ["hall_id", "row_index", "col_index"], "left_semi")


def with_capacity(halls: DataFrame) -> DataFrame:
    return halls.withColumn("capacity", capacity(F.col("total_row"), F.col("total_col")))


def find_halls(halls: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Every asked row with the hall of that `key` (`hall_id` or `name`), or the reason that there is none.

    A name that several halls have gives each of them; null finds nothing.
    """
    found = asked.join(with_capacity(halls).withColumn("_found", F.lit(True)), key, "left")
    return found.withColumn("reason", F.when(F.col("_found").isNull(), V.HALL_NOT_FOUND)).drop("_found")


def inventory(shows: DataFrame, seats: DataFrame) -> DataFrame:
    """One available seat per show and seat of its hall.

    The seats are not broadcast: they may come from an explode, whose rows Spark does not count.
    """
    return shows.select("show_id", "hall_id").join(
        seats.select("hall_id", "row_index", "col_index", "seat_name").hint("merge"), "hall_id"
    ).withColumn("status", F.lit("AVAILABLE"))


def seat_list(show_seats: DataFrame, seats: DataFrame) -> DataFrame:
    """Seats of every show with the attributes of the seat they stand for.

    Seats of halls are broadcast where they were counted to be few. Where they are many, a show's seats and a hall's meet
    as lists, neither longer than the hall has seats.
    """
    named = ["seat_type", "seat_name", "price"]
    attributes = seats.select("hall_id", "row_index", "col_index", *named)
    if attributes.count() <= BROADCAST_SEATS:
        return show_seats.join(F.broadcast(attributes), ["hall_id", "row_index", "col_index"])
    own = [c for c in show_seats.columns if c not in ("show_id", "hall_id")]
    shown = show_seats.groupBy("show_id", "hall_id").agg(F.collect_list(F.struct(*own)).alias("_shown"))
    of_hall = attributes.groupBy("hall_id").agg(F.collect_list(F.struct("row_index", "col_index", *named)).alias("_seats"))

    def both(r: Column) -> Column:
        same = F.filter("_seats", lambda s: (s["row_index"] == r["row_index"]) & (s["col_index"] == r["col_index"]))
        return F.transform(same, lambda s: F.struct(*[r[c].alias(c) for c in own], *[s[c].alias(c) for c in named]))

    met = shown.join(of_hall.hint("merge"), "hall_id")
    rows = met.select("show_id", "hall_id", F.explode(F.flatten(F.transform("_shown", both))).alias("_s"))
    return rows.select("hall_id", "_s.row_index", "_s.col_index", "show_id", *[f"_s.{c}" for c in [*own, *named] if c not in ("row_index", "col_index")])


def seat_map(show_seats: DataFrame) -> DataFrame:
    """Per show and row the seats in column order; no longer than the hall is wide."""
    return show_seats.groupBy("show_id", "row_index").agg(
        F.sort_array(F.collect_list(F.struct("col_index", "status"))).alias("seats")
    )


def edit_seats(seats: DataFrame, edits: DataFrame) -> DataFrame:
    """Seats after an edit table; an edit with an unknown type or status changes nothing and says why.

    Edits of seats that do not exist come out with their reason and no seat.
    """
    kind, status = F.upper("new_type"), F.upper("new_status")
    reason = (
        F.when(F.col("seat_name").isNull(), V.SEAT_MISSING)
        .when(F.col("new_type").isNull() & F.col("new_status").isNull(), None)
        .when(~F.coalesce(kind.isin(V.SEAT_TYPES), F.lit(False)), V.BAD_SEAT_TYPE)
        .when(~F.coalesce(status.isin(V.SEAT_STATUSES), F.lit(False)), V.BAD_SEAT_STATUS)
    )
    edited = F.col("reason").isNull() & F.col("new_type").isNotNull()
    return (
        seats.join(edits, ["hall_id", "row_index", "col_index"], "full_outer")
        .withColumn("reason", reason)
        .withColumn("seat_type", F.when(edited, kind).otherwise(F.col("seat_type")))
        .withColumn("status", F.when(edited, status).otherwise(F.col("status")))
        .withColumn("price", F.when(edited, seat_price(kind)).otherwise(F.col("price")))
        .drop("new_type", "new_status")
    )


# -- availability -------------------------------------------------------------


def seat_status_counts(show_seats: DataFrame) -> DataFrame:
    return show_seats.groupBy("show_id", "status").agg(F.count(F.lit(1)).alias("n"))


def availability(show_seats: DataFrame) -> DataFrame:
    """Available and booked seats of every show, in one pass."""
    return show_seats.groupBy("show_id").agg(
        F.count_if(F.col("status") == "AVAILABLE").alias("available"),
        F.count_if(F.col("status") == "BOOKED").alias("reserved"),
    )


def show_info(shows: DataFrame, halls: DataFrame, movies: DataFrame, show_seats: DataFrame) -> DataFrame:
    hall = with_capacity(halls).select("hall_id", F.col("name").alias("hall_name"), F.col("capacity").alias("total_seats"))
    return (
        shows.join(availability(show_seats), "show_id", "left")
        .join(hall, "hall_id")
        .join(movies.select("movie_id", F.col("title").alias("movie_name")), "movie_id")
        .withColumn("available", F.coalesce("available", F.lit(0)))
        .withColumn("reserved", F.coalesce("reserved", F.lit(0)))
    )


def full_shows(shows: DataFrame, show_seats: DataFrame) -> DataFrame:
    """Shows without an available seat."""
    return shows.join(show_seats.filter("status = 'AVAILABLE'").select("show_id"), "show_id", "left_anti")


# -- lookups ------------------------------------------------------------------


def of_hall(shows: DataFrame, halls: DataFrame) -> DataFrame:
    return shows.join(halls.select("hall_id", F.col("name").alias("hall_name")), "hall_id")


def of_movie(shows: DataFrame, movies: DataFrame) -> DataFrame:
    return shows.join(movies.select("movie_id", F.col("title").alias("movie_name")), "movie_id")


def lookup(asked: DataFrame, shows: DataFrame) -> DataFrame:
    """The show of each asked (hall, movie, start text); null where there is none."""
    found = shows.select("hall_id", "movie_id", "start_time", "show_id")
    return asked.withColumn("start_time", parse_request_time(F.col("start_text"))).join(
        found, ["hall_id", "movie_id", "start_time"], "left"
    )


# -- conflicts ----------------------------------------------------------------


def conflicts(candidates: DataFrame, shows: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK) -> DataFrame:
    """Candidates with the number of shows of their hall they overlap, ends included, and one of those.

    A row that is both candidate and show does not meet itself.  Pairs are never
    formed: with starts and ends of a hall in order of time, the shows that meet
    [s, e] are those that start by e less those that end before s, and running
    totals give both.  The conflicting show named is the earlier one that ends
    last, else the latest start within the candidate.
    """
    shows = shows.select("hall_id", "show_id", "start_time", "end_time")
    candidates = candidates.select("hall_id", "show_id", "start_time", "end_time")
    alike = candidates.sameSemantics(shows)
    if alike:
        rows = shows.withColumn("_shown", F.lit(True)).withColumn("_asked", F.lit(True))
    else:
        rows = shows.withColumn("_shown", F.lit(True)).unionByName(candidates.withColumn("_asked", F.lit(True)), allowMissingColumns=True)
    sizes = shows.select("hall_id", "start_time").unionByName(candidates.select("hall_id", "start_time"))
    hot = hot_keys(sizes, "hall_id", micros("start_time"), rows_per_chunk)
    plain, large = (rows, None) if hot is None else apart(rows, "hall_id", hot)
    # All that follows is by hall: its shows and candidates are dealt out once.
    found = _met(_swept(_points(plain.repartition("hall_id"), alike), ["hall_id"])[0])
    if hot is not None:
        cut, carry = _swept(materialize(chunked(_points(large, alike), "hall_id", F.col("_t"), hot)), ["hall_id", "_chunk"])
        cut = (
            cut.join(carry, ["hall_id", "_chunk"], "left")
            .withColumn("_started", F.col("_started") + F.coalesce("_s", F.lit(0)))
            .withColumn("_ended", F.col("_ended") + F.coalesce("_e", F.lit(0)))
            .withColumn("_longest", F.greatest("_longest", "_l"))
            .withColumn("_latest", F.greatest("_latest", "_t0"))
            .drop("_chunk", "_is_hot", "_s", "_e", "_l", "_t0")
        )
        found = found.unionByName(_met(cut))
    own = F.coalesce("_shown", F.lit(False)).cast("long")
    named = F.when(F.col("_longest.end_time") >= F.col("start_time"), F.col("_longest.show_id")).otherwise(
        F.col("_latest.show_id")
    )
    n = F.col("_started") - F.col("_ended") - own
    return found.select(
        "show_id", "hall_id", "start_time", "end_time", n.alias("n_conflicts"), F.when(n > 0, named).alias("conflict_with")
    )


def _points(rows: DataFrame, alike: bool) -> DataFrame:
    """The starts and ends of shows and candidates; where these are not `alike`, a row that is both comes once."""
    both = rows
    if not alike:
        flags = [F.bool_or("_shown").alias("_shown"), F.bool_or("_asked").alias("_asked")]
        both = rows.groupBy("hall_id", "show_id", "start_time", "end_time").agg(*flags)
    point = F.explode(
        F.array(
            F.struct(F.col("start_time").alias("at"), F.lit(0).alias("kind")),
            F.struct(F.col("end_time").alias("at"), F.lit(1).alias("kind")),
        )
    )
    points = both.select("*", point.alias("_p")).select("*", "_p.at", "_p.kind").drop("_p")
    return points.withColumn("_t", micros("at"))


def _met(swept: DataFrame) -> DataFrame:
    """What the candidates' two points say."""
    at_start, at_end = F.col("kind") == 0, F.col("kind") == 1
    return (
        swept.filter(F.coalesce("_asked", F.lit(False)))
        .groupBy("show_id", "hall_id", "start_time", "end_time")
        .agg(
            F.max(F.when(at_end, F.col("_started"))).alias("_started"),
            F.max(F.when(at_start, F.col("_ended"))).alias("_ended"),
            F.max(F.when(at_start, F.col("_longest"))).alias("_longest"),
            F.max(F.when(at_end, F.col("_latest"))).alias("_latest"),
            F.max("_shown").alias("_shown"),
        )
    )


def _swept(points: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """(points with the running totals of `by`, where that has chunks what each is to add from those before it)."""
    order = Window.partitionBy(*by).orderBy("_t", "kind", "start_time", "show_id")
    until = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    shown = F.coalesce("_shown", F.lit(False))
    start = F.when(shown & (F.col("kind") == 0), F.struct("start_time", "show_id"))
    ending = F.when(shown & (F.col("kind") == 0), F.struct("end_time", "show_id"))
    started = F.count_if(shown & (F.col("kind") == 0))
    ended = F.count_if(shown & (F.col("kind") == 1))
    swept = (
        points.withColumn("_started", started.over(until))
        .withColumn("_ended", F.coalesce(ended.over(before), F.lit(0)))
        .withColumn("_longest", F.max(ending).over(before))
        .withColumn("_latest", F.max(start).over(until))
    )
    if "_chunk" not in by:
        return swept, None
    parts = {"_s": (started, F.sum), "_e": (ended, F.sum), "_l": (F.max(ending), F.max), "_t0": (F.max(start), F.max)}
    return swept, chunk_carry(points, "hall_id", parts)


def conflicting_shows(candidates: DataFrame, shows: DataFrame, mode: str = "overlap", slot_minutes: int = 60) -> DataFrame:
    """(candidate, show) pairs of one hall that overlap; for candidate lists, not for a table with itself.

    Both sides are spread over the time slots they touch and meet on hall and
    slot, once: in the later of their first slots.  `mode="endpoint"` counts
    only shows that hold the start or the end of the candidate.
    """
    width = slot_minutes * 60_000_000

    def slotted(df: DataFrame, prefix: str) -> DataFrame:
        first = F.floor(micros("start_time") / width)
        return df.select(
            "hall_id",
            F.col("show_id").alias(f"{prefix}_id"),
            F.col("start_time").alias(f"{prefix}_start"),
            F.col("end_time").alias(f"{prefix}_end"),
            first.alias(f"{prefix}_slot"),
            F.explode(F.sequence(first, F.floor(micros("end_time") / width))).alias("_slot"),
        )

    a, b = slotted(candidates, "candidate"), slotted(shows, "show")
    s1, e1, s2, e2 = (F.col(c) for c in ("candidate_start", "candidate_end", "show_start", "show_end"))
    rule = (s1 <= e2) & (e1 >= s2)
    if mode == "endpoint":
        rule = ((s1 >= s2) & (s1 <= e2)) | ((e1 >= s2) & (e1 <= e2))
    meets = (F.col("_slot") == F.greatest("candidate_slot", "show_slot")) & (F.col("candidate_id") != F.col("show_id"))
    return a.join(b, ["hall_id", "_slot"]).filter(meets & rule).drop("_slot", "candidate_slot", "show_slot")


# -- changes ------------------------------------------------------------------


def schedule(
    requests: DataFrame, halls: DataFrame, movies: DataFrame, shows: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """New shows with their times, seat count and conflicts with the schedule, or a reason."""
    timed = (
        requests.withColumn("start_time", parse_request_time(F.col("start_text")))
        .join(with_capacity(halls).select("hall_id", "capacity"), "hall_id", "left")
        .join(movies.select("movie_id", "duration_mins"), "movie_id", "left")
        .withColumn(
            "reason",
            F.when(F.col("capacity").isNull(), V.HALL_NOT_FOUND)
            .when(F.col("duration_mins").isNull(), V.MOVIE_NOT_FOUND)
            .when(F.col("start_time").isNull(), V.BAD_DATE),
        )
        .withColumn("end_time", show_end(F.col("start_time"), F.col("duration_mins")))
    )
    timed = stored(timed, "timed")  # the sweep and the result both read it
    candidates = timed.filter("reason IS NULL").withColumn("show_id", F.concat(F.lit("new:"), "request_id"))
    met = conflicts(candidates, shows, rows_per_chunk).select(
        F.expr("substring(show_id, 5)").alias("request_id"), "n_conflicts", "conflict_with"
    )
    return (
        timed.join(met, "request_id", "left")
        .withColumn("seats", F.when(F.col("reason").isNull(), F.col("capacity")))
        .withColumn("end_time", F.when(F.col("reason").isNull(), F.col("end_time")))
        .drop("capacity", "duration_mins")
    )


def update_shows(
    shows: DataFrame, updates: DataFrame, halls: DataFrame, movies: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Updates of shows with what the show becomes, or a reason; `resets_seats` where its hall changes.

    A start that cannot be read or does not change keeps the times.  A new start
    must not conflict with another show of the hall as scheduled now; the reason names that show (of several as `conflicts` does).
    """
    old = shows.select("show_id", *[F.col(c).alias(f"old_{c}") for c in ("hall_id", "movie_id", "start_time", "end_time")])
    known = (
        updates.join(old, "show_id", "left")
        .join(halls.select("hall_id", F.lit(True).alias("_hall")), "hall_id", "left")
        .join(movies.select("movie_id", "duration_mins"), "movie_id", "left")
        .withColumn("start_time", F.coalesce(parse_request_time(F.col("start_text")), "old_start_time"))
        .withColumn("_moved", F.col("start_time") != F.col("old_start_time"))
        .withColumn(
            "end_time",
            F.when(F.col("_moved"), show_end(F.col("start_time"), F.col("duration_mins"))).otherwise(F.col("old_end_time")),
        )
        .withColumn(
            "reason",
            F.when(F.col("old_start_time").isNull(), V.SHOW_MISSING)
            .when(F.col("_hall").isNull(), V.HALL_NOT_FOUND)
            .when(F.col("duration_mins").isNull(), V.MOVIE_NOT_FOUND),
        )
    )
    known = stored(known, "updates")  # the sweep and the result both read it
    moved = known.filter("reason IS NULL AND _moved").withColumn("show_id", F.concat(F.lit("new:"), "show_id"))
    timed = ["show_id", "hall_id", "start_time", "end_time"]
    met = conflicts(moved, shows, rows_per_chunk).withColumn("show_id", F.expr("substring(show_id, 5)"))
    own = (
        (F.col("hall_id") == F.col("old_hall_id"))
        & (F.col("start_time") <= F.col("old_end_time"))
        & (F.col("end_time") >= F.col("old_start_time"))
    )
    others = F.coalesce("n_conflicts", F.lit(0)) - F.when(F.col("_moved") & own, 1).otherwise(0)
    met = stored(met.select(*timed, "n_conflicts", "conflict_with"), "met")
    named = F.concat(F.lit(V.SHOW_CONFLICT), F.coalesce("_other", "conflict_with"))
    return (
        known.join(met, timed, "left")
        .join(_other_conflicts(met, shows), timed, "left")
        .withColumn("reason", F.coalesce("reason", F.when(others > 0, named)))
        .withColumn("resets_seats", F.col("reason").isNull() & (F.col("hall_id") != F.col("old_hall_id")))
        .select("show_id", "hall_id", "movie_id", "start_time", "end_time", "resets_seats", "reason")
    )


def _other_conflicts(met: DataFrame, shows: DataFrame) -> DataFrame:
    """The other show that moved shows conflict with where the one named is their own time so far; pairs for these alone."""
    timed = ["show_id", "hall_id", "start_time", "end_time"]
    own = met.filter((F.col("conflict_with") == F.col("show_id")) & (F.col("n_conflicts") > 1))
    asked = own.select(F.concat(F.lit("new:"), "show_id").alias("show_id"), *timed[1:])
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_KEYS else asked
    pairs = conflicting_shows(asked, shows).filter(F.concat(F.lit("new:"), "show_id") != F.col("candidate_id"))
    same = F.col("show_start") == F.col("candidate_start")
    before = (F.col("show_start") < F.col("candidate_start")) | (same & (F.col("show_id") < F.col("candidate_id")))
    longest = F.max(F.when(before, F.struct("show_end", "show_id")))["show_id"]
    latest = F.max(F.when(~before, F.struct("show_start", "show_id")))["show_id"]
    found = pairs.groupBy("candidate_id", "hall_id", "candidate_start", "candidate_end").agg(F.coalesce(longest, latest).alias("_other"))
    return found.select(
        F.expr("substring(candidate_id, 5)").alias("show_id"), "hall_id",
        F.col("candidate_start").alias("start_time"), F.col("candidate_end").alias("end_time"), "_other",
    )


def without_halls(show_seats: DataFrame, halls: DataFrame) -> DataFrame:
    """Show seats less those whose seat belongs to one of `halls`."""
    return show_seats.join(halls.select("hall_id"), "hall_id", "left_anti")


def resize_halls(halls: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(halls after the changes, halls whose grid is rebuilt)."""
    after = (
        halls.join(changes, "hall_id", "left")
        .withColumn("_resized", F.coalesce((F.col("new_row") != F.col("total_row")) | (F.col("new_col") != F.col("total_col")), F.lit(False)))
        .select(
            "hall_id",
            F.coalesce("new_name", "name").alias("name"),
            F.coalesce("new_row", "total_row").alias("total_row"),
            F.coalesce("new_col", "total_col").alias("total_col"),
            "_resized",
        )
    )
    return after.drop("_resized"), after.filter("_resized").drop("_resized")


def delete_shows(shows: DataFrame, show_seats: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shows, show seats) that remain after deletes by id or by (hall, movie, start text)."""
    by_id = deletes.filter("show_id IS NOT NULL").select("show_id")
    by_key = deletes.filter("show_id IS NULL").select(
        "hall_id", "movie_id", parse_request_time(F.col("start_text")).alias("start_time")
    )
    left = shows.join(by_id, "show_id", "left_anti").join(by_key, ["hall_id", "movie_id", "start_time"], "left_anti")
    return left, show_seats.join(left.select("show_id"), "show_id", "left_semi")
