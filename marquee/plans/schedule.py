from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators import seat_bits as W
from marquee.operators import shows as S
from marquee.plans.oracle import with_views
from marquee.plans.registry import plan
from marquee.session import stored
from marquee.sources.testdata import Views


@plan(
    "shows_by_hall",
    with_views(
        "SELECT hall_id, name AS hall_name, show_id, movie_id, start_time, end_time FROM shows JOIN halls USING (hall_id)",
        "shows",
        "halls",
    ),
)
def _by_hall(v: Views) -> DataFrame:
    return S.of_hall(v.shows, v.halls).select("hall_id", "hall_name", "show_id", "movie_id", "start_time", "end_time")


@plan(
    "shows_by_movie",
    with_views(
        "SELECT movie_id, title AS movie_name, show_id, hall_id, start_time FROM shows JOIN movies USING (movie_id)",
        "shows",
        "movies",
    ),
)
def _by_movie(v: Views) -> DataFrame:
    return S.of_movie(v.shows, v.movies).select("movie_id", "movie_name", "show_id", "hall_id", "start_time")


@plan(
    "show_lookup",
    with_views(
        "SELECT r.request_id, r.hall_id, r.movie_id, r.start_time, s.show_id FROM show_requests r LEFT JOIN shows s "
        "ON s.hall_id = r.hall_id AND s.movie_id = r.movie_id AND s.start_time = r.start_time",
        "show_requests",
    ),
)
def _lookup(v: Views) -> DataFrame:
    return S.lookup(v.show_requests, v.shows).select("request_id", "hall_id", "movie_id", "start_time", "show_id")


@plan(
    "hall_lookup",
    with_views("SELECT hall_id, name, total_row, total_col, total_row * total_col AS capacity FROM halls", "halls"),
)
def _halls(v: Views) -> DataFrame:
    return S.with_capacity(v.halls)


def _found_sql(asked: str, key: str) -> str:
    return with_views(
        f"SELECT a.request_id, a.{key}, {'h.name' if key == 'hall_id' else 'h.hall_id'}, h.total_row, h.total_col, "
        "h.total_row * h.total_col AS capacity, CASE WHEN h.hall_id IS NULL THEN 'Hall is not found' END AS reason "
        f"FROM {asked} a LEFT JOIN halls h ON h.{key} = a.{key}",
        "halls",
        asked,
    )


_FOUND = ["request_id", "hall_id", "name", "total_row", "total_col", "capacity", "reason"]


@plan("halls_by_id", _found_sql("show_requests", "hall_id"))
def _halls_by_id(v: Views) -> DataFrame:
    return S.find_halls(v.halls, v.show_requests.select("request_id", "hall_id"), "hall_id").select(*_FOUND)


@plan("halls_by_name", _found_sql("hall_names_asked", "name"))
def _halls_by_name(v: Views) -> DataFrame:
    return S.find_halls(v.halls, v.hall_names_asked, "name").select(*_FOUND)


@plan("hall_seat_grid", with_views("SELECT * FROM grid", "hall_seats", grid="""SELECT hall_id, CAST(row_index AS INTEGER)
      AS row_index, CAST(col_index AS INTEGER) AS col_index, seat_type, status, price, seat_name FROM hall_seats"""))
def _grid(v: Views) -> DataFrame:
    return S.hall_seats(v.halls)


@plan(
    "hall_seats",
    with_views(
        "SELECT hall_id, CAST(row_index AS INTEGER) AS row_index, CAST(col_index AS INTEGER) AS col_index "
        "FROM asked SEMI JOIN hall_seats USING (hall_id, row_index, col_index)",
        "hall_seats",
        asked="SELECT hall_id, row_index * 2 AS row_index, col_index FROM hall_seats",
    ),
)
def _hall_seats(v: Views) -> DataFrame:
    seats = S.hall_seats(v.halls)
    asked = seats.select("hall_id", (F.col("row_index") * 2).alias("row_index"), "col_index")
    return S.seat_exists(asked, seats)


@plan(
    "show_seat_inventory",
    with_views(
        "SELECT show_id, 'AVAILABLE' AS status, count(*) AS n, string_agg(seat_name, ',' ORDER BY seat_name) AS seats "
        "FROM shows JOIN hall_seats USING (hall_id) GROUP BY show_id",
        "shows",
        "hall_seats",
    ),
)
def _inventory(v: Views) -> DataFrame:
    rows = S.inventory(v.shows, S.hall_seats(v.halls))
    return rows.groupBy("show_id", "status").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("seat_name")), ",").alias("seats")
    )


@plan(
    "show_seat_list",
    with_views(
        "SELECT show_id, string_agg(seat_name || ' ' || seat_type || ' ' || status || ' ' || CAST(CAST(price AS INTEGER) "
        "AS VARCHAR), ',' ORDER BY seat_name) AS seats FROM show_seats GROUP BY show_id",
        "show_seats",
    ),
)
def _seat_list(v: Views) -> DataFrame:
    seat = F.concat_ws(" ", "seat_name", "seat_type", "status", F.col("price").cast("int").cast("string"))
    shown = v.show_seats.select("show_id", "hall_id", "row_index", "col_index", "status")
    rows = S.seat_list(shown, S.hall_seats(v.halls))
    # Every seat name is followed by a blank, so the texts sort as the names do.
    return rows.groupBy("show_id").agg(F.array_join(F.sort_array(F.collect_list(seat)), ",").alias("seats"))


@plan(
    "seat_map",
    with_views(
        "SELECT show_id, CAST(row_index AS INTEGER) AS row_index, string_agg(CAST(col_index AS VARCHAR) || ':' || status, "
        "' ' ORDER BY col_index) AS seats FROM show_seats GROUP BY show_id, row_index",
        "show_seats",
    ),
)
def _seat_map(v: Views) -> DataFrame:
    numbered = F.concat(F.col("col_index").cast("string"), F.lit(":"), "status")
    seats = S.seat_map(v.show_seats.withColumn("status", numbered))
    return seats.select("show_id", "row_index", F.array_join("seats.status", " ").alias("seats"))


@plan(
    "seat_status_counts",
    with_views("SELECT show_id, status, count(*) AS n FROM show_seats GROUP BY show_id, status", "show_seats"),
)
def _status_counts(v: Views) -> DataFrame:
    return S.seat_status_counts(v.show_seats)


_AVAILABILITY = """SELECT show_id, count(*) FILTER (WHERE status = 'AVAILABLE') AS available,
  count(*) FILTER (WHERE status = 'BOOKED') AS reserved FROM show_seats GROUP BY show_id"""


@plan(
    "show_info",
    with_views(
        "SELECT s.show_id, s.hall_id, h.name AS hall_name, s.movie_id, m.title AS movie_name, s.start_time, s.end_time, "
        "h.total_row * h.total_col AS total_seats, coalesce(a.available, 0) AS available, "
        "coalesce(a.reserved, 0) AS reserved FROM shows s JOIN halls h USING (hall_id) JOIN movies m USING (movie_id) "
        "LEFT JOIN availability a USING (show_id)",
        "show_seats",
        "halls",
        "movies",
        availability=_AVAILABILITY,
    ),
)
def _info(v: Views) -> DataFrame:
    return S.show_info(v.shows, v.halls, v.movies, v.show_seats)


@plan(
    "full_shows",
    with_views(
        "SELECT show_id, hall_id, movie_id FROM shows LEFT JOIN availability USING (show_id) "
        "WHERE coalesce(available, 0) = 0",
        "show_seats",
        availability=_AVAILABILITY,
    ),
)
def _full(v: Views) -> DataFrame:
    return S.full_shows(v.shows, v.show_seats).select("show_id", "hall_id", "movie_id")


_CHANGED = """SELECT show_id, CASE WHEN (row_index + col_index) % 3 = 0 AND status = 'PENDING' THEN 'AVAILABLE'
  WHEN row_index = 1 AND col_index = 2 THEN 'UNAVAILABLE' ELSE status END AS status FROM show_seats"""


@plan(
    "seat_word_counts",
    with_views(
        "SELECT show_id, status, count(*) AS n FROM changed GROUP BY show_id, status",
        "show_seats",
        changed=_CHANGED,
    ),
)
def _word_counts(v: Views) -> DataFrame:
    """Seats kept as bits: pending ones of every third place fall free, one place of each hall is closed."""
    words = stored(W.seat_words(v.show_seats, v.halls), "words")
    to = F.when((F.col("row_index") == 1) & (F.col("col_index") == 2), "UNAVAILABLE")
    freed = ((F.col("row_index") + F.col("col_index")) % 3 == 0) & (F.col("status") == "PENDING")
    changes = v.show_seats.withColumn("new_status", F.when(freed, "AVAILABLE").otherwise(to)).filter("new_status IS NOT NULL")
    return W.status_counts(W.moved(words, changes, v.halls))


_PAIRED = """SELECT a.*, b.show_id AS id2, b.start_time AS s2, b.end_time AS e2 FROM {asked} a JOIN shows b
  ON b.hall_id = a.hall_id AND a.start_time <= b.end_time AND a.end_time >= b.start_time AND a.show_id <> b.show_id"""
_NAMED = """coalesce(
  max({{'k': e2, 'id': id2}}) FILTER (WHERE s2 < start_time OR (s2 = start_time AND id2 < show_id)),
  max({{'k': s2, 'id': id2}}) FILTER (WHERE s2 > start_time OR (s2 = start_time AND id2 > show_id))).id AS conflict_with""".format()


@plan(
    "show_conflicts",
    with_views(
        f"SELECT show_id, hall_id, count(*) AS n_conflicts, {_NAMED} FROM paired GROUP BY show_id, hall_id, start_time",
        "shows",
        paired=_PAIRED.format(asked="shows"),
    ),
)
def _conflicts(v: Views) -> DataFrame:
    met = S.conflicts(v.shows, v.shows).filter("n_conflicts > 0")
    return met.select("show_id", "hall_id", "n_conflicts", "conflict_with")


@plan(
    "show_conflicts_endpoint",
    with_views(
        "SELECT a.show_id AS candidate_id, b.show_id FROM shows a JOIN shows b ON a.hall_id = b.hall_id AND a.show_id <> b.show_id "
        "AND (a.start_time BETWEEN b.start_time AND b.end_time OR a.end_time BETWEEN b.start_time AND b.end_time)",
        "shows",
    ),
)
def _endpoint(v: Views) -> DataFrame:
    """Pairs of shows of a hall in which the second holds the start or the end of the first."""
    return S.conflicting_shows(v.shows, v.shows, mode="endpoint").select("candidate_id", "show_id")


@plan(
    "show_schedule",
    with_views(
        "SELECT t.request_id, t.hall_id, t.movie_id, t.start_time, t.end_time, t.seats, t.reason, "
        "CASE WHEN t.reason IS NULL THEN coalesce(c.n, 0) END AS n_conflicts, c.conflict_with "
        "FROM timed t LEFT JOIN counted c ON c.show_id = 'new:' || t.request_id",
        "show_requests",
        "halls",
        "movies",
        timed="""SELECT r.*, CASE WHEN h.hall_id IS NULL THEN 'Hall is not found'
            WHEN m.movie_id IS NULL THEN 'Movie is not found'
            WHEN r.start_time IS NULL THEN 'Invaild date format, it must be dd/MM/yyyy HH:mm' END AS reason,
            CASE WHEN h.hall_id IS NOT NULL THEN r.start_time + to_minutes(m.duration_mins + 10) END AS end_time,
            CASE WHEN r.start_time IS NOT NULL THEN h.total_row * h.total_col END AS seats
            FROM show_requests r LEFT JOIN halls h USING (hall_id) LEFT JOIN movies m USING (movie_id)""",
        asked="SELECT 'new:' || request_id AS show_id, hall_id, start_time, end_time FROM timed WHERE reason IS NULL",
        paired=_PAIRED.format(asked="asked"),
        counted=f"SELECT show_id, count(*) AS n, {_NAMED} FROM paired GROUP BY show_id, hall_id, start_time",
    ),
)
def _schedule(v: Views) -> DataFrame:
    v.shows = stored(v.shows, "shows")  # derived here; shows proper are a stored table
    return S.schedule(v.show_requests, v.halls, v.movies, v.shows).drop("start_text")


@plan(
    "show_updates",
    with_views(
        """SELECT show_id, hall_id, movie_id, start_time, end_time, full_reason AS reason,
             full_reason IS NULL AND hall_id <> old_hall AS resets_seats
           FROM (SELECT t.*, coalesce(t.reason, CASE WHEN t.moved THEN 'Conflict start/end time with show ID: '
                   || (SELECT coalesce(
                         max({'k': s.end_time, 'id': s.show_id}) FILTER (WHERE s.start_time <= t.start_time),
                         max({'k': s.start_time, 'id': s.show_id}) FILTER (WHERE s.start_time > t.start_time)).id
                       FROM shows s WHERE s.hall_id = t.hall_id AND s.show_id <> t.show_id
                       AND s.start_time <= t.end_time AND s.end_time >= t.start_time) END) AS full_reason
                 FROM timed t)""",
        "show_updates",
        "halls",
        "movies",
        timed="""SELECT u.show_id, u.hall_id, u.movie_id, s.hall_id AS old_hall,
            coalesce(asked_start, s.start_time) AS start_time, asked_start <> s.start_time AS moved,
            CASE WHEN asked_start <> s.start_time THEN asked_start + to_minutes(m.duration_mins + 10)
                 ELSE s.end_time END AS end_time,
            CASE WHEN s.show_id IS NULL THEN 'Show not found' WHEN h.hall_id IS NULL THEN 'Hall is not found'
                 WHEN m.movie_id IS NULL THEN 'Movie is not found' END AS reason
            FROM show_updates u LEFT JOIN shows s USING (show_id) LEFT JOIN halls h ON h.hall_id = u.hall_id
            LEFT JOIN movies m ON m.movie_id = u.movie_id""",
    ),
)
def _updates(v: Views) -> DataFrame:
    v.shows = stored(v.shows, "shows")  # derived here; shows proper are a stored table
    return S.update_shows(v.shows, v.show_updates, v.halls, v.movies)


@plan(
    "show_seats_without_hall",
    with_views(
        "SELECT hall_id, status, count(*) AS n FROM show_seats ANTI JOIN small USING (hall_id) GROUP BY hall_id, status",
        "show_seats",
        small="SELECT hall_id FROM halls WHERE total_row < 5 OR total_col < 5",
    ),
)
def _without_hall(v: Views) -> DataFrame:
    small = v.halls.filter("total_row < 5 OR total_col < 5")
    return S.without_halls(v.show_seats, small).groupBy("hall_id", "status").agg(F.count(F.lit(1)).alias("n"))


_RESIZED = {
    "after": """SELECT h.hall_id, c.new_name AS name, c.new_row AS total_row, c.new_col AS total_col,
        c.new_row <> h.total_row OR c.new_col <> h.total_col AS resized FROM halls h JOIN hall_changes c USING (hall_id)""",
}


@plan(
    "hall_resize",
    with_views(
        "SELECT hall_id, CAST(row_index AS INTEGER) AS row_index, CAST(col_index AS INTEGER) AS col_index, "
        "name || CAST(row_index AS VARCHAR) || '.' || CAST(col_index AS VARCHAR) AS seat_name FROM ("
        "SELECT *, unnest(range(total_col)) AS col_index FROM (SELECT *, unnest(range(total_row)) AS row_index "
        "FROM after WHERE resized))",
        "hall_changes",
        **_RESIZED,
    ),
)
def _resize(v: Views) -> DataFrame:
    _, rebuilt = S.resize_halls(v.halls, v.hall_changes)
    return S.hall_seats(rebuilt).select("hall_id", "row_index", "col_index", "seat_name")


@plan(
    "hall_resize_show_seats",
    with_views(
        "SELECT show_id, count(*) AS n FROM show_seats WHERE hall_id NOT IN (SELECT hall_id FROM after WHERE resized) "
        "GROUP BY show_id",
        "show_seats",
        "hall_changes",
        **_RESIZED,
    ),
)
def _resize_seats(v: Views) -> DataFrame:
    _, rebuilt = S.resize_halls(v.halls, v.hall_changes)
    return S.without_halls(v.show_seats, rebuilt).groupBy("show_id").agg(F.count(F.lit(1)).alias("n"))


def seat_edit_requests(v: Views) -> DataFrame:
    """An edit for most seats, some of them of unknown type, status or seat."""
    h, r, c = F.col("hall_id"), F.col("row_index"), F.col("col_index")
    kind = F.when(c == 0, "premium").when(c == 1, "Regular").when(c == 2, "vip").otherwise("PREMIUM")
    status = F.when(r == 0, "unavailable").when(r == 3, "broken").otherwise("AVAILABLE")
    return S.hall_seats(v.halls).select(
        "hall_id",
        F.when((h + c) % 11 == 0, r + 100).otherwise(r).alias("row_index"),
        "col_index",
        kind.alias("new_type"),
        status.alias("new_status"),
    )


@plan(
    "seat_edits",
    with_views(
        """SELECT hall_id, CAST(row_index AS INTEGER) AS row_index, CAST(col_index AS INTEGER) AS col_index, seat_name, reason,
             CASE WHEN reason IS NULL AND new_type IS NOT NULL THEN upper(new_type) ELSE seat_type END AS seat_type,
             CASE WHEN reason IS NULL AND new_type IS NOT NULL THEN upper(new_status) ELSE status END AS status,
             CASE WHEN reason IS NULL AND new_type IS NOT NULL AND upper(new_type) = 'PREMIUM' THEN 20000.0::DOUBLE
                  ELSE price END AS price FROM judged""",
        "hall_seats",
        edits="""SELECT hall_id, CASE WHEN (hall_id + col_index) % 11 = 0 THEN row_index + 100 ELSE row_index END
            AS row_index, col_index, CASE col_index WHEN 0 THEN 'premium' WHEN 1 THEN 'Regular' WHEN 2 THEN 'vip'
            ELSE 'PREMIUM' END AS new_type, CASE row_index WHEN 0 THEN 'unavailable' WHEN 3 THEN 'broken'
            ELSE 'AVAILABLE' END AS new_status FROM hall_seats""",
        judged="""SELECT *, CASE WHEN seat_name IS NULL THEN 'Seat not found'
            WHEN new_type IS NULL THEN NULL
            WHEN upper(new_type) NOT IN ('REGULAR', 'PREMIUM') THEN 'Invalid seat type. It must be REGULAR or PREMIUM'
            WHEN upper(new_status) NOT IN ('UNAVAILABLE', 'AVAILABLE', 'PENDING', 'BOOKED', 'CANCLED')
              THEN 'Status is not found. It must be AVAILABLE or UNAVAILABLE' END AS reason
            FROM hall_seats FULL JOIN edits USING (hall_id, row_index, col_index)""",
    ),
)
def _edits(v: Views) -> DataFrame:
    return S.edit_seats(S.hall_seats(v.halls), seat_edit_requests(v))


_LEFT = """SELECT * FROM shows WHERE NOT (start_time < TIMESTAMP '1997-01-01 00:00:00'
  OR start_time >= TIMESTAMP '2000-01-01 00:00:00')"""


@plan(
    "shows_after_delete",
    with_views("SELECT show_id, hall_id, movie_id, start_time FROM remaining", "shows", remaining=_LEFT),
)
def _deleted(v: Views) -> DataFrame:
    return S.delete_shows(v.shows, v.show_seats, v.show_deletes)[0].select("show_id", "hall_id", "movie_id", "start_time")


@plan(
    "show_seats_after_delete",
    with_views(
        "SELECT show_id, count(*) AS n FROM show_seats SEMI JOIN remaining USING (show_id) GROUP BY show_id",
        "show_seats",
        remaining=_LEFT,
    ),
)
def _deleted_seats(v: Views) -> DataFrame:
    left = S.delete_shows(v.shows, v.show_seats, v.show_deletes)[1]
    return left.groupBy("show_id").agg(F.count(F.lit(1)).alias("n"))
