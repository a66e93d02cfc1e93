from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators import quality as Q
from marquee.plans.oracle import with_views
from marquee.plans.registry import plan
from marquee.sources.testdata import Views


@plan(
    "invalid_ratings",
    with_views("SELECT comment_id, movie_id, rated FROM comments WHERE rated < 0 OR rated > 5", "comments"),
)
def _ratings(v: Views) -> DataFrame:
    return Q.invalid_ratings(v.comments).select("comment_id", "movie_id", "rated")


@plan(
    "invalid_halls",
    with_views(
        r"""SELECT * FROM (SELECT hall_id, name, total_row, total_col, CASE WHEN regexp_matches(name,
             '(?i)(^|\W)(select|drop|alter|insert|update|delete)(\W|\z)|(^|\W)\d+\W+(union|select|table|information_schema)(\W|\z)')
               THEN 'Illeagal charaters in name'
             WHEN name IN (SELECT name FROM proposed GROUP BY name HAVING count(*) > 1) THEN 'This hall is existed'
             WHEN total_row < 5 OR total_col < 5 THEN 'Row/Column number must be greater than 5' END AS reason
           FROM proposed) WHERE reason IS NOT NULL""",
        "halls",
        proposed="""SELECT * REPLACE (CASE WHEN hall_id % 9 = 4 THEN name || ' Drop' WHEN hall_id % 9 = 2 THEN 'Main hall'
            ELSE name END AS name) FROM halls""",
    ),
)
def _halls(v: Views) -> DataFrame:
    kind = F.col("hall_id") % 9
    name = F.when(kind == 4, F.concat("name", F.lit(" Drop"))).when(kind == 2, "Main hall").otherwise(F.col("name"))
    return Q.invalid_halls(v.halls.withColumn("name", name)).select("hall_id", "name", "total_row", "total_col", "reason")


_UNIQUE = [
    ("title", "movies", "title"),
    ("hall name", "halls", "name"),
    ("genre", "genres", "genre"),
    ("email", "users", "email"),
    ("username", "users", "username"),
]


@plan(
    "duplicate_keys",
    with_views(
        " UNION ALL ".join(
            f"SELECT '{kind}' AS kind, {column} AS key, count(*) AS n FROM {view} GROUP BY {column} HAVING count(*) > 1"
            for kind, view, column in _UNIQUE
        ),
        "movies",
        "halls",
        "users",
        "movie_genre",
        genres="SELECT DISTINCT genre FROM movie_genre",
    ),
)
def _duplicates(v: Views) -> DataFrame:
    return Q.duplicate_keys({kind: (getattr(v, view), column) for kind, view, column in _UNIQUE})


@plan(
    "missing_fields",
    with_views(
        """SELECT 'comment' AS kind, request_id, concat_ws(', ', CASE WHEN movie_id IS NULL THEN 'movie_id' END,
             CASE WHEN trim(comment) = '' THEN 'comment' END) AS missing FROM comment_requests
             WHERE movie_id IS NULL OR trim(comment) = ''
           UNION ALL SELECT 'show', request_id, 'start_text' FROM blank_starts WHERE start_text IS NULL
           UNION ALL SELECT 'booking', request_id, CASE WHEN seatless AND showless THEN 'seat_ids, show_id'
             WHEN seatless THEN 'seat_ids' ELSE 'show_id' END FROM bare_bookings WHERE seatless OR showless""",
        "comment_requests",
        "show_requests",
        "booking_requests",
        bare_bookings="""SELECT DISTINCT request_id, CAST(request_id AS BIGINT) % 37 = 0 AS seatless,
            show_id = 'no-show' AS showless FROM booking_requests""",
        blank_starts="SELECT request_id, nullif(start_text, 'x') AS start_text FROM show_requests",
    ),
)
def _missing(v: Views) -> DataFrame:
    shows = v.show_requests.withColumn("start_text", F.nullif("start_text", F.lit("x")))
    unnamed = F.when(F.col("show_id") == "no-show", " ").otherwise(F.col("show_id"))
    seats = F.when(F.col("request_id").cast("long") % 37 != 0, F.col("seat_ids"))
    bookings = v.booking_requests.withColumns({"show_id": unnamed, "seat_ids": seats})
    found = {
        "comment": Q.missing_fields(v.comment_requests, ["movie_id", "comment"]),
        "show": Q.missing_fields(shows, ["hall_id", "movie_id", "start_text"]),
        "booking": Q.missing_fields(bookings, ["seat_ids", "show_id"]),
    }
    comment, show, booking = (
        df.select(F.lit(kind).alias("kind"), "request_id", F.array_join("missing", ", ").alias("missing"))
        for kind, df in found.items()
    )
    return comment.unionByName(show).unionByName(booking)


# The password rule needs look-ahead, which the oracle's patterns lack: one test per part.
_FLAGS = r"""
  regexp_matches(text, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z') AS is_email,
  regexp_matches(text, '(?i)(^|\W)(select|drop|alter|insert|update|delete)(\W|\z)|(^|\W)\d+\W+(union|select|table|information_schema)(\W|\z)') AS has_sql,
  regexp_matches(text, '(?s)[<>"''].') AS has_xss,
  regexp_matches(text, '^[a-zA-Z0-9\-_.!~*''()]*\z') AS is_normal_text,
  regexp_matches(text, '[0-9]') AND regexp_matches(text, '[a-z]') AND regexp_matches(text, '[A-Z]')
    AND regexp_matches(text, '[@#$%^&+=!]') AND NOT regexp_matches(text, '\s') AND length(text) >= 8 AS is_good_password,
  regexp_matches(text, '^[a-zA-Z0-9._]{5,}\z') AS is_username"""


@plan(
    "text_quality_flags",
    with_views(
        f"SELECT source, id, {_FLAGS} FROM (SELECT 'comment' AS source, comment_id AS id, comment AS text FROM comments "
        "UNION ALL SELECT 'email', user_id, email FROM users UNION ALL SELECT 'username', user_id, username FROM users "
        "UNION ALL SELECT 'full name', user_id, full_name FROM users)",
        "comments",
        "users",
    ),
)
def _flags(v: Views) -> DataFrame:
    def texts(source: str, df: DataFrame, key: str, column: str) -> DataFrame:
        return df.select(F.lit(source).alias("source"), F.col(key).alias("id"), F.col(column).alias("text"))

    text = (
        texts("comment", v.comments, "comment_id", "comment")
        .unionByName(texts("email", v.users, "user_id", "email"))
        .unionByName(texts("username", v.users, "user_id", "username"))
        .unionByName(texts("full name", v.users, "user_id", "full_name"))
    )
    return Q.text_flags(text, "text").drop("text")


@plan(
    "login_throttle",
    with_views(
        """SELECT attempt_id, login_key, ts, attempt_no, attempt_no > 2 AS rejected FROM (
             SELECT a.attempt_id, a.login_key, a.ts, row_number() OVER (PARTITION BY a.login_key, o.t
               ORDER BY a.ts, a.attempt_id) AS attempt_no
             FROM login_attempts a ASOF JOIN opened o ON o.login_key = a.login_key AND a.ts >= o.t)""",
        "login_attempts",
        opened="""SELECT login_key, min(ts) AS t FROM login_attempts GROUP BY login_key
            UNION ALL SELECT o.login_key, min(a.ts) FROM opened o JOIN login_attempts a
            ON a.login_key = o.login_key AND a.ts >= o.t + INTERVAL 1 DAY GROUP BY o.login_key, o.t""",
    ),
)
def _throttle(v: Views) -> DataFrame:
    return Q.login_throttle(v.login_attempts, limit=2, seconds=86_400, source=v.table("events"))
