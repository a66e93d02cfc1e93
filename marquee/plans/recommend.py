from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators import recommend as M
from marquee.operators.bookings import of_user_movie
from marquee.plans.oracle import with_views
from marquee.plans.registry import plan
from marquee.sources.testdata import Views

_WATCHED = {
    "watched": """SELECT user_id, movie_id, count(*) AS n FROM bookings JOIN shows USING (show_id)
        WHERE status = 'BOOKED' GROUP BY user_id, movie_id""",
    "vectors": """SELECT user_id, genre, CAST(sum(n) AS BIGINT) AS weight FROM watched JOIN movie_genre USING (movie_id)
        GROUP BY user_id, genre""",
    "user_norms": "SELECT user_id, sum(weight * weight) AS un FROM vectors GROUP BY user_id",
    "movie_norms": "SELECT movie_id, count(*) AS mn FROM movie_genre GROUP BY movie_id",
}
_VIEWS = ("bookings", "shows", "movie_genre")


def watched(v: Views) -> DataFrame:
    return M.watched_counts(v.bookings, v.shows)


@plan("user_genre_vector", with_views("SELECT user_id, genre, weight FROM vectors", *_VIEWS, **_WATCHED))
def _user_vector(v: Views) -> DataFrame:
    return M.user_genre_vector(watched(v), v.movie_genre)


@plan("movie_genre_vector", with_views("SELECT movie_id, genre, 1 AS weight FROM movie_genre", "movie_genre"))
def _movie_vector(v: Views) -> DataFrame:
    return M.movie_genre_vector(v.movie_genre)


@plan(
    "unwatched_movies",
    with_views(
        "SELECT DISTINCT user_id, movie_id FROM bookings JOIN shows USING (show_id) WHERE status = 'CANCLED' "
        "EXCEPT SELECT user_id, movie_id FROM watched",
        *_VIEWS,
        **_WATCHED,
    ),
)
def _unwatched(v: Views) -> DataFrame:
    cancelled = of_user_movie(v.bookings, v.shows, "CANCLED").select("user_id", "movie_id").distinct()
    return M.unwatched(cancelled, watched(v))


@plan(
    "user_movie_cosine",
    with_views(
        "SELECT user_id, movie_id, round(CASE WHEN un > 0 AND mn > 0 THEN coalesce(dot, 0) / (sqrt(un) * sqrt(mn)) "
        "ELSE 0 END, 9) AS cosine FROM (SELECT DISTINCT user_id, movie_id FROM bookings JOIN shows USING (show_id)) "
        "LEFT JOIN dots USING (user_id, movie_id) LEFT JOIN user_norms USING (user_id) "
        "LEFT JOIN movie_norms USING (movie_id)",
        *_VIEWS,
        **_WATCHED,
        dots="""SELECT p.user_id, p.movie_id, sum(weight) AS dot FROM (SELECT DISTINCT user_id, movie_id FROM bookings
            JOIN shows USING (show_id)) p JOIN movie_genre g USING (movie_id) JOIN vectors v
            ON v.user_id = p.user_id AND v.genre = g.genre GROUP BY p.user_id, p.movie_id""",
    ),
)
def _cosine(v: Views) -> DataFrame:
    pairs = v.bookings.join(v.shows.select("show_id", "movie_id"), "show_id").select("user_id", "movie_id").distinct()
    vectors = M.user_genre_vector(watched(v), v.movie_genre)
    return M.cosines(pairs, vectors, M.movie_genre_vector(v.movie_genre)).withColumn("cosine", F.round("cosine", 9))


@plan(
    "recommendations",
    with_views(
        """SELECT user_id, movie_id, round(score, 9) AS score, CAST(place AS INTEGER) AS place FROM (
             SELECT u.user_id, m.movie_id, coalesce(dot, 0) / (sqrt(un) * sqrt(mn)) AS score,
               row_number() OVER (PARTITION BY u.user_id ORDER BY coalesce(dot, 0) / (sqrt(un) * sqrt(mn)) DESC, m.movie_id)
                 AS place
             FROM user_norms u CROSS JOIN movie_norms m
             LEFT JOIN dots d ON d.user_id = u.user_id AND d.movie_id = m.movie_id
             WHERE NOT EXISTS (SELECT 1 FROM watched w WHERE w.user_id = u.user_id AND w.movie_id = m.movie_id))
           WHERE place <= 8""",
        *_VIEWS,
        **_WATCHED,
        dots="""SELECT user_id, movie_id, sum(weight) AS dot FROM vectors JOIN movie_genre USING (genre)
            GROUP BY user_id, movie_id""",
    ),
)
def _recommendations(v: Views) -> DataFrame:
    best = M.recommend(watched(v), v.movie_genre)
    return best.select("user_id", "movie_id", F.round("score", 9).alias("score"), "place")


@plan(
    "recommendations_cold",
    with_views(
        "SELECT user_id, movie_id, CAST(place AS INTEGER) AS place FROM users CROSS JOIN (SELECT movie_id, "
        "row_number() OVER (ORDER BY created_at DESC, movie_id) AS place FROM movies) "
        "WHERE place <= 10 AND user_id NOT IN (SELECT user_id FROM vectors)",
        "users",
        "movies",
        *_VIEWS,
        **_WATCHED,
    ),
)
def _cold(v: Views) -> DataFrame:
    return M.recommend_cold(v.users, watched(v), v.movie_genre, v.movies).select("user_id", "movie_id", "place")
