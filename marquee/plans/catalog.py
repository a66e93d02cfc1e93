from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import duration_text
from marquee.operators import catalog as C
from marquee.operators import search as X
from marquee.operators.bookings import of_user_movie
from marquee.plans.oracle import with_views
from marquee.plans.registry import plan
from marquee.session import materialize, scratch_folder
from marquee.sources.testdata import Views

# -- search -------------------------------------------------------------------

_MOVIE = "movie_id, title, duration_mins, created_at, country"


@plan("movie_title_search", with_views(f"SELECT {_MOVIE} FROM movies WHERE contains(lower(title), 'ring')", "movies"))
def _title(v: Views) -> DataFrame:
    return C.title_search(v.movies, "RING")


@plan(
    "movie_genre_search",
    with_views(
        f"SELECT {_MOVIE} FROM movies WHERE movie_id IN (SELECT movie_id FROM movie_genre WHERE lower(genre) LIKE '%r_n%')",
        "movies",
        "movie_genre",
    ),
)
def _genre(v: Views) -> DataFrame:
    return C.genre_search(v.movies, v.movie_genre, "R_n")


@plan(
    "genres_in_list",
    with_views("SELECT genre, count(*) AS n FROM movie_genre WHERE genre IN ('red', 'blue', 'no such genre') GROUP BY genre", "movie_genre"),
)
def _genres_in(v: Views) -> DataFrame:
    """Movies of each listed genre that exists."""
    return C.genres_in(v.movie_genre, ["red", "blue", "no such genre"]).groupBy("genre").agg(F.count(F.lit(1)).alias("n"))


@plan(
    "genre_lookup",
    with_views(
        "SELECT genre, known, contains(genre, 'e') AS has_e, genre IN ('red', 'ring', 'economy') AS listed FROM ("
        "SELECT genre, genre IN (SELECT genre FROM movie_genre) AS known FROM ("
        "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS genre FROM incoming_movies "
        "UNION SELECT DISTINCT p_brand FROM incoming_movies))",
        "movie_genre",
        "incoming_movies",
    ),
)
def _lookup(v: Views) -> DataFrame:
    asked = v.incoming_movies.select(F.explode("genres").alias("genre")).distinct()
    known = C.known_genres(asked, v.genres)
    return known.select(
        "genre",
        "known",
        F.contains("genre", F.lit("e")).alias("has_e"),
        F.col("genre").isin("red", "ring", "economy").alias("listed"),
    )


@plan(
    "movies_all_genres",
    with_views(
        f"SELECT {_MOVIE} FROM movies WHERE movie_id IN (SELECT movie_id FROM movie_genre WHERE genre = 'red') "
        "AND movie_id IN (SELECT movie_id FROM movie_genre WHERE genre = 'economy')",
        "movies",
        "movie_genre",
    ),
)
def _all_genres(v: Views) -> DataFrame:
    return C.with_all_genres(v.movies, v.movie_genre, ["red", "economy"])


@plan(
    "movie_search_folded",
    with_views(f"SELECT {_MOVIE} FROM movies WHERE contains(strip_accents(lower(title)), 'red')", "movies"),
)
def _folded(v: Views) -> DataFrame:
    return C.folded_search(v.movies, "Rẽđ")


_ADMIN = [
    ("user", "users", "username", "user_id", "99"),
    ("booking", "bookings", "booking_id", "booking_id", "77"),
    ("hall", "halls", "name", "hall_id", "01"),
    ("movie", "movies", "title", "movie_id", "blue"),
]


@plan(
    "admin_contains",
    with_views(
        " UNION ALL ".join(
            f"SELECT '{kind}' AS kind, CAST({key} AS VARCHAR) AS id, {column} AS text FROM {view} WHERE contains({column}, '{k}')"
            for kind, view, column, key, k in _ADMIN
        )
        + " UNION ALL SELECT 'show', show_id, title FROM shows JOIN movies USING (movie_id) WHERE contains(title, 'green')"
        + " UNION ALL SELECT DISTINCT 'genre', genre, genre FROM movie_genre WHERE contains(genre, 'e')",
        "users",
        "bookings",
        "halls",
        "movies",
        "shows",
        "movie_genre",
    ),
)
def _admin(v: Views) -> DataFrame:
    def found(kind: str, df: DataFrame, column: str, key: str, keyword: str) -> DataFrame:
        return C.contains_filter(df, column, keyword).select(
            F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), F.col(column).alias("text")
        )

    parts = [found(kind, getattr(v, view), column, key, k) for kind, view, column, key, k in _ADMIN]
    parts.append(found("show", v.shows.join(v.movies, "movie_id"), "title", "show_id", "green"))
    parts.append(found("genre", v.genres, "genre", "genre", "e"))
    return reduce(DataFrame.unionByName, parts)


_KEYWORDS = """SELECT DISTINCT keyword FROM (SELECT unnest(string_split(title, ' ')) AS keyword FROM movies
  UNION ALL SELECT upper(title) FROM movies UNION ALL SELECT substr(title, 3, 5) FROM movies
  UNION ALL SELECT * FROM (VALUES ('re'), ('zz'), ('no such title'), ('l')))"""


@plan(
    "title_index_search",
    with_views(
        "SELECT keyword, count(*) AS n, min(movie_id) AS first, sum(movie_id)::BIGINT AS total "
        "FROM keywords JOIN movies ON contains(lower(title), lower(keyword)) GROUP BY keyword",
        "movies",
        keywords=_KEYWORDS,
    ),
)
def _title_index(v: Views) -> DataFrame:
    """Every word, whole title and middle of a title looked for through an index of all titles."""
    t, spark = F.col("title"), v.spark
    given = F.array_union(F.split(t, " "), F.array(F.upper(t), F.substring(t, 3, 5)))
    words = v.movies.select(F.explode(given).alias("keyword"))
    words = words.unionByName(spark.createDataFrame([(k,) for k in ("re", "zz", "no such title", "l")], "keyword string"))
    path = scratch_folder(spark, "titles")
    X.build_index(v.movies, "movie_id", "title", path)
    found = X.search_all(v.movies, "movie_id", "title", path, words, mode="case")
    return found.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"), F.min("movie_id").alias("first"), F.sum("movie_id").alias("total"))


# -- listings -----------------------------------------------------------------


@plan(
    "movies_deep_page",
    with_views(
        f"SELECT {_MOVIE} FROM (SELECT *, row_number() OVER (ORDER BY movie_id) - 1 AS i, count(*) OVER () AS n FROM movies) "
        "WHERE i // 50 = (n - 1) // 50 - 1",
        "movies",
    ),
)
def _deep_page(v: Views) -> DataFrame:
    """The last page but one, read where it starts."""
    starts = materialize(X.page_starts(v.movies, "movie_id", 50))
    last = starts.agg(F.max("page")).first()[0]
    return X.page_at(v.movies, "movie_id", starts, last - 1)


@plan("movies_page", with_views(f"SELECT {_MOVIE} FROM movies ORDER BY movie_id LIMIT 50 OFFSET 50", "movies"))
def _page(v: Views) -> DataFrame:
    return C.page(v.movies, 1, 60)


@plan("newest_movies", with_views(f"SELECT {_MOVIE} FROM movies ORDER BY created_at DESC, movie_id LIMIT 10", "movies"))
def _newest(v: Views) -> DataFrame:
    return C.newest(v.movies)


_GENRES_SQL = "SELECT movie_id, string_agg(genre, ', ' ORDER BY genre) AS genres FROM movie_genre GROUP BY movie_id"


@plan(
    "movie_cards",
    with_views(
        "SELECT movie_id, title, CASE WHEN duration_mins < 60 THEN CAST(duration_mins AS VARCHAR) || ' phút' "
        "ELSE CAST(duration_mins // 60 AS VARCHAR) || ' giờ ' || CAST(duration_mins % 60 AS VARCHAR) || ' phút' END "
        "AS duration, genres FROM movies LEFT JOIN genre_lists USING (movie_id)",
        "movies",
        "movie_genre",
        genre_lists=_GENRES_SQL,
    ),
)
def _cards(v: Views) -> DataFrame:
    return v.movies.join(C.genre_lists(v.movie_genre), "movie_id", "left").select(
        "movie_id",
        "title",
        duration_text(F.col("duration_mins")).alias("duration"),
        F.array_join("genres", ", ").alias("genres"),
    )


def catalog_oracle(per_part: int) -> str:
    return with_views(
        "SELECT m.movie_id, title, genres, coalesce(part, 0) AS part, coalesce(n, 0) AS n_comments, "
        "coalesce(comments, '') AS comments FROM movies m "
        "LEFT JOIN genre_lists USING (movie_id) LEFT JOIN nested ON nested.movie_id = m.movie_id",
        "movies",
        "movie_genre",
        "comments",
        "users",
        genre_lists=_GENRES_SQL,
        named=f"""SELECT c.*, username, count(*) OVER (PARTITION BY movie_id) AS n,
            CAST('0x' || substr(md5(comment_id), 1, 8) AS BIGINT)
              % ((count(*) OVER (PARTITION BY movie_id) + {per_part - 1}) // {per_part}) AS part
            FROM comments c JOIN users USING (user_id)""",
        nested="""SELECT movie_id, n, part, string_agg(comment_id || ' ' || username || ' ' || CAST(rated AS VARCHAR)
            || ' ' || comment, chr(10) ORDER BY comment_id) AS comments FROM named GROUP BY movie_id, n, part""",
    )


def catalog_rows(v: Views, per_part: int) -> DataFrame:
    line = "concat_ws(' ', c.comment_id, c.username, cast(c.rated AS string), c.comment)"
    return C.catalog(v.movies, v.movie_genre, v.comments, v.users, per_part).select(
        "movie_id",
        "title",
        F.array_join("genres", ", ").alias("genres"),
        "part",
        "n_comments",
        F.coalesce(F.expr(f"array_join(transform(comments, c -> {line}), chr(10))"), F.lit("")).alias("comments"),
    )


@plan("movie_catalog", catalog_oracle(1_000))
def _catalog(v: Views) -> DataFrame:
    return catalog_rows(v, 1_000)


@plan(
    "movie_popularity",
    with_views(
        "SELECT movie_id, title, coalesce(n, 0) AS n FROM movies LEFT JOIN ("
        "SELECT movie_id, count(*) AS n FROM bookings JOIN shows USING (show_id) WHERE status = 'BOOKED' "
        "GROUP BY movie_id) USING (movie_id)",
        "movies",
        "bookings",
        "shows",
    ),
)
def _popularity(v: Views) -> DataFrame:
    return C.popularity(v.movies, v.shows, v.bookings).select("movie_id", "title", "n")


@plan(
    "comments_by_movie",
    with_views(
        "SELECT movie_id, comment_id, username, comment, rated, liked, disliked, update_at, repeat('♥', rated) AS stars "
        "FROM comments JOIN users USING (user_id)",
        "comments",
        "users",
    ),
)
def _comments(v: Views) -> DataFrame:
    return C.latest_first(C.comments_with_names(v.comments, v.users)).drop("user_id")


@plan(
    "comments_by_username",
    with_views(
        "SELECT username, comment_id, CAST(update_at AS DATE) AS day, rated FROM comments JOIN users USING (user_id)",
        "comments",
        "users",
    ),
)
def _comments_user(v: Views) -> DataFrame:
    return C.oldest_day_first(C.comments_with_names(v.comments, v.users)).select(
        "username", "comment_id", F.to_date("update_at").alias("day"), "rated"
    )


@plan(
    "users_with_roles",
    with_views(
        "SELECT u.user_id, username, email, status, string_agg(role, ',' ORDER BY role) AS roles, "
        "string_agg(substr(role, 6), ', ' ORDER BY role) AS role_text FROM users u LEFT JOIN user_roles USING (user_id) "
        "GROUP BY ALL",
        "users",
        "user_roles",
    ),
)
def _roles(v: Views) -> DataFrame:
    return C.users_with_roles(v.users, v.user_roles).select(
        "user_id", "username", "email", "status", F.array_join("roles", ",").alias("roles"), "role_text"
    )


# -- comments and imports -----------------------------------------------------


@plan(
    "eligible_reviewers",
    with_views(
        "SELECT DISTINCT user_id, movie_id FROM bookings b JOIN shows s USING (show_id) WHERE status = 'BOOKED' "
        "AND NOT EXISTS (SELECT 1 FROM comments c WHERE c.user_id = b.user_id AND c.movie_id = s.movie_id)",
        "bookings",
        "shows",
        "comments",
    ),
)
def _eligible(v: Views) -> DataFrame:
    return C.eligible_reviewers(of_user_movie(v.bookings, v.shows, "BOOKED"), v.comments)


@plan(
    "comments_clean",
    with_views(
        "SELECT comment_id, replace(replace(replace(replace(replace(comment, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
        "'\"', '&#34;'), '''', '&#39;') AS comment FROM comments",
        "comments",
    ),
)
def _clean(v: Views) -> DataFrame:
    return C.escaped(v.comments).select("comment_id", "comment")


@plan(
    "comment_edits",
    with_views(
        "SELECT comment_id, user_id, new_rated, reason, CASE WHEN reason IS NULL THEN new_rated ELSE rated END AS rated "
        "FROM judged",
        "comments",
        "comment_edit_requests",
        judged="""SELECT e.*, c.rated, CASE WHEN c.user_id IS NULL THEN 'Comment is not found'
            WHEN c.user_id <> e.user_id THEN 'This comment is not belonged to you'
            WHEN e.new_rated NOT BETWEEN 0 AND 5 AND e.new_rated <> c.rated
              THEN 'Rating number must be in range 0 and 5' END AS reason
            FROM comment_edit_requests e LEFT JOIN comments c ON c.comment_id = e.comment_id""",
    ),
)
def _edits(v: Views) -> DataFrame:
    return C.edit_comments(v.comments, v.comment_edit_requests)


@plan(
    "movie_import",
    with_views(
        "SELECT incoming_id, title, string_agg(genre, ', ' ORDER BY genre) AS genres FROM taken "
        "LEFT JOIN (SELECT DISTINCT incoming_id AS i, genre FROM ("
        "SELECT incoming_id, unnest(string_split(p_name, ' ')) AS genre FROM incoming_movies) "
        "WHERE genre IN (SELECT genre FROM movie_genre)) ON i = incoming_id GROUP BY incoming_id, title",
        "movies",
        "movie_genre",
        "incoming_movies",
        taken="""SELECT title, min(incoming_id) AS incoming_id FROM incoming_movies
            WHERE title NOT IN (SELECT title FROM movies) GROUP BY title""",
    ),
)
def _import(v: Views) -> DataFrame:
    new, bridge = C.import_movies(v.incoming_movies, v.movies, v.genres)
    genres = C.genre_lists(bridge.withColumnRenamed("incoming_id", "movie_id")).withColumnRenamed("movie_id", "incoming_id")
    return new.join(genres, "incoming_id", "left").select("incoming_id", "title", F.array_join("genres", ", ").alias("genres"))
