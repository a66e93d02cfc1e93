"""Movies, genres, comments and users: search, listings and edits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee import fixed_values as V
from marquee.functions.text import escape_html, fold_accents, role_text, stars

# -- search -------------------------------------------------------------------


def contains_filter(df: DataFrame, column: str, keyword: str) -> DataFrame:
    """Case-sensitive substring filter."""
    return df.filter(F.contains(F.col(column), F.lit(keyword)))


def title_search(movies: DataFrame, keyword: str) -> DataFrame:
    """Titles that hold the keyword as it stands; case does not matter."""
    return movies.filter(F.contains(F.lower("title"), F.lower(F.lit(keyword))))


def genre_search(movies: DataFrame, movie_genre: DataFrame, keyword: str) -> DataFrame:
    """Movies, once each, with a genre like %keyword%; % and _ in the keyword are wildcards."""
    hits = movie_genre.filter(F.lower("genre").like(f"%{keyword.lower()}%"))
    return movies.join(hits.select("movie_id"), "movie_id", "left_semi")


def folded_search(movies: DataFrame, keyword: str) -> DataFrame:
    """Title search that sees neither case nor accents."""
    return movies.filter(F.contains(fold_accents(F.col("title")), fold_accents(F.lit(keyword))))


def known_genres(asked: DataFrame, genres: DataFrame) -> DataFrame:
    """Asked genre names with whether they exist."""
    return asked.join(genres.select("genre", F.lit(True).alias("known")), "genre", "left").withColumn(
        "known", F.coalesce("known", F.lit(False))
    )


def genres_in(genres: DataFrame, names: Sequence[str]) -> DataFrame:
    return genres.filter(F.col("genre").isin(list(names)))


def with_all_genres(movies: DataFrame, movie_genre: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Movies that have every wanted genre."""
    names = sorted(set(wanted))
    matching = (
        movie_genre.filter(F.col("genre").isin(names))
        .groupBy("movie_id")
        .agg(F.countDistinct("genre").alias("_n"))
        .filter(F.col("_n") == len(names))
    )
    return movies.join(matching, "movie_id", "left_semi")


# -- listings -----------------------------------------------------------------


def page(movies: DataFrame, number: int, size: int) -> DataFrame:
    """One page in order of id; a page holds at most PAGE_SIZE_CAP rows."""
    size = min(size, V.PAGE_SIZE_CAP)
    return movies.orderBy("movie_id").offset(number * size).limit(size)


def newest(movies: DataFrame, n: int = V.NEWEST_MOVIES) -> DataFrame:
    return movies.orderBy(F.desc("created_at"), "movie_id").limit(n)


def genre_lists(movie_genre: DataFrame) -> DataFrame:
    """Sorted genres per movie; no longer than the list of genres."""
    return movie_genre.groupBy("movie_id").agg(F.sort_array(F.collect_set("genre")).alias("genres"))


def popularity(movies: DataFrame, shows: DataFrame, bookings: DataFrame) -> DataFrame:
    """Booked tickets per movie, none included, most booked first."""
    per_show = bookings.filter("status = 'BOOKED'").groupBy("show_id").agg(F.count(F.lit(1)).alias("n"))
    per_movie = shows.select("show_id", "movie_id").join(per_show, "show_id").groupBy("movie_id").agg(F.sum("n").alias("n"))
    return (
        movies.join(per_movie, "movie_id", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .orderBy(F.desc("n"), "movie_id")
    )


def catalog(
    movies: DataFrame, movie_genre: DataFrame, comments: DataFrame, users: DataFrame, comments_per_part: int = 1_000
) -> DataFrame:
    """Movies with their genres and comments nested.

    A movie with many comments comes as several rows, parts of about
    `comments_per_part`; a comment's part follows from its id and the movie's
    number of comments, so no task ever holds all comments of a movie.
    `n_comments` is that number, the same in every part.
    """
    named = comments.join(users.select("user_id", "username"), "user_id")
    sizes = named.groupBy("movie_id").agg(F.count(F.lit(1)).alias("n_comments"))
    sizes = sizes.withColumn("parts", F.ceil(F.col("n_comments") / F.lit(comments_per_part)))
    spread = F.conv(F.substring(F.md5("comment_id"), 1, 8), 16, 10).cast("long")
    nested = (
        named.join(sizes, "movie_id")
        .withColumn("part", spread % F.col("parts"))
        .groupBy("movie_id", "n_comments", "parts", "part")
        .agg(
            F.sort_array(
                F.collect_list(F.struct("comment_id", "username", "comment", "rated", "liked", "disliked", "update_at"))
            ).alias("comments")
        )
    )
    return (
        movies.join(genre_lists(movie_genre), "movie_id", "left")
        .join(nested, "movie_id", "left")
        .withColumn("n_comments", F.coalesce("n_comments", F.lit(0).cast("long")))
        .withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
        .withColumn("part", F.coalesce("part", F.lit(0).cast("long")))
    )


def comments_with_names(comments: DataFrame, users: DataFrame) -> DataFrame:
    return comments.join(users.select("user_id", "username"), "user_id").withColumn("stars", stars(F.col("rated")))


def latest_first(named_comments: DataFrame) -> DataFrame:
    return named_comments.orderBy("movie_id", F.desc("update_at"), "comment_id")


def oldest_day_first(named_comments: DataFrame) -> DataFrame:
    return named_comments.orderBy("username", F.to_date("update_at"), "comment_id")


def users_with_roles(users: DataFrame, user_roles: DataFrame) -> DataFrame:
    roles = user_roles.groupBy("user_id").agg(F.sort_array(F.collect_set("role")).alias("roles"))
    return users.join(roles, "user_id", "left").withColumn("role_text", role_text(F.col("roles")))


# -- comments and imports -----------------------------------------------------


def eligible_reviewers(watched: DataFrame, comments: DataFrame) -> DataFrame:
    """(user, movie) with a booked ticket and no comment yet."""
    return watched.select("user_id", "movie_id").distinct().join(comments, ["user_id", "movie_id"], "left_anti")


def escaped(comments: DataFrame) -> DataFrame:
    return comments.withColumn("comment", escape_html(F.col("comment")))


def edit_comments(comments: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits with the rating they leave behind, or a reason.

    Only the owner may edit; a rating that does not change is not checked.
    """
    current = comments.select("comment_id", F.col("user_id").alias("_owner"), "rated")
    bad = ~F.col("new_rated").between(V.MIN_RATING, V.MAX_RATING) & (F.col("new_rated") != F.col("rated"))
    reason = (
        F.when(F.col("_owner").isNull(), "Comment is not found")
        .when(F.col("_owner") != F.col("user_id"), V.NOT_OWNER)
        .when(bad, V.BAD_RATING)
    )
    return (
        edits.join(current, "comment_id", "left")
        .withColumn("reason", reason)
        .withColumn("rated", F.when(F.col("reason").isNull(), F.col("new_rated")).otherwise(F.col("rated")))
        .drop("_owner")
    )


def import_movies(incoming: DataFrame, movies: DataFrame, genres: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new movies, their genre rows): known titles are rejected, unknown genres dropped.

    Of several incoming movies with one title the first is taken.
    """
    first = incoming.groupBy("title").agg(F.min("incoming_id").alias("incoming_id"))
    new = first.join(movies.select("title"), "title", "left_anti")
    taken = incoming.join(new.select("incoming_id"), "incoming_id", "left_semi")
    bridge = taken.select("incoming_id", F.explode("genres").alias("genre")).join(genres.select("genre"), "genre", "left_semi")
    return taken.select("incoming_id", "title"), bridge
