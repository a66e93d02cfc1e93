"""Content-based recommendation by cosine of genre counts.

A movie's score depends only on its set of genres, so users are scored against
genre sets, which are far fewer than movies, and only the best sets of a user
are expanded into movies.  Users and sets meet through the genres they share;
users times movies is never formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee import fixed_values as V
from marquee.operators.catalog import newest
from marquee.operators.skew import ROWS_PER_CHUNK, rank_within
from marquee.session import materialize

BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, written once, with a broadcast hint if it was found to be small."""
    df = materialize(df)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def watched_counts(bookings: DataFrame, shows: DataFrame) -> DataFrame:
    """How often each user holds a booked ticket of each movie."""
    booked = bookings.filter("status = 'BOOKED'").groupBy("user_id", "show_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        booked.join(shows.select("show_id", "movie_id"), "show_id").groupBy("user_id", "movie_id").agg(F.sum("n").alias("n"))
    )


def user_genre_vector(watched: DataFrame, movie_genre: DataFrame) -> DataFrame:
    """Genre counts per user; a movie booked twice counts twice."""
    return watched.join(movie_genre, "movie_id").groupBy("user_id", "genre").agg(F.sum("n").alias("weight"))


def movie_genre_vector(movie_genre: DataFrame) -> DataFrame:
    return movie_genre.select("movie_id", "genre").distinct().withColumn("weight", F.lit(1))


def unwatched(candidates: DataFrame, watched: DataFrame) -> DataFrame:
    return candidates.join(watched, ["user_id", "movie_id"], "left_anti")


def cosine(dot: Column, user_norm2: Column, movie_norm2: Column) -> Column:
    """Cosine from the dot product and the squared norms; 0 where a vector is empty."""
    usable = (user_norm2 > 0) & (movie_norm2 > 0)
    return F.when(usable, dot / (F.sqrt(user_norm2) * F.sqrt(movie_norm2))).otherwise(F.lit(0.0))


def cosines(pairs: DataFrame, user_vectors: DataFrame, movie_vectors: DataFrame) -> DataFrame:
    """Cosine of each given (user, movie) pair; 0 for those that share no genre."""
    square = F.col("weight") * F.col("weight")
    users = user_vectors.withColumn("_un", F.sum(square).over(Window.partitionBy("user_id")))
    movies = movie_vectors.withColumn("_mn", F.sum(square).over(Window.partitionBy("movie_id")))
    scores = (
        pairs.join(movies, "movie_id")
        .join(users.withColumnRenamed("weight", "_u"), ["user_id", "genre"])
        .groupBy("user_id", "movie_id", "_un", "_mn")
        .agg(F.sum(F.col("weight") * F.col("_u")).alias("_dot"))
        .select("user_id", "movie_id", cosine(F.col("_dot"), F.col("_un"), F.col("_mn")).alias("cosine"))
    )
    return pairs.join(scores, ["user_id", "movie_id"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))


def recommend(
    watched: DataFrame,
    movie_genre: DataFrame,
    n: int = V.RECOMMENDATIONS,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """For every user with a history the n best unwatched movies; ties by movie id.

    Movies that share no genre with the user score 0 and fill up what is missing.
    """
    watched = materialize(watched)
    genres_of = materialize(movie_genre.groupBy("movie_id").agg(F.sort_array(F.collect_set("genre")).alias("genres")))
    # A set of genres goes by the smallest movie id that has it.
    sets = materialize(
        genres_of.groupBy("genres").agg(F.min("movie_id").alias("set_id"), F.count(F.lit(1)).alias("movies"))
    )
    in_set = genres_of.join(sets, "genres").select("movie_id", "set_id")
    # One row per movie: its set, its place in that set and its place among all movies.
    by_id = [F.col("movie_id")]
    placed = rank_within(in_set, "set_id", F.col("movie_id"), by_id, "place", rows_per_chunk)
    placed = rank_within(placed.withColumn("_all", F.lit(0)), "_all", F.col("movie_id"), by_id, "overall", rows_per_chunk)
    placed = materialize(placed.drop("_all"))
    set_genres = small(sets.select("set_id", "movies", F.size("genres").alias("set_norm2"), F.explode("genres").alias("genre")))

    of_user = Window.partitionBy("user_id")
    # Every vector row meets dozens of sets: as many tasks as the session allows, not as few as the
    # vectors themselves would need.
    tasks = int(watched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    vectors = (
        user_genre_vector(watched, movie_genre)
        .repartition(tasks, "user_id")
        .withColumn("user_norm2", F.sum(F.col("weight") * F.col("weight")).over(of_user))
    )
    # Watched movies per set as one map per user: joining it on the user alone keeps
    # everything from the vectors to the choice of sets in one partitioning.
    seen_in_set = (
        watched.select("user_id", "movie_id")
        .join(placed.select("movie_id", "set_id"), "movie_id")
        .groupBy("user_id", "set_id")
        .agg(F.count(F.lit(1)).alias("seen"))
        .groupBy("user_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("set_id", "seen"))).alias("_seen"), F.sum("seen").alias("_watched"))
    )
    scored = (
        vectors.join(set_genres, "genre")
        .groupBy("user_id", "set_id", "user_norm2", "movies", "set_norm2")
        .agg(F.sum("weight").alias("dot"))
        .join(seen_in_set, "user_id")
        .withColumn("seen", F.coalesce(F.try_element_at("_seen", F.col("set_id")), F.lit(0)))
        .withColumn("score", cosine(F.col("dot"), F.col("user_norm2"), F.col("set_norm2")))
        .select("user_id", "set_id", "movies", "seen", "score")
    )
    # Every set that is left offers a movie, so a set with n better ones cannot contribute;
    # of the few that remain, only those count whose betters offer fewer than n movies.
    offers = F.col("movies") - F.col("seen")
    best_first = of_user.orderBy(F.desc("score"))
    useful = materialize(
        scored.filter(offers > 0)
        .withColumn("_rank", F.rank().over(best_first))
        .filter(F.col("_rank") <= n)
        .withColumn("_until", F.sum(offers).over(best_first.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("_tied", F.sum(offers).over(Window.partitionBy("user_id", "score")))
        .filter(F.col("_until") - F.col("_tied") < n)
    )
    expanded = useful.select(
        "user_id", "set_id", "score", F.explode(F.expr(f"sequence(1L, least({n} + seen, movies))")).alias("place")
    ).join(placed.select("set_id", "place", "movie_id"), ["set_id", "place"])
    best = expanded.select("user_id", "movie_id", "score")

    # Users short of n, all of whose sets are still here: the first movies by id outside them.
    offered = useful.groupBy("user_id").agg(F.sum(offers).alias("_offers"), F.sum("movies").alias("_movies"))
    totals = seen_in_set.select("user_id", "_watched").join(offered, "user_id", "left").fillna(0, ["_offers", "_movies"])
    reach = F.expr(f"sequence(1L, {n} - _offers + _movies + _watched)")
    fill = (
        totals.filter(F.col("_offers") < n)
        .select("user_id", F.explode(reach).alias("overall"))
        .join(placed.select("overall", "movie_id", "set_id"), "overall")
        .join(useful.select("user_id", "set_id"), ["user_id", "set_id"], "left_anti")
        .select("user_id", "movie_id", F.lit(0.0).alias("score"))
    )
    return (
        unwatched(best.unionByName(fill), watched)
        .withColumn("place", F.row_number().over(of_user.orderBy(F.desc("score"), "movie_id")))
        .filter(F.col("place") <= n)
    )


def recommend_cold(
    users: DataFrame, watched: DataFrame, movie_genre: DataFrame, movies: DataFrame, n: int = V.NEWEST_MOVIES
) -> DataFrame:
    """The newest movies for every user without a genre history."""
    known = watched.join(movie_genre.select("movie_id"), "movie_id", "left_semi").select("user_id")
    cold = users.select("user_id").join(known, "user_id", "left_anti")
    # At most n rows, so they can go to every task.
    latest = newest(movies, n).select(
        "movie_id",
        F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("created_at"), "movie_id")).alias("place"),
    )
    places = cold.withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(n))))
    return places.join(F.broadcast(latest), "place")
