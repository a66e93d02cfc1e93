"""De-duplicated payment events, revenue by hour and day, and the day's top movies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee import fixed_values as V
from marquee.functions.business import event_date, event_hour
from marquee.operators.anchored import anchored_windows


def dedup_events(events: DataFrame, ttl_seconds: int = V.DEDUP_SECONDS, **chunking) -> DataFrame:
    """Events whose payment was not accepted in the last `ttl_seconds`.

    Repeats do not extend that time, so a repeat at or after it counts again.
    """
    placed = anchored_windows(events, "payment_id", "event_time", "event_id", ttl_seconds * 1_000_000, "_nth", **chunking)
    return placed.filter("_nth = 1").drop("_nth")


def hourly_revenue(events: DataFrame, zone: str | None = None, paid_only: bool = False) -> DataFrame:
    """Amounts by date and hour of the event, whatever its status unless `paid_only`."""
    counted = events.filter("status = 'PAID'") if paid_only else events
    when = F.col("event_time")
    return counted.groupBy(event_date(when, zone).alias("date"), event_hour(when, zone).alias("hour")).agg(
        F.sum("amount").alias("revenue")
    )


def revenue_at(hourly: DataFrame, asked: DataFrame) -> DataFrame:
    """Revenue of each asked (date, hour); null where there was none."""
    return asked.join(hourly, ["date", "hour"], "left")


def daily_revenue(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("date").agg(F.sum("revenue").alias("revenue"), F.count(F.lit(1)).alias("hours"))


def revenue_of_day_before(hourly: DataFrame, as_of: str) -> DataFrame:
    """The nightly job: the total of the day before `as_of`."""
    return daily_revenue(hourly.filter(F.col("date") == F.date_sub(F.lit(as_of).cast("date"), 1)))


def movie_daily_counts(events: DataFrame, zone: str | None = None) -> DataFrame:
    return events.groupBy(event_date(F.col("event_time"), zone).alias("date"), "movie_id").agg(
        F.count(F.lit(1)).alias("n")
    )


def top_movies(daily_counts: DataFrame, n: int = V.TOP_MOVIES_PER_DAY) -> DataFrame:
    """The n most counted movies of every date; ties by id, descending as text."""
    best = Window.partitionBy("date").orderBy(F.desc("n"), F.desc("movie_id"))
    return daily_counts.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= n)


def event_metrics(placed: DataFrame) -> DataFrame:
    """Received, processed and repeated events by status, from placed events (`_nth`)."""
    return placed.groupBy("status").agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if(F.col("_nth") == 1).alias("processed"),
        F.count_if(F.col("_nth") > 1).alias("repeated"),
        F.max("event_time").alias("latest_event"),
    )
