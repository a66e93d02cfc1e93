"""Events that come too late for a stream, events that cannot be told apart, and how long events take to arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee import fixed_values as V
from marquee.functions.business import event_date, event_hour
from marquee.operators.revenue import dedup_events, hourly_revenue
from marquee.operators.skew import micros
from marquee.session import materialize

LATENESS_SECONDS = 86_400
WITHOUT_KEY, WITHOUT_TIME = "missing paymentId", "missing time"


def reject_reason(key: str = "payment_id", ts: str = "event_time") -> Column:
    """Why an event can take no part in windows; null if it can."""
    return F.when(F.col(key).isNull(), F.lit(WITHOUT_KEY)).when(F.col(ts).isNull(), F.lit(WITHOUT_TIME))


def split_rejects(events: DataFrame, key: str = "payment_id", ts: str = "event_time") -> tuple[DataFrame, DataFrame]:
    """(events with key and time, rejects with their `reason`): every event is in one of them."""
    judged = events.withColumn("reason", reject_reason(key, ts))
    return judged.filter("reason IS NULL").drop("reason"), judged.filter("reason IS NOT NULL")


def split_late(arrivals: DataFrame, lateness_seconds: int = LATENESS_SECONDS, ts: str = "event_time") -> tuple[DataFrame, DataFrame]:
    """(on time, late) of events with `arrived_at`: late ones arrive more than the lateness after they happened."""
    delay = micros("arrived_at") - micros(ts)
    late = F.coalesce(delay > lateness_seconds * 1_000_000, F.lit(False))
    return arrivals.filter(~late), arrivals.filter(late)


def disordered(arrived: DataFrame, key: str = "payment_id", ts: str = "event_time", batch: str = "batch_id") -> DataFrame:
    """(key, since): keys with an event older than one of an earlier batch, and the oldest of these events.

    Both sides come down to a row per key and batch before they are compared.
    """
    spans = arrived.groupBy(key, batch).agg(F.min(ts).alias("_low"), F.max(ts).alias("_high"))
    earlier = Window.partitionBy(key).orderBy(batch).rowsBetween(Window.unboundedPreceding, -1)
    return (
        spans.withColumn("_seen", F.max("_high").over(earlier))
        .filter(F.col("_low") < F.col("_seen"))
        .groupBy(key)
        .agg(F.min("_low").alias("since"))
    )


def corrections(
    accepted: DataFrame,
    on_time: DataFrame,
    late: DataFrame,
    ttl_seconds: int = V.DEDUP_SECONDS,
    moved: DataFrame | None = None,
    **chunking,
) -> DataFrame:
    """What late events change in the de-duplicated ones: events with `change` 1 (now accepted) or -1 (no longer).

    `accepted` is what a stream made of `on_time`; with the corrections it is what `dedup_events` makes of all events at
    once. Only payments with a late event are looked at again (and those of `moved`, see `disordered`), and of these only
    events from their first late one on: an earlier event was judged without it, and the window it may have opened is
    carried over by the last event accepted before. Corrections are made from all late events so far, so the table of
    them is replaced as a whole and running it again changes nothing.
    """
    touched = late.groupBy("payment_id").agg(F.min("event_time").alias("since"))
    if moved is not None:
        touched = touched.unionByName(moved.select("payment_id", "since")).groupBy("payment_id").agg(F.min("since").alias("since"))
    touched = materialize(touched)  # a row per payment with a late event; four places read it
    ttl = F.expr(f"make_dt_interval(0, 0, 0, {int(ttl_seconds)})")
    # a literal, so that files and partitions before it are not read
    first = touched.agg(F.min(F.col("since") - ttl)).first()[0]

    def again(events: DataFrame) -> DataFrame:
        return events.filter(F.col("event_time") >= F.lit(first)).join(touched, "payment_id")

    columns = accepted.columns
    before = again(accepted)
    opener = (
        before.filter((F.col("event_time") < F.col("since")) & (F.col("event_time") >= F.col("since") - ttl))
        .groupBy("payment_id")
        .agg(F.max_by(F.struct(*columns, "since"), F.struct("event_time", "event_id")).alias("_e"))
        .select("_e.*")
    )
    events = on_time.select(columns).unionByName(late.select(columns))
    judged = again(events).filter(F.col("event_time") >= F.col("since")).unionByName(opener)
    exact = dedup_events(judged, ttl_seconds, **chunking).filter(F.col("event_time") >= F.col("since")).select(columns)
    known = before.filter(F.col("event_time") >= F.col("since")).select(columns)
    return (
        exact.join(known.select("event_id"), "event_id", "left_anti")
        .withColumn("change", F.lit(1))
        .unionByName(known.join(exact.select("event_id"), "event_id", "left_anti").withColumn("change", F.lit(-1)))
    )


def corrected(accepted: DataFrame, changes: DataFrame) -> DataFrame:
    """The accepted events after their corrections."""
    gone = changes.filter("change = -1").select("event_id")
    return accepted.join(gone, "event_id", "left_anti").unionByName(changes.filter("change = 1").drop("change"))


def corrected_revenue(hourly: DataFrame, accepted: DataFrame, changes: DataFrame, zone: str | None = None) -> DataFrame:
    """Stored revenue by hour after corrections: only hours that a correction falls into are added up again."""
    when, changes = F.col("event_time"), materialize(changes)
    hours = changes.select(event_date(when, zone).alias("date"), event_hour(when, zone).alias("hour")).distinct()
    rows = accepted.withColumns({"date": event_date(when, zone), "hour": event_hour(when, zone)})
    again = corrected(rows.join(hours, ["date", "hour"], "left_semi").drop("date", "hour"), changes)
    return hourly.join(hours, ["date", "hour"], "left_anti").unionByName(hourly_revenue(again, zone))


def latency_sketches(arrivals: DataFrame, k: int = 400, ts: str = "event_time") -> DataFrame:
    """Per date and hour of the event: how many arrived, and a sketch of how many milliseconds they took.

    Sketches of parts are merged (see `latency_quantiles`), so a stream may add one per batch; each is a few kilobytes
    at any number of events, and a quantile is off by less than 1 % in rank.
    """
    took = ((micros("arrived_at") - micros(ts)) / 1000).cast("double")
    return (
        arrivals.filter(took.isNotNull())
        .groupBy(F.to_date(ts).alias("date"), F.hour(ts).alias("hour"))
        .agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(took, F.lit(k)).alias("sketch"), F.max(took).alias("slowest"))
    )


def latency_quantiles(sketches: DataFrame, shares: list[float], by: list[str]) -> DataFrame:
    """Latency by `by` (any of date and hour) at each of `shares`, from sketches merged over the rest."""
    merged = sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"), F.max("slowest").alias("slowest")
    )
    each = [F.struct(F.lit(s).alias("share"), F.kll_sketch_get_quantile_double("sketch", F.lit(s)).alias("latency_ms")) for s in shares]
    return merged.select(*by, "n", "slowest", F.inline(F.array(*each)))
