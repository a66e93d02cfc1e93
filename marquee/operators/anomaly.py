"""Payment anomalies: five rules, their log, and statistics over the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee import fixed_values as V
from marquee.operators.skew import ROWS_PER_CHUNK, apart, hot_keys, micros, with_lookback
from marquee.session import materialize

ORDER = ["event_time", "event_id"]


def with_history(
    events: DataFrame,
    fast_seconds: int = V.FAST_SECONDS,
    fast_count: int = V.FAST_COUNT,
    sizes: DataFrame | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
    source: DataFrame | None = None,
) -> DataFrame:
    """Events with what the rules need from the same user's earlier events.

    One shuffle by user serves all rules.  Every rule looks back a fixed number
    of rows, so users too large for one task are cut into chunks that see the
    rows before them.  An event without user has no history; it gets a key of
    its own instead of meeting all others like it in one partition.  `sizes`
    may name a cheaper table that holds at least the same rows per user, `source`
    the stored table behind it (see `hot_keys`).
    """
    own_key = F.coalesce(F.concat(F.lit("u"), "user_id"), F.concat(F.lit("e"), "event_id"))
    events = events.withColumn("_who", own_key)
    sizes = events if sizes is None else sizes.withColumn("_who", own_key)
    hot = hot_keys(sizes, "_who", micros("event_time"), rows_per_chunk, source)
    if hot is None:
        return _judged(events, ["_who"], fast_seconds, fast_count)
    plain, large = apart(events, "_who", hot)
    reach = max(V.HISTORY_LENGTH, fast_count - 1)
    cut = with_lookback(materialize(large), "_who", micros("event_time"), ORDER, reach, hot)
    cut = _judged(cut, ["_who", "_chunk"], fast_seconds, fast_count).filter("NOT _halo").drop("_chunk", "_is_hot", "_halo")
    return _judged(plain, ["_who"], fast_seconds, fast_count).unionByName(cut)


def _judged(events: DataFrame, by: list[str], fast_seconds: int, fast_count: int) -> DataFrame:
    seen = Window.partitionBy(*by).orderBy(*ORDER)
    gap = micros("event_time") - F.lag(micros("event_time")).over(seen)
    expired = gap >= V.HISTORY_DAYS * 86_400_000_000
    recent = micros("event_time") - F.lag(micros("event_time"), fast_count - 1).over(seen)
    history = Window.partitionBy(*by, "_epoch").orderBy(*ORDER).rowsBetween(-V.HISTORY_LENGTH, -1)
    known = F.col("user_id").isNotNull()
    rows = (
        events.withColumn("is_fast", known & F.coalesce(recent <= fast_seconds * 1_000_000, F.lit(False)))
        .withColumn(
            "is_device_change", known & F.coalesce(F.lag("device_ip").over(seen) != F.col("device_ip"), F.lit(False))
        )
        .withColumn("_expired", F.coalesce(expired, F.lit(False)).cast("int"))
        .withColumn("_epoch", F.sum("_expired").over(seen.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("history_n", F.count("amount").over(history))
        .withColumn("history_mean", F.avg("amount").over(history))
        .withColumn("history_sd", F.stddev_pop("amount").over(history))
    )
    z = F.when(
        (F.col("history_n") >= V.HISTORY_MINIMUM) & (F.col("history_sd") > 0),
        (F.col("amount") - F.col("history_mean")) / F.col("history_sd"),
    )
    return rows.withColumn("z", z).drop("_who", "_expired", "_epoch")


def is_failed_but_charged() -> Column:
    return F.coalesce((F.upper("status") == "FAILED") & (F.col("return_code") == "0"), F.lit(False))


def is_high_amount(threshold: float = V.HIGH_AMOUNT) -> Column:
    return F.col("amount") >= threshold


def is_outlier(limit: float = V.Z_LIMIT) -> Column:
    return F.coalesce(F.abs("z") > limit, F.lit(False))


def anomaly_logs(judged: DataFrame, high_amount: float = V.HIGH_AMOUNT) -> DataFrame:
    """One row per event and rule that fired, in one pass over events with history."""
    fired = [
        (F.col("is_fast"), V.ANOMALY_FAST),
        (is_failed_but_charged(), V.ANOMALY_FAILED_CHARGED),
        (F.col("is_device_change"), V.ANOMALY_DEVICE),
        (is_high_amount(high_amount), V.ANOMALY_HIGH_AMOUNT),
        (is_outlier(), V.ANOMALY_ZSCORE),
    ]
    entries = [
        F.when(rule, F.struct(F.lit(kind).alias("type"), F.lit(score).alias("risk_score"), F.lit(text).alias("description")))
        for rule, (kind, score, text) in fired
    ]
    return (
        judged.withColumn("_log", F.explode(F.array_compact(F.array(*entries))))
        .select("event_id", "payment_id", "user_id", "_log.*", "amount", F.col("event_time").alias("created_at"))
        .withColumn("log_id", F.concat_ws("-", "event_id", "type"))
    )


def recent_payments(events: DataFrame, n: int = V.HISTORY_LENGTH) -> DataFrame:
    """The last n amounts of every user, newest first."""
    newest = Window.partitionBy("user_id").orderBy(*[F.desc(c) for c in ORDER])
    return (
        events.filter(F.col("user_id").isNotNull())
        .withColumn("_nth", F.row_number().over(newest))
        .filter(F.col("_nth") <= n)
        .groupBy("user_id")
        .agg(F.sort_array(F.collect_list(F.struct("_nth", "amount"))).alias("_l"))
        .select("user_id", F.transform("_l", lambda e: e["amount"]).alias("amounts"))
    )


def count_by_type(logs: DataFrame) -> DataFrame:
    return logs.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def count_by_date(logs: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Logs per date over the `days` days that end with `as_of`."""
    first = F.date_sub(F.lit(as_of).cast("date"), days - 1)
    return (
        logs.filter(F.col("created_at") >= first.cast("timestamp_ntz"))
        .groupBy(F.to_date("created_at").alias("date"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def anomaly_stats(logs: DataFrame, as_of: str) -> DataFrame:
    """One row: counts by date as a list, counts by type as a map."""
    counts = logs.groupBy("type", F.to_date("created_at").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    first = F.date_sub(F.lit(as_of).cast("date"), 6)
    by_date = counts.filter(F.col("date") >= first).groupBy("date").agg(F.sum("n").alias("n"))
    by_type = counts.groupBy("type").agg(F.sum("n").alias("n"))
    both = by_date.withColumn("type", F.lit(None).cast("string")).unionByName(by_type, allowMissingColumns=True)
    return both.agg(
        F.sort_array(F.collect_list(F.when(F.col("type").isNull(), F.struct("date", "n")))).alias("by_date"),
        F.map_from_entries(F.collect_list(F.when(F.col("type").isNotNull(), F.struct("type", "n")))).alias("by_type"),
    )


def log_view(logs: DataFrame) -> DataFrame:
    """The log as the list shows it, newest first."""
    return logs.select(
        F.concat(F.substring("log_id", 1, 8), F.lit("...")).alias("short_id"),
        "type",
        F.coalesce("description", F.lit("N/A")).alias("description"),
        "created_at",
        "log_id",
    ).orderBy(F.desc("created_at"), F.desc("log_id"))
