from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators import late as L
from marquee.operators import revenue as R
from marquee.operators.anchored import anchored_windows
from marquee.plans.oracle import with_views
from marquee.plans.registry import plan
from marquee.session import materialize
from marquee.sources.testdata import Views

DAY = 86_400  # repeats in the given events are days apart


def accepted(v: Views) -> DataFrame:
    return R.dedup_events(v.payment_events, DAY, source=v.table("events"))


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("revenue", F.round("revenue", 2))


@plan(
    "dedup_events",
    with_views("SELECT event_id, payment_id, user_id, movie_id, event_time, status FROM accepted", "accepted"),
)
def _dedup(v: Views) -> DataFrame:
    return accepted(v).select("event_id", "payment_id", "user_id", "movie_id", "event_time", "status")


_HOURLY = (
    "SELECT CAST(event_time AS DATE) AS date, CAST(hour(event_time) AS INTEGER) AS hour, "
    "round(sum(amount), 2) AS revenue FROM accepted GROUP BY 1, 2"
)


@plan("hourly_revenue", with_views(_HOURLY, "accepted"))
def _hourly(v: Views) -> DataFrame:
    return rounded(R.hourly_revenue(accepted(v)))


@plan("paid_revenue", with_views(_HOURLY.replace("FROM accepted", "FROM accepted WHERE status = 'PAID'"), "accepted"))
def _paid(v: Views) -> DataFrame:
    return rounded(R.hourly_revenue(accepted(v), paid_only=True))


@plan(
    "revenue_at",
    with_views(
        "SELECT a.date, a.hour, h.revenue FROM asked a LEFT JOIN hourly h ON h.date = a.date AND h.hour = a.hour",
        "accepted",
        hourly=_HOURLY,
        asked="SELECT date, CAST(unnest(range(24)) AS INTEGER) AS hour "
        "FROM (SELECT DISTINCT CAST(event_time AS DATE) AS date FROM payment_events)",
    ),
)
def _revenue_at(v: Views) -> DataFrame:
    dates = v.payment_events.select(F.to_date("event_time").alias("date")).distinct()
    asked = dates.select("date", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    return rounded(R.revenue_at(R.hourly_revenue(accepted(v)), asked))


@plan(
    "daily_revenue",
    with_views(
        "SELECT CAST(event_time AS DATE) AS date, round(sum(amount), 2) AS revenue, "
        "count(DISTINCT hour(event_time)) AS hours FROM accepted GROUP BY 1",
        "accepted",
    ),
)
def _daily(v: Views) -> DataFrame:
    return rounded(R.daily_revenue(R.hourly_revenue(accepted(v))))


@plan(
    "movie_daily_counts",
    with_views(
        "SELECT CAST(event_time AS DATE) AS date, movie_id, count(*) AS n FROM accepted GROUP BY 1, 2", "accepted"
    ),
)
def _movie_counts(v: Views) -> DataFrame:
    return R.movie_daily_counts(accepted(v))


@plan(
    "top_movies",
    with_views(
        "SELECT * FROM (SELECT date, movie_id, n, CAST(row_number() OVER (PARTITION BY date "
        "ORDER BY n DESC, movie_id DESC) AS INTEGER) AS place FROM counts) WHERE place <= 5",
        "accepted",
        counts="SELECT CAST(event_time AS DATE) AS date, movie_id, count(*) AS n FROM accepted GROUP BY 1, 2",
    ),
)
def _top_movies(v: Views) -> DataFrame:
    return R.top_movies(R.movie_daily_counts(accepted(v)))


@plan(
    "event_metrics",
    with_views(
        "SELECT p.status, count(*) AS received, count(a.event_id) AS processed, "
        "count(*) - count(a.event_id) AS repeated, max(p.event_time) AS latest_event "
        "FROM payment_events p LEFT JOIN accepted a ON a.event_id = p.event_id GROUP BY p.status",
        "accepted",
    ),
)
def _metrics(v: Views) -> DataFrame:
    placed = anchored_windows(v.payment_events, "payment_id", "event_time", "event_id", DAY * 1_000_000, "_nth", source=v.table("events"))
    return R.event_metrics(placed)


@plan(
    "event_rejects",
    with_views("SELECT event_id, user_id, amount, 'missing paymentId' AS reason FROM arrivals WHERE payment_id IS NULL", "arrivals"),
)
def _rejects(v: Views) -> DataFrame:
    return L.split_rejects(v.arrivals)[1].select("event_id", "user_id", "amount", "reason")


def _late(v: Views) -> tuple[DataFrame, DataFrame]:
    """(events a stream accepts of those on time, what the late ones change)."""
    on_time, late = L.split_late(L.split_rejects(v.arrivals)[0])
    taken = materialize(R.dedup_events(on_time, DAY, source=v.table("events")))  # what the stream has stored
    return taken, L.corrections(taken, on_time, late, DAY, source=v.table("events"))


@plan(
    "late_corrections",
    with_views(
        "SELECT event_id, payment_id, event_time, CAST(1 AS INTEGER) AS change FROM keyed_accepted "
        "WHERE event_id NOT IN (SELECT event_id FROM on_time_accepted) UNION ALL "
        "SELECT event_id, payment_id, event_time, -1 FROM on_time_accepted "
        "WHERE event_id NOT IN (SELECT event_id FROM keyed_accepted)",
        "keyed_accepted",
        "on_time_accepted",
    ),
)
def _late_corrections(v: Views) -> DataFrame:
    return _late(v)[1].select("event_id", "payment_id", "event_time", "change")


@plan(
    "corrected_revenue",
    with_views(_HOURLY.replace("FROM accepted", "FROM keyed_accepted"), "keyed_accepted"),
)
def _corrected_revenue(v: Views) -> DataFrame:
    taken, changes = _late(v)
    return rounded(L.corrected_revenue(R.hourly_revenue(taken), taken, changes))


@plan(
    "event_latency",
    with_views(
        "SELECT date, hour, share, len(l) AS n, l[CAST(ceil(share * len(l)) AS BIGINT)] AS latency_ms, l[-1] AS slowest FROM ("
        "SELECT CAST(event_time AS DATE) AS date, CAST(hour(event_time) AS INTEGER) AS hour, "
        "list_sort(list(CAST(epoch_us(arrived_at) - epoch_us(event_time) AS DOUBLE) / 1000)) AS l FROM arrivals GROUP BY ALL), "
        "(SELECT unnest([0.5, 0.9, 0.99])::DOUBLE AS share)",
        "arrivals",
    ),
)
def _latency(v: Views) -> DataFrame:
    return L.latency_quantiles(L.latency_sketches(v.arrivals), [0.5, 0.9, 0.99], ["date", "hour"])
