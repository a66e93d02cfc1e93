from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators import anomaly as A
from marquee.plans.oracle import with_views
from marquee.plans.registry import plan
from marquee.plans.revenue import accepted
from marquee.sources.testdata import Views

FAST_SECONDS = 6 * 3600  # the given events of a user are hours apart
AS_OF = "2024-01-31"


def judged(v: Views) -> DataFrame:
    return A.with_history(accepted(v), fast_seconds=FAST_SECONDS, sizes=v.payment_events, source=v.table("events"))


def logs(v: Views) -> DataFrame:
    return A.anomaly_logs(judged(v))


_JUDGED = {
    "lagged": """SELECT *, lag(event_time, 2) OVER w AS second_before, lag(device_ip) OVER w AS ip_before,
                   CASE WHEN event_time - lag(event_time) OVER w >= INTERVAL 30 DAY THEN 1 ELSE 0 END AS expired
                 FROM accepted WINDOW w AS (PARTITION BY user_id ORDER BY event_time, event_id)""",
    "epochs": """SELECT *, sum(expired) OVER (PARTITION BY user_id ORDER BY event_time, event_id
                   ROWS UNBOUNDED PRECEDING) AS epoch FROM lagged""",
    "judged": """SELECT *, count(amount) OVER h AS history_n, avg(amount) OVER h AS mean,
                   stddev_pop(amount) OVER h AS sd,
                   coalesce(event_time - second_before <= INTERVAL 6 HOUR, false) AS is_fast,
                   coalesce(ip_before <> device_ip, false) AS is_device_change,
                   coalesce(upper(status) = 'FAILED' AND return_code = '0', false) AS is_failed_charged
                 FROM epochs WINDOW h AS (PARTITION BY user_id, epoch ORDER BY event_time, event_id
                   ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""",
    "logs": """SELECT event_id, payment_id, user_id, type, risk_score, description, amount,
                 event_time AS created_at, event_id || '-' || type AS log_id FROM (
                 SELECT *, 'MULTIPLE_FAST_TRANSACTION' AS type, 0.8::DOUBLE AS risk_score,
                   'Multiple fast transactions' AS description FROM judged WHERE is_fast
                 UNION ALL SELECT *, 'FAILED_BUT_CHARGED', 0.95, 'Failed but gateway return_code == 0' FROM judged
                   WHERE is_failed_charged
                 UNION ALL SELECT *, 'DEVICE_CHANGE', 0.6, 'Device/IP changed' FROM judged WHERE is_device_change
                 UNION ALL SELECT *, 'HIGH_AMOUNT', 0.9, 'High fixed threshold' FROM judged WHERE amount >= 1000000
                 UNION ALL SELECT *, 'AMOUNT_ZSCORE', 0.92, 'Z-score outlier' FROM judged
                   WHERE history_n >= 5 AND sd > 0 AND abs((amount - mean) / sd) > 3)""",
}


def _oracle(body: str) -> str:
    return with_views(body, "accepted", **_JUDGED)


@plan("anomaly_fast_tx", _oracle("SELECT event_id, user_id, event_time FROM judged WHERE is_fast"))
def _fast(v: Views) -> DataFrame:
    return judged(v).filter("is_fast").select("event_id", "user_id", "event_time")


@plan(
    "anomaly_device_change",
    _oracle("SELECT event_id, user_id, device_ip, event_time FROM judged WHERE is_device_change"),
)
def _device(v: Views) -> DataFrame:
    return judged(v).filter("is_device_change").select("event_id", "user_id", "device_ip", "event_time")


@plan(
    "anomaly_zscore",
    _oracle(
        "SELECT event_id, user_id, round(amount, 2) AS amount, history_n, round((amount - mean) / sd, 6) AS z "
        "FROM judged WHERE history_n >= 5 AND sd > 0 AND abs((amount - mean) / sd) > 3"
    ),
)
def _zscore(v: Views) -> DataFrame:
    return (
        judged(v)
        .filter(A.is_outlier())
        .select("event_id", "user_id", F.round("amount", 2).alias("amount"), "history_n", F.round("z", 6).alias("z"))
    )


@plan(
    "anomaly_failed_charged",
    with_views(
        "SELECT event_id, user_id, status, return_code FROM accepted WHERE upper(status) = 'FAILED' AND return_code = '0'",
        "accepted",
    ),
)
def _failed(v: Views) -> DataFrame:
    return accepted(v).filter(A.is_failed_but_charged()).select("event_id", "user_id", "status", "return_code")


@plan(
    "anomaly_high_amount",
    with_views(
        "SELECT event_id, user_id, round(amount, 2) AS amount FROM accepted WHERE amount >= 1000000", "accepted"
    ),
)
def _high(v: Views) -> DataFrame:
    return accepted(v).filter(A.is_high_amount()).select("event_id", "user_id", F.round("amount", 2).alias("amount"))


_LOG_COLUMNS = [
    "log_id",
    "payment_id",
    "user_id",
    "type",
    "risk_score",
    "description",
    "round(amount, 2) AS amount",
    "created_at",
]


@plan("anomalies", _oracle(f"SELECT {', '.join(_LOG_COLUMNS)} FROM logs"))
def _anomalies(v: Views) -> DataFrame:
    return logs(v).selectExpr(*_LOG_COLUMNS)


@plan("anomaly_by_type", _oracle("SELECT type, count(*) AS n FROM logs GROUP BY type"))
def _by_type(v: Views) -> DataFrame:
    return A.count_by_type(logs(v))


_SEVEN_DAYS = (
    "SELECT CAST(created_at AS DATE) AS date, count(*) AS n FROM logs "
    "WHERE created_at >= TIMESTAMP '2024-01-25 00:00:00' GROUP BY 1"
)


@plan("anomaly_by_date_7d", _oracle(_SEVEN_DAYS))
def _by_date(v: Views) -> DataFrame:
    return A.count_by_date(logs(v), AS_OF)


@plan(
    "anomaly_stats",
    _oracle(
        "SELECT (SELECT string_agg(CAST(date AS VARCHAR) || '=' || CAST(n AS VARCHAR), ',' ORDER BY date) "
        f"FROM ({_SEVEN_DAYS})) AS by_date, "
        "(SELECT string_agg(type || '=' || CAST(n AS VARCHAR), ',' ORDER BY type) "
        "FROM (SELECT type, count(*) AS n FROM logs GROUP BY type)) AS by_type"
    ),
)
def _stats(v: Views) -> DataFrame:
    return A.anomaly_stats(logs(v), AS_OF).select(
        F.expr("array_join(transform(by_date, e -> concat(cast(e.date AS string), '=', e.n)), ',')").alias("by_date"),
        F.expr("array_join(transform(array_sort(map_entries(by_type)), e -> concat(e.key, '=', e.value)), ',')").alias(
            "by_type"
        ),
    )


@plan(
    "anomaly_log_view",
    _oracle(
        "SELECT substr(log_id, 1, 8) || '...' AS short_id, type, coalesce(description, 'N/A') AS description, "
        "created_at, log_id FROM logs"
    ),
)
def _log_view(v: Views) -> DataFrame:
    return A.log_view(logs(v))


@plan(
    "recent_payments",
    with_views(
        "SELECT user_id, string_agg(CAST(CAST(round(amount) AS BIGINT) AS VARCHAR), ',' ORDER BY nth) AS amounts "
        "FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_time DESC, event_id DESC) AS nth "
        "FROM accepted) WHERE nth <= 20 GROUP BY user_id",
        "accepted",
    ),
)
def _recent(v: Views) -> DataFrame:
    return A.recent_payments(accepted(v)).select(
        "user_id",
        F.array_join(F.transform("amounts", lambda a: F.round(a).cast("long").cast("string")), ",").alias("amounts"),
    )
