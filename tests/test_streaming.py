"""Streams over files give what the batch operators give."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.operators import anomaly as A
from marquee.operators import payments as P
from marquee.operators import quality as Q
from marquee.operators import revenue as R
from marquee.plans.anomaly import FAST_SECONDS
from marquee.schemas import LOGIN_ATTEMPT, PAYMENT_EVENT
from marquee.sources.testdata import Views
from marquee.streaming import anomaly as SA
from marquee.streaming import sinks, source, windows

DAY = 86_400


@pytest.fixture(scope="module")
def events(spark, tiny):
    return Views(spark, tiny).payment_events.withColumn("event_time", F.col("event_time").cast("timestamp"))


@pytest.fixture(scope="module")
def event_folder(events, tmp_path_factory):
    """Events as files of rising time, read one per micro-batch."""
    return in_order(events, "event_time", str(tmp_path_factory.mktemp("events")))


def in_order(df, ts, folder):
    """Three files, written one after the other, of rising time."""
    bounds = ["2024-01-01", "2024-01-12", "2024-01-21", "2024-02-01"]
    for low, high in zip(bounds, bounds[1:]):
        df.filter((F.col(ts) >= low) & (F.col(ts) < high)).coalesce(1).write.mode("append").parquet(folder)
    return folder


def run(df, writer, tmp_path, mode="append"):
    query = sinks.start(df, writer, str(tmp_path / "state"), mode, available_now=True)
    query.awaitTermination(300)
    return query


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_exact_dedup_equals_batch(spark, events, event_folder, tmp_path):
    stream = windows.dedup_exact(source.event_files(spark, event_folder, files_per_trigger=1), DAY)
    out = str(tmp_path / "out")
    run(stream, sinks.append_once(out), tmp_path)
    assert rows(spark.read.parquet(out), "event_id") == rows(R.dedup_events(events, DAY), "event_id")


def test_dedup_and_hourly_revenue_upsert(spark, events, event_folder, tmp_path):
    out = str(tmp_path / "revenue")
    schema = "date date, hour int, revenue double"
    stream = source.with_metrics(source.event_files(spark, event_folder, files_per_trigger=1))
    deduped = windows.dedup_within_watermark(stream, "365 days")
    run(windows.hourly_revenue(deduped), sinks.upsert_by_date(spark, out, ["date", "hour"], schema), tmp_path, "update")
    stored = spark.read.schema(schema).parquet(out).withColumn("revenue", F.round("revenue", 2))
    first = R.dedup_events(events, 365 * DAY)
    expected = R.hourly_revenue(first).withColumn("revenue", F.round("revenue", 2))
    assert rows(stored, "date", "hour", "revenue") == rows(expected, "date", "hour", "revenue")


def test_movie_counts_upsert(spark, events, event_folder, tmp_path):
    out = str(tmp_path / "counts")
    schema = "date date, movie_id string, n long"
    stream = source.event_files(spark, event_folder, files_per_trigger=1).withWatermark("event_time", "1 day")
    run(windows.movie_daily_counts(stream), sinks.upsert_by_date(spark, out, ["date", "movie_id"], schema), tmp_path, "update")
    stored = spark.read.schema(schema).parquet(out)
    assert rows(stored, "date", "movie_id", "n") == rows(R.movie_daily_counts(events), "date", "movie_id", "n")


def test_anomalies_equal_batch(spark, events, event_folder, tmp_path):
    out = str(tmp_path / "logs")
    published = []
    stream = SA.detect(source.event_files(spark, event_folder, files_per_trigger=1), fast_seconds=FAST_SECONDS)
    writer = sinks.append_once(out, lambda batch, batch_id: published.append(batch.count()))
    run(stream, writer, tmp_path)
    expected = A.anomaly_logs(A.with_history(events, fast_seconds=FAST_SECONDS))
    stored = spark.read.parquet(out)
    assert rows(stored, "log_id", "risk_score") == rows(expected, "log_id", "risk_score")
    assert sum(published) == stored.count() > 0


def test_dedup_then_anomalies_in_one_query(spark, events, event_folder, tmp_path):
    out = str(tmp_path / "logs")
    deduped = windows.dedup_exact(source.event_files(spark, event_folder, files_per_trigger=1), DAY)
    run(SA.detect(deduped, fast_seconds=FAST_SECONDS, lateness=None), sinks.append_once(out), tmp_path)
    expected = A.anomaly_logs(A.with_history(R.dedup_events(events, DAY), fast_seconds=FAST_SECONDS))
    assert rows(spark.read.parquet(out), "log_id") == rows(expected, "log_id")


def test_login_throttle_equals_batch(spark, tiny, tmp_path):
    attempts = Views(spark, tiny).login_attempts.withColumn("ts", F.col("ts").cast("timestamp"))
    folder, out = in_order(attempts, "ts", str(tmp_path / "in")), str(tmp_path / "out")
    stream = windows.login_throttle(source.event_files(spark, folder, LOGIN_ATTEMPT, 1), 2, DAY)
    run(stream, sinks.append_once(out), tmp_path)
    columns = ("attempt_id", "attempt_no", "rejected")
    assert rows(spark.read.parquet(out), *columns) == rows(Q.login_throttle(attempts, 2, DAY), *columns)


def test_feed_stream_with_dead_letters(spark, tiny, tmp_path):
    v = Views(spark, tiny)
    feed = P.event_feed(v.payments, v.bookings, v.shows)
    broken = feed.withColumn("value", F.when(F.crc32("value") % 5 == 0, F.lit('{"paymentId": 1')).otherwise(F.col("value")))
    folder = str(tmp_path / "in")
    broken.withColumn("event_id", F.md5("value")).write.parquet(folder)
    stream = source.event_files(spark, folder, "event_id string, key string, value string")
    events, rejects = source.feed_events(stream)
    run(events, sinks.append_once(str(tmp_path / "ok")), tmp_path / "a")
    run(rejects, sinks.append_once(str(tmp_path / "dead")), tmp_path / "b")
    ok, dead = spark.read.parquet(str(tmp_path / "ok")), spark.read.parquet(str(tmp_path / "dead"))
    assert dead.count() > 0 and ok.count() + dead.count() == feed.count()
    assert {r.reason for r in dead.collect()} == {"not readable"}
    assert ok.filter("event_time IS NULL OR payment_id IS NULL").count() == 0


def test_sinks_survive_a_replayed_batch(spark, tmp_path):
    schema = "date date, hour int, revenue double"
    path = str(tmp_path / "table")
    write = sinks.upsert_by_date(spark, path, ["date", "hour"], schema)
    day = "to_date('2024-01-01')"
    one = spark.sql(f"SELECT {day} AS date, 1 AS hour, 5D AS revenue UNION ALL SELECT date_add({day}, 1), 2, 7D")
    two = spark.sql(f"SELECT {day} AS date, 1 AS hour, 6D AS revenue UNION ALL SELECT {day}, 3, 1D")
    for batch_id, batch in [(0, one), (1, two), (1, two)]:
        write(batch, batch_id)
    stored = spark.read.schema(schema).parquet(path)
    assert sorted((r.hour, r.revenue) for r in stored.collect()) == [(1, 6.0), (2, 7.0), (3, 1.0)]
    once = sinks.append_once(str(tmp_path / "log"))
    once(one, 0)
    once(one, 0)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_upsert_opens_only_the_dates_of_the_batch(spark, tmp_path):
    schema = "date date, hour int, revenue double"
    path = tmp_path / "table"
    write = sinks.upsert_by_date(spark, str(path), ["date", "hour"], schema)
    (path / "date=2020-01-01").mkdir()
    (path / "date=2020-01-01" / "part-0.parquet").write_bytes(b"not to be read")
    one = spark.sql("SELECT to_date('2024-01-01') AS date, 1 AS hour, 5D AS revenue")
    for batch_id, batch in enumerate([one, one.limit(0), one.withColumn("hour", F.lit(2))]):
        write(batch, batch_id)
    stored = spark.read.schema(schema).parquet(str(path / "date=2024-01-01"))
    assert sorted((r.hour, r.revenue) for r in stored.drop("date").collect()) == [(1, 5.0), (2, 5.0)]


def test_missing_address_and_amount_across_batches(spark, tmp_path):
    """A null address or amount has the effect it has in batch, wherever a micro-batch ends."""
    from datetime import datetime, timedelta

    addresses = ["A", None, "B", "B", None, "A", "C", "C", "A", "A", None, "B", "B", "B", "C"]
    given = [
        {
            "event_id": f"e{i:02}", "payment_id": f"p{i}", "user_id": "u", "device_ip": ip,
            "event_time": datetime(2024, 1, 1) + timedelta(days=2 * i), "amount": None if i % 5 == 3 else 10.0 + i % 3,
        }
        for i, ip in enumerate(addresses)
    ]
    schema = T.StructType.fromDDL(PAYMENT_EVENT)
    events = spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in given], schema)
    folder, out = in_order(events, "event_time", str(tmp_path / "in")), str(tmp_path / "out")
    run(SA.with_history(source.event_files(spark, folder, files_per_trigger=1)), sinks.append_once(out), tmp_path)
    columns = ("event_id", "is_device_change", "history_n", F.round("z", 9))
    assert rows(spark.read.parquet(out), *columns) == rows(A.with_history(events), *columns)


def test_address_is_forgotten_after_its_days(spark, tmp_path):
    """With `address_days` a user who was away that long has no address to differ from; without, the change counts."""
    given = [("a", "u", 0, "A"), ("b", "u", 50, "B"), ("c", "u", 60, "A"), ("d", "v", 0, "A"), ("e", "v", 100, "B"), ("z", "w", 400, "A")]
    schema = T.StructType.fromDDL(PAYMENT_EVENT)
    made = [
        {"event_id": e, "payment_id": e, "user_id": u, "device_ip": ip, "event_time": datetime(2024, 1, 1) + timedelta(days=d), "amount": 1.0}
        for e, u, d, ip in given
    ]
    events = spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in made], schema)
    folder = str(tmp_path / "in")
    for low, high in ((0, 55), (55, 90), (90, 500)):
        part = events.filter((F.datediff("event_time", F.lit("2024-01-01")) >= low) & (F.datediff("event_time", F.lit("2024-01-01")) < high))
        part.coalesce(1).write.mode("append").parquet(folder)
    for days, want in ((None, {"b", "c", "e"}), (70, {"b", "c"}), (20, {"c"})):
        out = str(tmp_path / f"out{days}")
        stream = SA.with_history(source.event_files(spark, folder, files_per_trigger=1), address_days=days)
        run(stream, sinks.append_once(out), tmp_path / f"state{days}")
        assert {r.event_id for r in spark.read.parquet(out).filter("is_device_change").collect()} == want, days
