"""Late and keyless events: nothing vanishes, and stored revenue ends as if all had come in order."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.operators import late as L
from marquee.operators import revenue as R
from marquee.schemas import PAYMENT_EVENT
from marquee.streaming import late, sinks, source, windows

START = datetime(2024, 3, 1)


def events(spark, given):
    """Events (id, payment, hours after the start or None, amount)."""
    schema = T.StructType.fromDDL(PAYMENT_EVENT)
    made = [
        {"event_id": i, "payment_id": p, "event_time": None if h is None else START + timedelta(hours=h), "amount": float(a)}
        for i, p, h, a in given
    ]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in made], schema)


def streamed(spark, tmp_path, batches):
    """(accepted by the stream, on time, late, rejects) of batches that arrive one after the other."""
    folder, source_folder = str(tmp_path / "split"), str(tmp_path / "in")
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(source_folder)
    writer = late.split_arrivals(spark, folder)
    stream = source.event_files(spark, source_folder, files_per_trigger=1)
    sinks.start(stream, writer, str(tmp_path / "a"), available_now=True).awaitTermination(300)
    accepted = str(tmp_path / "accepted")
    deduped = windows.dedup_exact(late.on_time(spark, folder, files_per_trigger=1))
    sinks.start(deduped, sinks.append_once(accepted), str(tmp_path / "b"), available_now=True).awaitTermination(300)
    kinds = (late.arrived(spark, folder, k) for k in (late.ON_TIME, late.LATE, late.REJECT))
    return spark.read.schema(PAYMENT_EVENT).parquet(accepted), *kinds


def revenue(df):
    return sorted((str(r.date), r.hour, round(r.revenue, 6)) for r in df.collect())


def settled(taken, on_time, late_rows):
    changes = L.corrections(taken, on_time, late_rows, moved=L.disordered(on_time))
    return changes, L.corrected_revenue(R.hourly_revenue(taken), taken, changes)


def test_two_at_ten_and_one_before_that_comes_two_days_later(spark, tmp_path):
    first = events(spark, [("a", "p", 10, 5), ("b", "p", 10, 5), ("k", None, 10, 100), ("t", "q", None, 7)])
    others = events(spark, [("c", "q", 58.5, 1)])
    last = events(spark, [("d", "p", 6 + 1 / 6, 5), ("e", "p", 9.5, 3)])
    taken, on_time, late_rows, rejects = streamed(spark, tmp_path, [first, others, last])
    assert {r.event_id for r in late_rows.collect()} == {"d", "e"}
    assert {(r.event_id, r.reason) for r in rejects.collect()} == {("k", "missing paymentId"), ("t", "missing time")}
    changes, got = settled(taken, on_time, late_rows)
    assert {(r.event_id, r.change) for r in changes.collect()} == {("d", 1), ("e", 1), ("a", -1)}
    everything = on_time.unionByName(late_rows).drop("reason", "batch_id", "kind")
    assert revenue(got) == revenue(R.hourly_revenue(R.dedup_events(everything)))
    assert [(h, x) for _, h, x in revenue(got)] == [(6, 5.0), (9, 3.0), (10, 1.0)]  # 10 o'clock is that of q, two days on
    again = L.corrections(taken, on_time, late_rows, moved=L.disordered(on_time))
    assert sorted(changes.collect()) == sorted(again.collect())


def test_any_order_of_arrival_ends_in_the_answer_of_the_batch(spark, tmp_path):
    random.seed(8)
    made = [(f"e{i:03}", f"p{random.randrange(6)}", random.randrange(0, 4 * 96) / 4, random.randrange(1, 50)) for i in range(240)]
    shuffled = sorted(made, key=lambda e: e[2] + random.choice([0, 0, 0, 0.5, 3, 20, 40, 70]))
    taken, on_time, late_rows, rejects = streamed(spark, tmp_path, [events(spark, shuffled[i : i + 60]) for i in range(0, 240, 60)])
    assert late_rows.count() > 5 and rejects.count() == 0 and on_time.count() + late_rows.count() == 240
    changes, got = settled(taken, on_time, late_rows)
    want = R.dedup_events(events(spark, made))
    assert revenue(got) == revenue(R.hourly_revenue(want))
    exact = L.corrected(taken, changes.select(*taken.columns, "change"))
    assert sorted(r.event_id for r in exact.collect()) == sorted(r.event_id for r in want.collect())


def test_replayed_batch_is_dealt_out_once(spark, tmp_path):
    folder = str(tmp_path / "split")
    write = late.split_arrivals(spark, folder)
    first, second = events(spark, [("a", "p", 100, 1)]), events(spark, [("b", "p", 1, 1), ("c", None, 100, 1), ("d", "q", 101, 1)])
    for batch_id, batch in [(0, first), (1, second), (1, second), (0, first), (2, first.limit(0))]:
        write(batch, batch_id)
    got = sorted((r.event_id, kind, r.batch_id) for kind in (late.ON_TIME, late.LATE, late.REJECT) for r in late.arrived(spark, folder, kind).collect())
    assert got == [("a", "on_time", 0), ("b", "late", 1), ("c", "reject", 1), ("d", "on_time", 1)]


def test_nothing_late_changes_nothing(spark):
    taken = events(spark, [("a", "p", 10, 5)])
    assert L.corrections(taken, taken, taken.limit(0)).collect() == []


def test_latency_within_one_percent_in_rank(spark):
    """Sketches of parts, as of batches, merged: against the sorted delays."""
    random.seed(9)
    n = 60_000
    rows = spark.range(n).select(
        F.lit(START).cast("timestamp_ntz").alias("event_time"),
        (F.lit(START) + F.expr("make_dt_interval(0, 0, 0, pow(hash(id) % 1000003, 2) / 1e9)")).cast("timestamp_ntz").alias("arrived_at"),
        (F.col("id") % 7).alias("batch"),
    )
    parts = [L.latency_sketches(rows.filter(F.col("batch") == b)) for b in range(7)]
    sketches = parts[0]
    for part in parts[1:]:
        sketches = sketches.unionByName(part)
    shares = [0.01, 0.1, 0.5, 0.9, 0.99]
    got = {r.share: r for r in L.latency_quantiles(sketches, shares, ["date"]).collect()}
    delays = sorted((r.arrived_at - r.event_time) / timedelta(milliseconds=1) for r in rows.collect())
    for share in shares:
        below = sum(d <= got[share].latency_ms for d in delays) / n
        assert abs(below - share) < 0.01 and got[share].n == n and got[share].slowest == delays[-1]
