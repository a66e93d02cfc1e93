"""Splitting hot keys never changes an answer: chunked plans against plain ones and brute force."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from marquee.operators import anomaly as A
from marquee.operators import anchored, skew
from marquee.operators import catalog as C
from marquee.operators import recommend as M
from marquee.operators import revenue as R
from marquee.operators import shows as S
from marquee.operators.anchored import _candidates, _openers, anchored_windows
from marquee.operators.skew import chunked, frequent, hot_keys, micros, rank_within
from marquee.plans.all import ORACLES
from marquee.plans.anomaly import FAST_SECONDS
from marquee.plans.revenue import DAY
from marquee.session import materialize
from marquee.sources.testdata import Views
from tools.check_oracle import compare, duck

START = dt.datetime(2024, 1, 1)
EVENTS = (
    "event_id string, payment_id string, user_id string, movie_id string, amount double, device_ip string, "
    "event_time timestamp_ntz, status string, location string, return_code string"
)


@contextmanager
def conf(spark, name, value):
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def skewed_times(seed: int, n: int, dense: int):
    """(key, seconds): key 'hot' holds most rows, in bursts and with long pauses; ties included."""
    rng = random.Random(seed)
    out, t = [], 0
    for _ in range(n):
        t += rng.choice([0, 0, 1, 2, 3, dense])
        out.append(("hot", t))
    out += [(f"k{rng.randrange(20)}", rng.randrange(t + 1)) for _ in range(n // 4)]
    rng.shuffle(out)
    return out


def brute_positions(rows, length):
    """rows: (key, seconds, id) -> {id: position}."""
    state, out = {}, {}
    for key, t, i in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        opened, taken = state.get(key, (None, 0))
        if opened is None or t >= opened + length:
            opened, taken = t, 0
        state[key] = (opened, taken + 1)
        out[i] = taken + 1
    return out


@pytest.mark.parametrize(("seed", "length", "dense"), [(1, 10, 5), (2, 60, 5), (3, 7, 100), (4, 1, 1), (5, 500, 3)])
@pytest.mark.parametrize("rows_per_chunk", [25, 150, 1_000_000])
def test_anchored_windows(spark, seed, length, dense, rows_per_chunk):
    rows = [(k, t, f"{i:05d}") for i, (k, t) in enumerate(skewed_times(seed, 700, dense))]
    df = spark.createDataFrame(
        [(k, START + dt.timedelta(seconds=t), i) for k, t, i in rows], "key string, ts timestamp_ntz, id string"
    )
    placed = anchored_windows(df, "key", "ts", "id", length * 1_000_000, rows_per_chunk=rows_per_chunk)
    assert placed.columns == ["key", "ts", "id", "position"]
    assert {r.id: r.position for r in placed.collect()} == brute_positions(rows, length)


def test_anchored_windows_across_small_batches(spark):
    rows = [(k, t, f"{i:05d}") for i, (k, t) in enumerate(skewed_times(9, 500, 4))]
    df = spark.createDataFrame(
        [(k, START + dt.timedelta(seconds=t), i) for k, t, i in rows], "key string, ts timestamp_ntz, id string"
    )
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    try:
        placed = anchored_windows(df, "key", "ts", "id", 20_000_000, rows_per_chunk=60)
        assert {r.id: r.position for r in placed.collect()} == brute_positions(rows, 20)
    finally:
        spark.conf.set(name, before)


def test_dense_keys_leave_few_candidates(spark):
    rng = random.Random(5)
    seconds = sorted(rng.randrange(20_000) for _ in range(6_000)) + [90_000 + i for i in range(300)]
    times = spark.createDataFrame([("hot", s) for s in seconds], "key string, _t long")
    cuts = hot_keys(times, "key", F.col("_t"), 200)
    left = {r._t for r in _candidates(chunked(times, "key", F.col("_t"), cuts), "key", 1_000).collect()}
    openers, opened = set(), None
    for s in seconds:
        if opened is None or s >= opened + 1_000:
            opened = s
            openers.add(s)
    assert openers <= left and len(left) < 1_500
    got = _openers(chunked(times, "key", F.col("_t"), cuts), "key", 1_000, 100)
    assert sorted(r._t for r in got.collect()) == sorted(openers)


def test_hot_keys_are_few_and_found(spark):
    df = spark.createDataFrame(skewed_times(3, 300, 5), "key string, t long")
    assert [r.key for r in hot_keys(df, "key", F.col("t"), 100)[0].collect()] == ["hot"]
    assert hot_keys(df, "key", F.col("t"), 10_000) is None
    assert hot_keys(df, "key", F.col("t"), 100, source=df.limit(50)) is None


def test_every_hot_key_is_cut(spark):
    df = spark.range(1_500 * 4).selectExpr("cast(id % 1500 AS string) AS key", "id AS t")
    hot = hot_keys(df, "key", F.col("t"), 3)
    assert hot[0].count() == 1_500
    assert chunked(df, "key", F.col("t"), hot).filter("NOT _is_hot").isEmpty()


def test_bursts_are_cut_again(spark):
    times = [*range(900), *(1_000_000 + 997 * i for i in range(60)), *(5_000_000 for _ in range(80))]
    df = spark.createDataFrame([("hot", t) for t in times] + [("k", 1)], "key string, t long")
    hot = hot_keys(df, "key", F.col("t"), 50)
    assert len(hot) > 1
    rows = chunked(df, "key", F.col("t"), hot)
    sizes = {r._chunk: (r.n, r.lo) for r in rows.filter("_is_hot").groupBy("_chunk").agg(F.count("*").alias("n"), F.min("t").alias("lo")).collect()}
    assert sum(n for n, _ in sizes.values()) == len(times)
    assert max(n for n, lo in sizes.values() if lo < 5_000_000) <= 100
    assert [lo for _, (_, lo) in sorted(sizes.items())] == sorted(lo for _, lo in sizes.values())
    assert [(r._chunk, r._is_hot) for r in rows.filter("key = 'k'").collect()] == [(0, False)]


def test_rank_within(spark):
    rows = [(k, t, i) for i, (k, t) in enumerate(skewed_times(6, 400, 5))]
    df = spark.createDataFrame(rows, "key string, t long, id long")
    order = [F.col("t"), F.col("id")]
    for size in (30, 1_000_000):
        got = {r.id: r.rank for r in rank_within(df, "key", F.col("t"), order, "rank", size).collect()}
        want, place = {}, {}
        for k, t, i in sorted(rows):
            place[k] = place.get(k, 0) + 1
            want[i] = place[k]
        assert got == want


def payment_rows(seed: int):
    rng = random.Random(seed)
    out = []
    for i, (key, t) in enumerate(skewed_times(seed, 500, 12)):
        user = None if rng.random() < 0.05 else key
        amount = rng.choice([10.0, 11.0, 12.0, 500.0, 1_000_000.0])
        when = START + dt.timedelta(seconds=t) + dt.timedelta(days=31 if t > 900 else 0)
        out.append((f"{i:05d}", f"p{i}", user, "1", amount, f"10.0.0.{rng.randrange(3)}", when, "PAID", "VN", "0"))
    return out


def test_anomalies_do_not_depend_on_chunks(spark):
    rows = payment_rows(11)
    df = spark.createDataFrame(rows, EVENTS)
    want = brute_anomalies(rows)
    for size in (40, 1_000_000):
        logs = A.anomaly_logs(A.with_history(df, rows_per_chunk=size))
        assert {(r.event_id, r.type) for r in logs.collect()} == want


def brute_anomalies(rows):
    """The rules, one event after the other."""
    found, times, last_ip, history = set(), {}, {}, {}
    for event_id, _, user, _, amount, ip, when, status, _, code in sorted(rows, key=lambda r: (r[6], r[0])):
        if amount >= 1_000_000:
            found.add((event_id, "HIGH_AMOUNT"))
        if status.upper() == "FAILED" and code == "0":
            found.add((event_id, "FAILED_BUT_CHARGED"))
        if user is None:
            continue
        times[user] = [t for t in times.get(user, []) if when - t <= dt.timedelta(seconds=30)] + [when]
        if len(times[user]) >= 3:
            found.add((event_id, "MULTIPLE_FAST_TRANSACTION"))
        if last_ip.get(user, ip) != ip:
            found.add((event_id, "DEVICE_CHANGE"))
        last_ip[user] = ip
        pushed, past = history.get(user, (None, []))
        if pushed is not None and when - pushed >= dt.timedelta(days=30):
            past = []
        if len(past) >= 5:
            mean = sum(past) / len(past)
            sd = (sum((a - mean) ** 2 for a in past) / len(past)) ** 0.5
            if sd > 0 and abs((amount - mean) / sd) > 3:
                found.add((event_id, "AMOUNT_ZSCORE"))
        history[user] = (when, [*past, amount][-20:])
    return found


def show_rows(seed: int):
    rng = random.Random(seed)
    out = []
    for i in range(400):
        hall = "hot" if rng.random() < 0.7 else f"h{rng.randrange(4)}"
        start = START + dt.timedelta(minutes=10 * rng.randrange(3000))
        out.append((f"s{i:03d}", hall, start, start + dt.timedelta(minutes=10 * rng.randrange(1, 30))))
    return out


SHOWS = "show_id string, hall_id string, start_time timestamp_ntz, end_time timestamp_ntz"


def brute_conflicts(asked, shows):
    out = {}
    for i, hall, s, e in asked:
        met = [x for x in shows if x[1] == hall and x[0] != i and s <= x[3] and e >= x[2]]
        if met:
            earlier = [x for x in met if (x[2], x[0]) < (s, i)]
            named = max(earlier, key=lambda x: (x[3], x[0])) if earlier else max(met, key=lambda x: (x[2], x[0]))
            out[i] = (len(met), named[0])
    return out


@pytest.mark.parametrize("rows_per_chunk", [30, 1_000_000])
def test_conflicts(spark, rows_per_chunk):
    rows = show_rows(21)
    shows = spark.createDataFrame(rows, SHOWS)
    got = S.conflicts(shows, shows, rows_per_chunk).filter("n_conflicts > 0").collect()
    assert {r.show_id: (r.n_conflicts, r.conflict_with) for r in got} == brute_conflicts(rows, rows)
    new = [(f"n{i}", h, s + dt.timedelta(minutes=5), e) for i, h, s, e in show_rows(22)]
    asked = spark.createDataFrame(new, SHOWS)
    got = S.conflicts(asked, shows, rows_per_chunk).collect()
    assert len(got) == len(new)
    assert {r.show_id: (r.n_conflicts, r.conflict_with) for r in got if r.n_conflicts} == brute_conflicts(new, rows)


def test_conflicting_pairs(spark):
    rows = show_rows(23)
    shows = spark.createDataFrame(rows, SHOWS)
    for mode in ("overlap", "endpoint"):
        got = {(r.candidate_id, r.show_id) for r in S.conflicting_shows(shows, shows, mode).collect()}
        want = set()
        for a, h1, s1, e1 in rows:
            for b, h2, s2, e2 in rows:
                endpoint = s2 <= s1 <= e2 or s2 <= e1 <= e2
                if h1 == h2 and a != b and (endpoint if mode == "endpoint" else s1 <= e2 and e1 >= s2):
                    want.add((a, b))
        assert got == want


def test_recommendations_do_not_depend_on_chunks(spark):
    rng = random.Random(31)
    names = ["a", "b", "c", "d", "e", "f"]
    genres = {m: set(rng.sample(names, rng.choice([1, 1, 2, 3]))) if m < 60 else {"a", "b"} for m in range(120)}
    watched = {(u, m): rng.choice([1, 1, 2]) for u in range(12) for m in rng.sample(range(120), 3)}
    watched |= {(99, m): 1 for m in range(118)}  # has seen almost everything
    genres |= {m: {"z"} for m in (200, 201)}
    watched |= {(98, m): 1 for m in (200, 201)}  # has seen all that shares a genre
    got = M.recommend(
        spark.createDataFrame([(str(u), m, n) for (u, m), n in watched.items()], "user_id string, movie_id long, n long"),
        spark.createDataFrame([(m, g) for m, gs in genres.items() for g in gs], "movie_id long, genre string"),
        rows_per_chunk=20,
    )
    want = {}
    for user in {u for u, _ in watched}:
        vector: dict[str, int] = {}
        for (u, m), n in watched.items():
            for g in genres[m] if u == user else ():
                vector[g] = vector.get(g, 0) + n
        norm = sum(w * w for w in vector.values()) ** 0.5
        scored = []
        for m, gs in genres.items():
            if (user, m) not in watched:
                scored.append((-sum(vector.get(g, 0) for g in gs) / (norm * len(gs) ** 0.5), m))
        want[str(user)] = [m for _, m in sorted(scored)[:8]]
    found: dict[str, list] = {}
    for r in sorted(got.collect(), key=lambda r: (r.user_id, r.place)):
        found.setdefault(r.user_id, []).append(r.movie_id)
    assert found == want


def test_catalog_parts_hold_every_comment_once(spark):
    comments = spark.range(500).selectExpr(
        "cast(id AS string) AS comment_id", "if(id < 400, 1L, id % 5) AS movie_id", "'u' AS user_id", "'text' AS comment",
        "1 AS rated", "0 AS liked", "0 AS disliked", "timestamp_ntz'2024-01-01 00:00:00' AS update_at",
    )
    movies = spark.range(7).selectExpr("id AS movie_id", "'t' AS title")
    users = spark.sql("SELECT 'u' AS user_id, 'name' AS username")
    nested = C.catalog(movies, spark.range(7).selectExpr("id AS movie_id", "'g' AS genre"), comments, users, 50)
    rows = nested.collect()
    assert max(len(r.comments or []) for r in rows) < 120
    assert sorted(c.comment_id for r in rows for c in r.comments or []) == sorted(str(i) for i in range(500))
    assert {r.movie_id for r in rows} == set(range(7))
    assert all(r.genres == ["g"] for r in rows)


def test_micros_keeps_microseconds(spark):
    assert spark.sql("SELECT timestamp_ntz'1970-01-01 00:00:01.000002' AS t").select(micros("t")).first()[0] == 1_000_002


@pytest.mark.parametrize("share", [0.3, 0.05, 0.01])
def test_frequent_keys_are_all_passed_on(spark, share):
    """Whatever the order and the partitions, and though the summaries are pruned."""
    rows = [f"k{i % 7}" if i % 4 else f"u{i}" for i in range(6_000)] + ["late"] * 700 + [None] * 10
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame([(r,) for r in rows], "key string").repartition(5).filter("key IS NOT NULL")
    counts = Counter(r for r in rows if r is not None)
    total = sum(counts.values())
    with conf(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", "100"):
        got = [r.key for r in frequent(df, "key", share).collect()]
    assert len(got) == len(set(got)) <= 5 * (2 / share + 1)
    assert {k for k, n in counts.items() if n >= share * total} <= set(got)
    one_order = spark.createDataFrame([(r,) for r in sorted(r for r in rows if r)], "key string").coalesce(1)
    assert {k for k, n in counts.items() if n >= share * total} <= {r.key for r in frequent(one_order, "key", share).collect()}


def test_frequent_keys_are_found_without_a_shuffle_of_rows(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("key"))
    plan = frequent(df, "key", 0.05)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("MapInArrow")  # printed from the top


def test_only_rows_of_hot_keys_are_written(spark, monkeypatch):
    """One hot key of 600 rows among 3,000: nothing larger than its rows reaches the checkpoint folder."""
    rows = [("hot", i) for i in range(600)] + [(f"k{i % 400}", i) for i in range(2_400)]
    df = spark.createDataFrame([(k, f"e{n}", t) for n, (k, t) in enumerate(rows)], "key string, id string, t long")
    df = df.withColumn("ts", F.timestamp_seconds("t"))
    written = []

    def recorded(table):
        out = materialize(table)
        written.append(out.count())
        return out

    for module in (skew, anchored, A, S):
        monkeypatch.setattr(module, "materialize", recorded)
    placed = anchored_windows(df, "key", "ts", "id", 5_000_000, rows_per_chunk=200)
    assert placed.count() == 3_000 and max(written) <= 600
    written.clear()
    events = df.select(
        F.col("id").alias("event_id"), F.col("key").alias("user_id"), F.col("ts").alias("event_time"),
        F.col("t").cast("double").alias("amount"), F.lit("ip").alias("device_ip"),
    )
    assert A.with_history(events, rows_per_chunk=200).count() == 3_000 and max(written) <= 600
    written.clear()
    shows = df.select(
        F.col("key").alias("hall_id"), F.col("id").alias("show_id"), F.col("ts").alias("start_time"), F.timestamp_seconds(F.col("t") + 2).alias("end_time")
    )
    assert S.conflicts(shows, shows, 200).count() == 3_000 and max(written) <= 2 * 600  # a start and an end each


def test_cut_keys_answer_the_oracle(spark, tiny):
    """The named queries over the given tables with chunks so small that keys are cut."""
    v = Views(spark, tiny)
    small = {
        "dedup_events": lambda *_: R.dedup_events(v.payment_events, DAY, rows_per_chunk=4).select(
            "event_id", "payment_id", "user_id", "movie_id", "event_time", "status"
        ),
        "anomaly_by_type": lambda *_: A.count_by_type(
            A.anomaly_logs(A.with_history(R.dedup_events(v.payment_events, DAY, rows_per_chunk=4), FAST_SECONDS, rows_per_chunk=20))
        ),
        "show_conflicts": lambda *_: S.conflicts(v.shows, v.shows, 200)
        .filter("n_conflicts > 0").select("show_id", "hall_id", "n_conflicts", "conflict_with"),
    }
    for name, fn in small.items():
        verdict = compare(spark, duck(tiny), tiny, name, fn, ORACLES[name])
        assert verdict.startswith("ok"), (name, verdict)
