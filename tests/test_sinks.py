"""Sinks under failure: retries and dead letters, messages sent once, and replays after a crash at any point."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from marquee.streaming import retry, sinks


def stored(spark, path):
    return sorted(r.event_id for r in spark.read.parquet(path).collect())


class Sink:
    """Stores parts, but fails on rows with a bad id (as a job does) and on some calls altogether."""

    def __init__(self, path, bad=(), down=()):
        self.keep, self.bad, self.down, self.calls = retry.append_part(path), [str(b) for b in bad], set(down), 0

    def __call__(self, rows, batch_id, part):
        self.calls += 1
        if self.calls in self.down:
            raise OSError("no route to the store")
        poison = F.when(F.col("event_id").isin(self.bad), F.raise_error(F.concat(F.lit("refused "), "event_id")))
        self.keep(rows.withColumn("amount", F.coalesce(poison.cast("double"), F.col("amount"))), batch_id, part)


@pytest.fixture
def batch(spark):
    return spark.range(200).select(F.col("id").cast("string").alias("event_id"), F.col("id").cast("double").alias("amount"))


def writer(spark, tmp_path, sink, **options):
    naps = options.pop("naps", [])
    return retry.with_retries(
        spark, sink, str(tmp_path / "ledger"), str(tmp_path / "dead"), ["event_id"], sleep=naps.append, **options
    )


def test_failing_rows_alone_are_dead_letters(spark, batch, tmp_path):
    out, naps = str(tmp_path / "out"), []
    sink = Sink(out, bad=(17, 120))
    write = writer(spark, tmp_path, sink, naps=naps)
    write(batch, 0)
    good = sorted(str(i) for i in range(200) if i not in (17, 120))
    assert stored(spark, out) == good and naps == [2.0, 2.0]
    dead = {r.event_id: r for r in spark.read.parquet(str(tmp_path / "dead")).collect()}
    assert set(dead) == {"17", "120"} and {r.attempts for r in dead.values()} == {3}
    assert all("refused" in r.reason or "USER_RAISED" in r.reason for r in dead.values()) and dead["17"].amount == 17.0
    calls = sink.calls
    write(batch, 0)  # a replay has nothing left to do
    assert stored(spark, out) == good and sink.calls == calls
    assert spark.read.parquet(str(tmp_path / "dead")).count() == 2
    write(batch, 1)
    assert stored(spark, f"{out}/batch_id=1") == good


def test_good_batch_is_one_store(spark, batch, tmp_path):
    sink = Sink(str(tmp_path / "out"))
    write = writer(spark, tmp_path, sink)
    write(batch, 5)
    write(batch, 5)
    assert sink.calls == 1 and len(stored(spark, str(tmp_path / "out"))) == 200


def test_passing_trouble_loses_and_repeats_nothing(spark, batch, tmp_path):
    few = batch.limit(6)
    sink = Sink(str(tmp_path / "out"), down=(1, 2, 3))
    writer(spark, tmp_path, sink)(few, 0)
    assert stored(spark, str(tmp_path / "out")) == [str(i) for i in range(6)]
    assert not (tmp_path / "dead").exists()


def test_sink_that_is_down_makes_no_dead_letters(spark, batch, tmp_path):
    few = batch.limit(3)
    down = Sink(str(tmp_path / "out"), down=range(1, 1000))
    with pytest.raises(RuntimeError, match="down"):
        writer(spark, tmp_path, down, healthy=lambda: False)(few, 0)
    assert not (tmp_path / "dead").exists()
    writer(spark, tmp_path, Sink(str(tmp_path / "out")))(few, 0)  # the replay, with the sink up again
    assert stored(spark, str(tmp_path / "out")) == ["0", "1", "2"]


def test_rows_of_one_key_fail_together(spark, tmp_path):
    rows = spark.createDataFrame([("7", 1.0), ("7", 2.0), ("8", 3.0), (None, 4.0)], "event_id string, amount double")
    writer(spark, tmp_path, Sink(str(tmp_path / "out"), bad=(7,)))(rows, 0)
    assert sorted(r.amount for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [3.0, 4.0]
    assert sorted(r.amount for r in spark.read.parquet(str(tmp_path / "dead")).collect()) == [1.0, 2.0]


@pytest.mark.parametrize("at", [1, 2, 4, 7])
def test_crash_at_any_entry_of_the_ledger(spark, batch, tmp_path, monkeypatch, at):
    few, entries = batch.limit(12), []
    enter = retry.Ledger.enter

    def crashing(self, *entry):
        entries.append(entry)
        if len(entries) == at:
            raise KeyboardInterrupt
        enter(self, *entry)

    monkeypatch.setattr(retry.Ledger, "enter", crashing)
    out = str(tmp_path / "out")
    for _ in range(3):
        try:
            writer(spark, tmp_path, Sink(out, bad=(5,)))(few, 0)
        except KeyboardInterrupt:
            continue
        break
    assert stored(spark, out) == sorted(str(i) for i in range(12) if i != 5)
    assert [r.event_id for r in spark.read.parquet(str(tmp_path / "dead")).collect()] == ["5"]


def test_recovered_sink_does_not_store_twice_what_was_cut(spark, batch, tmp_path, monkeypatch):
    """Halves are stored, the driver dies, and the sink takes the bad row by then."""
    few, out = batch.limit(12), str(tmp_path / "out")
    enter, entries = retry.Ledger.enter, []

    def crashing(self, *entry):
        entries.append(entry)
        if entry[3] == "stored":
            raise KeyboardInterrupt
        enter(self, *entry)

    monkeypatch.setattr(retry.Ledger, "enter", crashing)
    with pytest.raises(KeyboardInterrupt):
        writer(spark, tmp_path, Sink(out, bad=(5,)))(few, 0)
    monkeypatch.setattr(retry.Ledger, "enter", enter)
    writer(spark, tmp_path, Sink(out))(few, 0)
    assert stored(spark, out) == sorted(str(i) for i in range(12))


class Topic:
    def __init__(self, crash_at=None, after=False):
        self.messages, self.crash_at, self.after, self.calls = [], crash_at, after, 0

    def __call__(self, rows, batch_id):
        self.calls += 1
        if self.calls == self.crash_at and not self.after:
            raise KeyboardInterrupt
        self.messages += [r.message_id for r in rows.collect()]
        if self.calls == self.crash_at:
            raise KeyboardInterrupt


@pytest.mark.parametrize("crash_at", [1, 3])
@pytest.mark.parametrize("after", [False, True])
def test_messages_are_sent_once(spark, batch, tmp_path, crash_at, after):
    out, topic = str(tmp_path / "out"), Topic(crash_at, after)
    with pytest.raises(KeyboardInterrupt):
        sinks.publish_once(out, topic, "event_id", pieces=4)(batch, 3)
    sent = len(topic.messages)
    assert spark.read.parquet(out).count() == 200 and sent < 200
    changed = batch.withColumn("event_id", F.concat(F.lit("x"), "event_id"))  # not what is replayed counts, but the outbox
    sinks.append_once(out, topic, "event_id", pieces=4)(changed, 3)
    want = sorted(f"3:{i}" for i in range(200))
    if not after:
        assert sorted(topic.messages) == want  # a crash between store and send, or between pieces: nothing twice
    else:
        assert sorted(set(topic.messages)) == want and len(topic.messages) < 200 + 200 // 2  # one piece again, same ids
    calls = topic.calls
    sinks.publish_once(out, topic, "event_id", pieces=4)(batch, 3)
    assert topic.calls == calls
    sinks.publish_once(out, topic, "event_id", pieces=4)(batch.limit(1), 4)
    assert topic.messages[-1] == "4:0"
