"""Sinks that fail on some rows: retried, narrowed down to those rows, and only these go to the dead letters."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee import fixed_values as V
from marquee.session import materialize
from marquee.streaming.sinks import Writer

#: Stores a part of a batch: (rows, batch id, name of the part). Storing a part again must replace it.
PartWriter = Callable[[DataFrame, int, str], None]
#: Rows are told apart by a hash below this.
SPAN = 1 << 62

LEDGER = "batch_id long, part string, low long, high long, outcome string, attempts int, reason string"


def append_part(path: str) -> PartWriter:
    """Parts as folders of their own, so that a part stored again takes the place of the first."""

    def write(rows: DataFrame, batch_id: int, part: str) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}/part={part}")

    return write


class Ledger:
    """What became of each part of a batch: stored, cut in two, or dead after so many attempts. A small file per entry."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        spark.createDataFrame([], LEDGER).write.mode("ignore").partitionBy("batch_id").parquet(path)

    def knows(self, batch_id: int) -> bool:
        return not self._entries(batch_id).isEmpty()

    def outcome(self, batch_id: int, low: int, high: int) -> str | None:
        found = self._entries(batch_id).filter((F.col("low") == low) & (F.col("high") == high)).first()
        return found.outcome if found else None

    def _entries(self, batch_id: int) -> DataFrame:
        return self.spark.read.schema(LEDGER).parquet(self.path).filter(F.col("batch_id") == batch_id)

    def enter(self, batch_id: int, low: int, high: int, outcome: str, attempts: int, reason: str | None) -> None:
        row = [(batch_id, f"{low}-{high}", low, high, outcome, attempts, reason)]
        entry = self.spark.createDataFrame(row, LEDGER).coalesce(1)
        entry.write.mode("append").partitionBy("batch_id").parquet(self.path)


@dataclass
class _Failing:
    low: int
    high: int
    attempts: int
    reason: str


def _reason(error: Exception) -> str:
    lines = [line.strip() for line in str(error).splitlines() if line.strip()]
    return (lines[0] if lines else type(error).__name__)[:500]


def with_retries(
    spark: SparkSession,
    store: PartWriter,
    ledger: str,
    dead: str,
    key: list[str],
    attempts: int = V.RETRY_ATTEMPTS,
    pause: float = V.RETRY_PAUSE_SECONDS,
    sleep: Callable[[float], None] = time.sleep,
    healthy: Callable[[], bool] = lambda: True,
) -> Writer:
    """A `foreachBatch` writer that hands batches to `store` and survives rows it fails on.

    A batch is stored as a whole. Where that fails it is cut in two by a hash of `key`, halves that fail are cut again,
    until the failing rows stand alone (or with rows of the same key). What fails alone is tried `attempts` times in
    all, `pause` seconds apart (one pause for all of them together), and is then written to `dead` with its reason, the
    number of attempts and the batch. Every part's outcome is entered in the ledger, a cut before its halves are stored:
    a replayed batch stores only what is not settled, so rows are stored once and none is lost; a part whose store ended
    but was not entered is stored again in its own place. The dead letters are for rows, so `key` should tell rows apart. `healthy` is asked before rows are given up: if the sink itself is down, the batch fails,
    nothing is taken for dead, and the stream starts again from its checkpoint.
    """
    book = Ledger(spark, ledger)

    def attempt(rows: DataFrame, batch_id: int, low: int, high: int, count: int) -> _Failing | None:
        part = rows if (low, high) == (0, SPAN) else rows.filter(F.col("_at").between(low, high))
        try:
            store(part.drop("_at"), batch_id, f"{low}-{high}")
        except Exception as error:  # whatever the sink raises, its rows are tried again or set aside
            return _Failing(low, high, count, _reason(error))
        book.enter(batch_id, low, high, "stored", count, None)
        return None

    def write(batch: DataFrame, batch_id: int) -> None:
        replayed = book.knows(batch_id)
        outcome = book.outcome(batch_id, 0, SPAN) if replayed else None
        if outcome == "stored":
            return
        if outcome is None:
            failing = attempt(batch.withColumn("_at", F.lit(0)), batch_id, 0, SPAN, 1)
            if failing is None:
                return
            book.enter(batch_id, 0, SPAN, "cut", 1, failing.reason)
        # the failing batch is kept, so that every part sees the same rows
        rows = materialize(batch.withColumn("_at", F.pmod(F.xxhash64(*key), F.lit(SPAN))))
        alone = list(_narrowed(rows, batch_id, replayed))
        for count in range(2, attempts + 1):
            if alone:
                sleep(pause)
            tried = [attempt(rows, batch_id, f.low, f.high, count) for f in alone]
            alone = [f for f in tried if f is not None]
        if alone and not healthy():
            raise RuntimeError(f"the sink is down, batch {batch_id} is kept: {alone[0].reason}")
        for f in alone:
            lost = rows.filter(F.col("_at").between(f.low, f.high)).drop("_at")
            lost = lost.withColumns({"reason": F.lit(f.reason), "attempts": F.lit(f.attempts)})
            lost.write.mode("overwrite").parquet(f"{dead}/batch_id={batch_id}/part={f.low}-{f.high}")
            book.enter(batch_id, f.low, f.high, "dead", f.attempts, f.reason)

    def _narrowed(rows: DataFrame, batch_id: int, replayed: bool) -> Iterator[_Failing]:
        """Stores all that can be stored; yields the parts that fail and cannot be cut."""
        waiting = [(0, SPAN - 1)]
        while waiting:
            low, high = waiting.pop()
            least, most = rows.filter(F.col("_at").between(low, high)).agg(F.min("_at"), F.max("_at")).first()
            if least is None:
                continue
            outcome = book.outcome(batch_id, low, high) if replayed else None
            if outcome in ("stored", "dead"):
                continue
            if outcome is None and (low, high) != (0, SPAN - 1):
                failing = attempt(rows, batch_id, low, high, 1)
                if failing is None:
                    continue
                if least == most:
                    yield failing
                    continue
                # entered before its halves are stored: it is never stored as a whole once a half may be
                book.enter(batch_id, low, high, "cut", 1, failing.reason)
            elif least == most:
                yield _Failing(low, high, 1, "failed with the whole batch")
                continue
            middle = (least + most) // 2
            waiting += [(middle + 1, high), (low, middle)]

    return write
