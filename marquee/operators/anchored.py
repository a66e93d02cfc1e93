"""Windows of fixed length anchored at their first row, per key.

A window opens at the first row of a key, takes every row less than `length`
after it, and the next row opens a new one.  That is what a key with a
time-to-live that is set once does: the first row of a window is the one a
de-duplicator accepts, and the position inside the window is what a rate limit
counts.  Where a window opens depends on all rows before it, so no window
function expresses it.  The rows are shuffled and sorted by Spark; a small
numpy helper then walks each sorted partition batch by batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.operators.skew import ROWS_PER_CHUNK, apart, chunk_carry, chunked, hot_keys, micros
from marquee.session import materialize


def anchored_windows(
    df: DataFrame,
    key: str,
    ts: str,
    tie: str,
    length_us: int,
    position: str = "position",
    rows_per_chunk: int = ROWS_PER_CHUNK,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add `position`: 1 for a row that opens a window, 2 for the next in it, ...

    Rows without a key belong to no window and are left out.  `source` may name
    the stored table the rows come from (see `hot_keys`).
    """
    keyed = df.filter(F.col(key).isNotNull())
    hot = hot_keys(keyed, key, micros(ts), rows_per_chunk, source)
    if hot is None:
        rows = keyed.withColumn("_chunk", F.lit(0).cast("long")).withColumn("_t", micros(ts))
        return _number(rows, key, length_us, position, tie)
    plain, large = apart(keyed, key, hot)
    rows = materialize(chunked(large, key, micros(ts), hot).withColumn("_t", micros(ts)))
    entering = _entering(rows.select(key, "_chunk", "_t", "_is_hot"), key, length_us, hot, rows_per_chunk)
    plain = plain.withColumn("_chunk", F.lit(0).cast("long")).withColumn("_t", micros(ts))
    return _number(plain, key, length_us, position, tie).unionByName(
        _number(rows.drop("_is_hot"), key, length_us, position, tie, entering)
    )


def _number(
    rows: DataFrame, key: str, length: int, position: str, tie: str, entering: DataFrame | None = None
) -> DataFrame:
    """Rows with their position; `entering` holds the window open at the start of a chunk and the rows it took."""
    rows = rows.withColumn("_seen", F.lit(None).cast("long"))
    if entering is not None:
        rows = rows.unionByName(entering, allowMissingColumns=True)
    schema = T.StructType([*rows.schema.fields, T.StructField(position, T.LongType())])
    ordered = rows.repartition(key, "_chunk").sortWithinPartitions(key, "_chunk", "_t", tie)
    numbered = ordered.mapInArrow(_numbering(key, length, position), schema)
    return numbered.filter(F.col("_seen").isNull()).drop("_chunk", "_t", "_seen")


def _numbering(key: str, length: int, position: str):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (key, chunk) of the row before, start of its window, rows in it so far
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys, chunks = batch.column(key), batch.column("_chunk")
            t = batch.column("_t").to_numpy(zero_copy_only=False)
            seen = pc.fill_null(batch.column("_seen"), 1).to_numpy(zero_copy_only=False)
            starts = np.ones(batch.num_rows, dtype=bool)
            starts[1:] = pc.or_(
                pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1)),
                pc.not_equal(chunks.slice(1), chunks.slice(0, len(chunks) - 1)),
            ).to_numpy(zero_copy_only=False)
            resumed = last is not None and last[0] == (keys[0].as_py(), chunks[0].as_py())
            if resumed:
                t, seen = np.r_[last[1], t], np.r_[last[2], seen]
                starts = np.r_[True, False, starts[1:]]
            opener, numbers = _positions(t, starts, seen, length)
            last = ((keys[-1].as_py(), chunks[-1].as_py()), int(t[opener[-1]]), int(numbers[-1]))
            numbers = numbers[1:] if resumed else numbers
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, position]
            )

    return number


def _positions(t: np.ndarray, starts: np.ndarray, seen: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the row opening each row's window, and each row's place in it."""
    segment = np.cumsum(starts) - 1
    first = np.flatnonzero(starts)
    end = np.r_[first[1:], len(t)] - 1
    # One time axis for all segments, more than a window apart, so a single walk covers them.
    base = np.r_[0, np.cumsum(t[end] - t[first] + length + 1)[:-1]]
    axis = t - t[first][segment] + base[segment]
    following = np.searchsorted(axis, axis + length).tolist()
    opens = np.zeros(len(t), dtype=np.int64)
    i = 0
    while i < len(t):
        opens[i] = i
        i = following[i]
    opener = np.maximum.accumulate(opens)
    return opener, np.arange(len(t)) - opener + seen[opener]


def _entering(times: DataFrame, key: str, length: int, hot: list[DataFrame], rows_per_chunk: int) -> DataFrame:
    """Per chunk of a hot key the window that is open when it begins: its start, and the rows it took so far."""
    openers = materialize(_openers(times, key, length, rows_per_chunk))
    chunks = times.groupBy(key, "_chunk").agg(F.min("_t").alias("_t"), F.count(F.lit(1)).alias("_n"))
    in_time = Window.partitionBy(key).orderBy("_t", F.col("_chunk").isNotNull().desc())
    before = in_time.rowsBetween(Window.unboundedPreceding, -1)
    # One row per chunk and per window, not per row: the last opener before each chunk.
    entered = (
        chunks.unionByName(openers.select(key, "_t").withColumn("_open", F.col("_t")), allowMissingColumns=True)
        .withColumn("_opened", F.max("_open").over(before))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .filter(F.col("_chunk").isNotNull())
        .select(key, "_chunk", "_opened", "_before")
    )
    # Rows of the key ahead of that opener: those before its chunk, and those ahead of it inside.
    last = chunked(entered.select(key, "_opened").filter("_opened IS NOT NULL").distinct(), key, F.col("_opened"), hot)
    inside = (
        times.join(last.select(key, "_chunk", "_opened"), [key, "_chunk"])
        .groupBy(key, "_chunk", "_opened")
        .agg(F.count_if(F.col("_t") < F.col("_opened")).alias("_inside"))
    )
    ahead = inside.join(entered.select(key, "_chunk", "_before"), [key, "_chunk"]).select(
        key, "_opened", (F.col("_before") + F.col("_inside")).alias("_ahead")
    )
    return entered.join(ahead, [key, "_opened"]).select(
        key, "_chunk", F.col("_opened").alias("_t"), (F.col("_before") - F.col("_ahead")).alias("_seen")
    )


def _openers(times: DataFrame, key: str, length: int, rows_per_chunk: int) -> DataFrame:
    """(key, _t) of every row of a hot key that opens a window; of equal times one."""
    candidates = materialize(_candidates(times, key, length))
    cuts = hot_keys(candidates, key, F.col("_t"), rows_per_chunk)
    if cuts is None:
        rows, entering = candidates.withColumn("_chunk", F.lit(0).cast("long")), None
    else:
        rows = chunked(candidates, key, F.col("_t"), cuts)
        entering = _chained(rows.filter("_is_hot"), key, length)
        rows = rows.drop("_is_hot")
    rows = rows.withColumn("_own", F.col("_t"))
    return _number(rows, key, length, "_nth", "_own", entering).filter("_nth = 1").select(key, F.col("_own").alias("_t"))


def _candidates(times: DataFrame, key: str, length: int) -> DataFrame:
    """Distinct (key, _t) that may open a window: all that do, and few more where rows are dense.

    A row after a pause of `length` opens a window for certain; count cells of
    `length` from there.  Each further opener comes later in its cell than the
    one before did in its own, by less than the pause right before it.  So in
    any cell it lies no deeper than the longest pauses of the cells so far add
    up to, which is little where rows are dense.
    """
    times = times.select(key, "_chunk", "_t", "_is_hot").distinct()
    order = Window.partitionBy(key, "_chunk").orderBy("_t")
    last = chunk_carry(times, key, {"_last": (F.max("_t"), F.max)})
    pause = F.col("_t") - F.coalesce(F.lag("_t").over(order), F.col("_last"))
    paused = materialize(
        times.join(last, [key, "_chunk"], "left")
        .withColumn("_pause", pause)
        .withColumn("_start", F.when(F.col("_pause").isNull() | (F.col("_pause") >= length), F.col("_t")))
        .drop("_last")
    )
    started = chunk_carry(paused, key, {"_since": (F.max("_start"), F.max)})
    since = F.coalesce(F.max("_start").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.col("_since"))
    placed = (
        paused.join(started, [key, "_chunk"], "left")
        .withColumn("_since", since)
        .withColumn("_cell", F.expr(f"(_t - _since) div {length}"))
        .withColumn("_depth", F.expr(f"(_t - _since) % {length}"))
    )
    so_far = Window.partitionBy(key, "_since").orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    limits = (
        placed.groupBy(key, "_since", "_cell")
        .agg(F.max(F.when(F.col("_cell") > 0, F.col("_pause")).otherwise(0)).alias("_longest"))
        .withColumn("_limit", F.sum("_longest").over(so_far))
        .drop("_longest")
    )
    return placed.join(limits, [key, "_since", "_cell"]).filter(F.col("_depth") <= F.col("_limit")).select(key, "_t")


def _chained(rows: DataFrame, key: str, length: int) -> DataFrame:
    """The window that is open when each chunk of a hot key begins, `_seen` not being counted.

    First every chunk is reduced, in parallel, to a table "if the first window
    may open from x on, the last one opens at y"; neighbouring x with the same y
    share a row, and x reaches no further than one window into the chunk.  Then
    those tables are chained along the chunks of each key.
    """
    key_field = rows.schema[key]
    exits_schema = T.StructType([key_field, *[T.StructField(c, T.LongType()) for c in ("_chunk", "upto", "exit_t")]])
    entering_schema = T.StructType([key_field, *[T.StructField(c, T.LongType()) for c in ("_chunk", "_t", "_seen")]])

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["_t"].to_numpy())
        n = len(t)
        following = np.searchsorted(t, t + length).tolist()
        final = list(range(n))
        for i in range(n - 1, -1, -1):
            if following[i] < n:
                final[i] = final[following[i]]
        entries = min(n, following[0] + 1)
        final = np.array(final[:entries])
        ends_run = np.r_[final[1:] != final[:-1], True]
        return pd.DataFrame(
            {
                key: pdf[key].iloc[0],
                "_chunk": pdf["_chunk"].iloc[0],
                "upto": t[:entries][ends_run],
                "exit_t": t[final[ends_run]],
            }
        )

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        out, opened = [], None
        for chunk, runs in pdf.sort_values(["_chunk", "upto"]).groupby("_chunk", sort=True):
            if opened is not None:
                out.append((pdf[key].iloc[0], chunk, opened, 1))
            run = 0 if opened is None else int(np.searchsorted(runs["upto"].to_numpy(), opened + length))
            if run < len(runs):
                opened = int(runs["exit_t"].iloc[run])
        return pd.DataFrame(out, columns=[key, "_chunk", "_t", "_seen"])

    reduced = rows.select(key, "_chunk", "_t").groupBy(key, "_chunk").applyInPandas(exits, exits_schema)
    return reduced.groupBy(key).applyInPandas(chain, entering_schema)
