"""Keyed windows that stay balanced when one key holds a large share of the rows.

A window partitioned by a key puts all rows of that key into one task.  The
helpers here cut the few keys that are too large for that into chunks that
follow the window order, and hand the little a chunk needs from its
predecessors (its last k rows, or a running total) over separately.  Ordinary
keys keep the plain plan, their rows are neither written nor shuffled for the hot ones, and the
answer never depends on where the cuts fall.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.session import materialize

ROWS_PER_CHUNK = 1_000_000
BROADCAST_KEYS = 100_000  # longer lists of hot keys are joined by a shuffle


def micros(ts: Column | str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def hot_keys(
    df: DataFrame, key: str, pos: Column, rows_per_chunk: int = ROWS_PER_CHUNK, source: DataFrame | None = None
) -> list[DataFrame] | None:
    """How to cut the keys of more than `rows_per_chunk` rows; None if there are none.

    `pos` is the whole-number position that leads the window order.  The first
    table cuts the span of each such key into pieces of equal width; further
    tables cut the pieces again that turn out too large, as where a key comes in bursts.
    Rows are not shuffled to find the keys: see `frequent`; only what may be hot is counted, and
    combined map-side.  `source` may name a stored table of at least as many
    rows: its row count, read from file footers, may settle it.
    """
    total = (df if source is None else source).count()
    if total <= rows_per_chunk:
        return None

    def narrower(width: Column) -> Column:
        return F.greatest(F.lit(1).cast("long"), F.ceil(width / F.ceil(F.col("_n") / F.lit(rows_per_chunk))))

    count = F.count(F.lit(1)).alias("_n")
    keyed = df.filter(F.col(key).isNotNull())
    maybe = materialize(frequent(keyed, key, rows_per_chunk / total))
    if maybe.isEmpty():
        return None
    only_maybe = keyed.select(key, pos.alias("_at")).join(_short(maybe), key, "left_semi")
    largest = only_maybe.groupBy(key).agg(count, F.min("_at").alias("_chunk"), F.max("_at").alias("_hi"))
    largest = largest.filter(F.col("_n") > rows_per_chunk)
    cuts = [materialize(largest.select(key, "_chunk", narrower(F.col("_hi") - F.col("_chunk") + 1).alias("_width")))]
    if cuts[0].isEmpty():
        return None
    only_hot = df.select(key, pos.alias("_at")).join(_short(cuts[0]).select(key), key, "left_semi")
    while True:
        sizes = _cut(only_hot, key, F.col("_at"), cuts).groupBy(key, "_chunk", "_width").agg(count)
        large = sizes.filter((F.col("_n") > 2 * rows_per_chunk) & (F.col("_width") > 1))
        again = materialize(large.select(key, "_chunk", narrower(F.col("_width")).alias("_width")))
        if again.isEmpty():
            return cuts
        cuts.append(again)


def frequent(df: DataFrame, key: str, share: float) -> DataFrame:
    """Distinct keys among which are all that hold at least `share` of the rows; few others.

    A key with such a share of all rows has it in one partition at least.  So each partition keeps
    the counters of a Misra-Gries summary, 2 / share of them, and passes on only keys
    whose count, with what the summary may have missed, reaches the share there.
    """
    room = int(2 / share) + 1
    schema = T.StructType([df.schema[key]])

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen, missed = None, 0, 0
        for batch in batches:
            counted = pc.value_counts(batch.column(0))
            part = pa.table({"k": counted.field(0), "n": counted.field(1)})
            seen += batch.num_rows
            known = part if known is None else pa.concat_tables([known, part])
            if known.num_rows <= 4 * room:
                continue
            known = known.group_by("k").aggregate([("n", "sum")]).rename_columns(["k", "n"])
            if known.num_rows > 2 * room:
                n = known["n"].to_numpy()
                least = int(np.partition(n, -room - 1)[-room - 1])
                missed += least
                known = known.set_column(1, "n", pa.array(n - least)).filter(pa.array(n > least))
        if known is not None:
            known = known.group_by("k").aggregate([("n", "sum")])
            reached = known.filter(pc.greater_equal(known["n_sum"], seen * share - missed))
            yield from pa.table([reached["k"]], names=[key]).to_batches()

    return df.select(key).mapInArrow(heavy, schema).distinct()


def apart(df: DataFrame, key: str, hot: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of hot keys); rows without a key are ordinary."""
    keys = _short(hot[0].select(key))
    return df.join(keys, key, "left_anti"), df.join(keys, key, "left_semi")


def _short(keys: DataFrame) -> DataFrame:
    """Stored `keys`, broadcast if they are few: there can be rows / rows_per_chunk of them."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _cut(df: DataFrame, key: str, pos: Column, cuts: list[DataFrame]) -> DataFrame:
    """Add `_chunk`, the position at which the row's chunk starts, and its `_width`; null for ordinary keys."""
    start = F.col("_chunk") + F.expr("((_pos - _chunk) div _width) * _width")
    rows = df.withColumn("_pos", pos).join(_short(cuts[0]), key, "left").withColumn("_chunk", start)
    for cut in cuts[1:]:
        rows = (
            rows.withColumnRenamed("_width", "_w")
            .join(cut, [key, "_chunk"], "left")
            .withColumn("_chunk", F.coalesce(start, F.col("_chunk")))
            .withColumn("_width", F.coalesce("_width", "_w"))
            .drop("_w")
        )
    return rows.drop("_pos")


def chunked(df: DataFrame, key: str, pos: Column, hot: list[DataFrame]) -> DataFrame:
    """Add `_chunk`, rising with `pos` inside hot keys and 0 elsewhere, and `_is_hot`."""
    return (
        _cut(df, key, pos, hot)
        .withColumn("_is_hot", F.col("_chunk").isNotNull())
        .withColumn("_chunk", F.coalesce("_chunk", F.lit(0).cast("long")))
        .drop("_width")
    )


def chunk_carry(rows: DataFrame, key: str, parts: dict[str, tuple[Column, Callable[[Column], Column]]]) -> DataFrame:
    """Per hot (key, chunk), each part combined over all earlier chunks of the key.

    A part is (aggregate of one chunk, function that combines aggregates).  The
    second step sees one row per chunk, not the rows themselves.
    """
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = rows.filter("_is_hot").groupBy(key, "_chunk").agg(*[part.alias(name) for name, (part, _) in parts.items()])
    return per_chunk.select(
        key, "_chunk", *[combine(F.col(name)).over(earlier).alias(name) for name, (_, combine) in parts.items()]
    )


def rank_within(
    df: DataFrame, key: str, pos: Column, order: Sequence[Column], name: str, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """1-based row number of every row inside its key; `pos` must lead `order`."""
    hot = hot_keys(df, key, pos, rows_per_chunk)
    plain, large = (df, None) if hot is None else apart(df, key, hot)
    ranked = plain.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))
    if hot is None:
        return ranked
    rows = chunked(large, key, pos, hot)
    carry = chunk_carry(rows, key, {"_before": (F.count(F.lit(1)), F.sum)})
    local = F.row_number().over(Window.partitionBy(key, "_chunk").orderBy(*order))
    cut = (
        rows.withColumn(name, local)
        .join(carry, [key, "_chunk"], "left")
        .withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0)))
        .drop("_before", "_chunk", "_is_hot")
    )
    return ranked.unionByName(cut)


def with_lookback(df: DataFrame, key: str, pos: Column, order: Sequence[str], k: int, hot: list[DataFrame]) -> DataFrame:
    """Rows plus, for each hot chunk, copies of the k rows of its key before it.

    The copies carry `_halo = true`; compute windows over (key, _chunk) and drop
    them afterwards.  Every chunk holds at least one row, so the k chunks before
    it are enough to find those rows.
    """
    rows = chunked(df, key, pos, hot).withColumn("_halo", F.lit(False))
    fields = [c for c in df.columns if c != key]
    newest_first = Window.partitionBy(key, "_chunk").orderBy(*[F.desc(c) for c in order])
    tails = (
        rows.filter("_is_hot")
        .withColumn("_back", F.row_number().over(newest_first))
        .filter(F.col("_back") <= k)
        .groupBy(key, "_chunk")
        .agg(F.sort_array(F.collect_list(F.struct(F.negative("_back").alias("_at"), *fields))).alias("_tail"))
    )
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(-k, -1)
    halo = (
        tails.withColumn("_tail", F.flatten(F.collect_list("_tail").over(before)))
        .filter(F.size("_tail") > 0)
        .select(key, "_chunk", F.explode(F.expr(f"slice(_tail, greatest(1, size(_tail) - {k} + 1), {k})")).alias("_r"))
        .select(key, "_chunk", *[F.col(f"_r.{c}").alias(c) for c in fields], F.lit(True).alias("_is_hot"), F.lit(True).alias("_halo"))
    )
    return rows.unionByName(halo)
