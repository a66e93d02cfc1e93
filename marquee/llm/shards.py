"""Sharding by longest processing time: groups that stay together go, largest first, to the least loaded shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marquee.llm.common import stored

#: Items a shard that the heap sees at most twice over: groups of at least 1 / (shards * ITEMS) of all bytes go
#: alone, the others in shards * ITEMS bundles. What one item weighs bounds how far two shards can be apart.
ITEMS = 512
#: Chunks in which the rows of a shard are numbered.
CHUNKS = 1024


def least_loaded(items: Iterable[tuple[int, int]], shards: int) -> dict[int, tuple[int, int]]:
    """item -> (shard, load before it): items (item, size) by falling size, ties by item, each to the least loaded shard."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        placed[item] = (shard, load)
        heapq.heappush(heap, (load + size, shard))
    return placed


def assign_shards(
    docs: DataFrame, shards: int = 16, id_column: str = "doc_id", text_column: str = "text", items: int = ITEMS
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard), one row per row of `docs`; law is `bytes`.

    A size is the text's UTF-8 bytes plus 1; null counts as no bytes and as the empty text. Rows of equal text form a
    group and share a shard. Shards differ by at most the largest item the heap placed: a group above
    1 / (shards * items) of all sizes, or a bundle of smaller groups, which has about that share. A group larger than
    a shard's fair share has a shard of its own as far as there are others; it is never cut. `slot` counts a shard's
    rows from 0 without gaps, by chunk of the row's hash and then by id; rows repeated get slots of their own. Texts may be of any length, a text is
    held in memory as a whole. An empty
    table gives an empty result; other columns are ignored.

    The heap is on the driver and sees at most 2 * shards * items items whatever the input; a bundle takes the groups
    whose digest falls into it, so a row knows its bundle without a join. Texts are not shuffled.
    """
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    bundles = shards * items
    rows = stored(
        docs.select(
            F.col(id_column).alias("id"),
            (F.length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.md5(text)).alias("digest"),
        ),
        "rows",
    )
    bundle = F.pmod(F.xxhash64("digest"), F.lit(bundles))
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    large = stored(groups.where(F.col("size") * bundles >= total), "large")  # at most `bundles` rows
    numbered = [(r.digest, bundles + i, r.size) for i, r in enumerate(large.orderBy(F.desc("size"), "digest").collect())]
    large_items = rows.sparkSession.createDataFrame(
        [(bytes(d), i) for d, i, _ in numbered],
        T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("alone", T.LongType())]),
    )
    known = rows.join(F.broadcast(large_items), "digest", "left").withColumn("item", F.coalesce("alone", bundle))
    small = known.where(F.col("alone").isNull()).groupBy("item").agg(F.sum("size").alias("size")).collect()
    placed = least_loaded([(r.item, r.size) for r in small] + [(i, s) for _, i, s in numbered], shards)
    where = rows.sparkSession.createDataFrame(
        [(i, s) for i, (s, _) in placed.items()],
        T.StructType([T.StructField("item", T.LongType()), T.StructField("shard", T.IntegerType())]),
    )
    chunk = F.pmod(F.xxhash64("id", "digest"), F.lit(CHUNKS)).cast("int")
    dealt = known.join(F.broadcast(where), "item").withColumn("chunk", chunk)
    counts = dealt.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "chunk").orderBy("id", "digest")
    return (
        dealt.withColumn("place", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), ["shard", "chunk"])  # at most shards * CHUNKS rows
        .select(
            F.col("id").alias(id_column),
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("place")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_column: str = "doc_id") -> None:
    """The documents as Parquet under shard=N folders, each shard in slot order. Ids must be unique and not null."""
    placed = docs.drop("shard", "slot").join(assigned.select(id_column, "shard", "slot"), id_column)
    placed.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)
