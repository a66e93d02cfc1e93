"""Benchmark decontamination: short test items inside long documents, by a size-partitioned MinHash containment search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import SHINGLE, ascii_lower, fresh, stored, words

#: Tables of up to so many rows (24 bytes each in the sketch) are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def _hashes(ws: str, k: int) -> Column:
    """Hashes of all runs of k words of the array column ws."""
    word = lambda i, j: F.get(F.col(ws), i + j)
    runs = F.transform(F.sequence(F.lit(0), F.size(ws) - k), lambda i: F.xxhash64(*[word(i, j) for j in range(k)]))
    return F.when(F.size(ws) >= k, runs).otherwise(F.array().cast("array<bigint>"))


def _texts(ws: str, k: int) -> Column:
    """The distinct runs of k words themselves."""
    runs = F.transform(F.sequence(F.lit(1), F.size(ws) - k + 1), lambda i: F.array_join(F.slice(F.col(ws), i, k), " "))
    return F.array_distinct(F.when(F.size(ws) >= k, runs).otherwise(F.array().cast("array<string>")))


def sketches(items: DataFrame, percent: int) -> DataFrame:
    """(k, h, item): for each item its smallest shingle hashes, as many as its size class needs.

    Items are partitioned by size, class c holding 2**c to 2**(c+1) - 1 shingles. An item of n shingles is contained
    if at most (100 - percent) % of them are missing, so of any floor((100 - percent) % of the class's largest size) + 1
    hashes one at least is in the document: no contained item is missed, and the smallest hashes are a random choice.
    """
    top = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1
    need = (F.floor(top * (100 - percent) / 100) + 1).cast("int")
    least = F.slice(F.array_sort("hashes"), F.lit(1), F.least(need, F.size("hashes")))
    return items.where("n > 0").select("k", "item", F.explode(least).alias("h"))


def find_items(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
    percent: int = 80,
) -> DataFrame:
    """(id, text_hash, item, n_shared, n_item): items of which at least `percent` % of the shingles are in the document.

    Shingles are the distinct runs of five words (A-Z lower-cased, cut at white space); an item with fewer words is one
    run of all its words, and one without words or text is in no document. A document without text contains nothing.
    Pairs are distinct: rows that repeat id and text, or item and text, count once; null ids are ids like others. An
    empty table on either side gives an empty result; other columns are ignored. Whole texts are searched.

    Each document's run hashes meet the items' sketches where the document is read; only matches are shuffled. The
    candidates are verified on the runs themselves, not their hashes.
    """
    asked = (
        items.select(F.col(item_column).alias("item"), words(ascii_lower(F.col(item_text_column))).alias("ws"))
        .withColumn("k", F.least(F.lit(SHINGLE), F.size("ws")))
        .where("k > 0")
    )
    sizes = sorted(r.k for r in asked.select("k").distinct().collect())  # 1 to 5
    runs, texts = F.lit(None).cast("array<bigint>"), F.lit(None).cast("array<string>")
    for k in sizes:
        runs = F.when(F.col("k") == k, F.array_distinct(_hashes("ws", k))).otherwise(runs)
        texts = F.when(F.col("k") == k, _texts("ws", k)).otherwise(texts)
    asked = asked.withColumn("hashes", runs).withColumn("texts", texts).withColumn("n", F.size("hashes"))
    asked = stored(asked.select("item", "k", "hashes", "texts", "n").distinct(), "items")
    sketch = stored(sketches(asked, percent).distinct(), "sketches")
    small = sketch.count() <= BROADCAST_ROWS
    near = (lambda t: F.broadcast(t)) if small else (lambda t: t)
    read = docs.select(
        F.col(id_column).alias("id"), F.xxhash64(text_column).alias("t"), words(ascii_lower(F.col(text_column))).alias("ws")
    )
    pairs = None
    for k in sizes:
        seen = read.select("id", "t", F.explode(_hashes("ws", k)).alias("h"))
        hits = seen.join(near(sketch.where(F.col("k") == k).select("h", "item")), "h").select("id", "t", "item")
        pairs = hits if pairs is None else pairs.unionByName(hits)
    schema = f"{id_column} {docs.schema[id_column].dataType.simpleString()}, text_hash long, " + (
        f"{item_column} {items.schema[item_column].dataType.simpleString()}, n_shared long, n_item long"
    )
    if pairs is None:
        return docs.sparkSession.createDataFrame([], schema)
    pairs = stored(pairs.distinct(), "candidates")
    wanted = pairs.groupBy("id", "t").agg(F.collect_set(F.struct("item")).alias("asked"))
    wanted = stored(wanted.select(F.col("id").alias("id_"), F.col("t").alias("t_"), "asked"), "wanted")
    if wanted.count() <= BROADCAST_ROWS and len(sizes) and asked.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    met = read.join(wanted, F.col("id").eqNullSafe(F.col("id_")) & (F.col("t") == F.col("t_")))
    # each run of a document once, not once per item: those that items ask for meet the items that have them
    sides = near(asked.select("item", "k", "n", "texts", F.xxhash64("texts").alias("own"), F.explode("texts").alias("run")).drop("texts"))
    found = None
    for k in sizes:
        runs = met.select("id", "t", "asked", F.explode(F.array_distinct(_texts("ws", k))).alias("run"))
        hits = runs.join(sides.where(F.col("k") == k).drop("k"), "run")
        hits = hits.where(F.exists("asked", lambda a: a["item"].eqNullSafe(F.col("item")))).select("id", "t", "item", "n", "own", "run")
        found = hits if found is None else found.unionByName(hits)
    found = found.groupBy("id", "t", "item", "n", "own").agg(F.size(F.collect_set("run")).cast("long").alias("n_shared"))
    found = found.withColumn("n_item", F.col("n").cast("long"))
    return (
        found.where(F.col("n_shared") * 100 >= F.col("n_item") * percent)
        .groupBy("id", "t", "item")
        .agg(F.max(F.struct("n_shared", "n_item")).alias("best"))
        .select(
            F.col("id").alias(id_column), F.col("t").alias("text_hash"), F.col("item").alias(item_column),
            "best.n_shared", "best.n_item",
        )
    )


def drop_contaminated(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options
) -> DataFrame:
    """The rows of `docs`, with all their columns, that contain no item (see `find_items`)."""
    key, h = fresh(docs.columns, "id_found"), fresh(docs.columns, "text_found")
    found = find_items(docs, items, id_column, text_column, **options)
    found = stored(found.select(F.col(id_column).alias(key), F.col("text_hash").alias(h)).distinct(), "found")
    small = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    same = F.col(id_column).eqNullSafe(F.col(key)) & (F.xxhash64(text_column) == F.col(h))
    return docs.join(small, same, "left_anti")
