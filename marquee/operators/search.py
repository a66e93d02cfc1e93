"""Substring search through an index of three-letter pieces, and pages that are read where they start."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.text import fold_accents
from marquee.operators.skew import BROADCAST_KEYS
from marquee.session import materialize, stored

PIECE = 3
#: Lists that are intersected for a keyword: those of its rarest pieces; the text itself decides in the end.
LISTS = 3
SHARDS = 64


def pieces(text: Column, size: int = PIECE) -> Column:
    """The distinct pieces of a text, accents and case folded; none where it is shorter than one."""
    folded = fold_accents(text)
    cut = F.transform(F.sequence(F.lit(1), F.length(folded) - (size - 1)), lambda i: F.substring(folded, i, size))
    return F.when(F.length(folded) >= size, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def _shard(piece: Column) -> Column:
    return F.pmod(F.xxhash64(piece), F.lit(SHARDS)).cast("int")


def build_index(df: DataFrame, key: str, column: str, path: str) -> None:
    """Write the lists (piece, key) by shard, and how long each list is, to `path`.

    Lists are cut by ranges of piece and key, so a piece that most texts have is spread over files like any other rows.
    """
    lists = df.select(F.explode(pieces(F.col(column))).alias("piece"), F.col(key).alias("key"))
    lists = lists.withColumn("shard", _shard(F.col("piece")))
    ordered = lists.repartitionByRange("shard", "piece", "key").sortWithinPartitions("shard", "piece", "key")
    ordered.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/lists")
    sizes = df.sparkSession.read.parquet(f"{path}/lists").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    sizes.withColumn("shard", _shard(F.col("piece"))).write.mode("overwrite").partitionBy("shard").parquet(f"{path}/sizes")


def _indexable(keyword: Column) -> Column:
    # the one letter whose lower case depends on its neighbours
    return (F.length(fold_accents(keyword)) >= PIECE) & ~F.contains(keyword, F.lit("Σ"))


def holds(text: Column, keyword: Column, mode: str) -> Column:
    """The exact test: `as_is` sees case and accents, `case` only accents, `folded` neither."""
    if mode == "as_is":
        return F.contains(text, keyword)
    if mode == "case":
        return F.contains(F.lower(text), F.lower(keyword))
    return F.contains(fold_accents(text), fold_accents(keyword))


def search(df: DataFrame, key: str, column: str, path: str, keyword: str, mode: str = "folded") -> DataFrame:
    """Rows of `df` whose text holds the keyword, by the index at `path`; short keywords by a scan.

    Pieces and shards of the keyword are literals, so only files of its lists are opened and filters reach them.
    """
    spark = df.sparkSession
    exact = df.filter(holds(F.col(column), F.lit(keyword), mode))
    one = spark.range(1).select(pieces(F.lit(keyword)).alias("p"), _indexable(F.lit(keyword)).alias("ok"))
    found = one.select("p", "ok", F.transform("p", _shard).alias("s")).first()
    if not found.ok:
        return exact
    wanted = F.col("piece").isin(found.p) & F.col("shard").isin(sorted(set(found.s)))
    rarest = spark.read.parquet(f"{path}/sizes").filter(wanted).orderBy("n", "piece").limit(LISTS)
    chosen = rarest.agg(F.collect_list("piece")).first()[0]  # at most LISTS pieces
    if len(chosen) < min(LISTS, len(found.p)):
        return exact.limit(0)  # a piece that no text has
    shards = sorted({s for p, s in zip(found.p, found.s) if p in chosen})
    lists = spark.read.parquet(f"{path}/lists").filter(F.col("shard").isin(shards) & F.col("piece").isin(chosen))
    met = lists.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(chosen))
    return exact.join(met.select(F.col("key").alias(key)), key, "left_semi")


def search_all(df: DataFrame, key: str, column: str, path: str, keywords: DataFrame, mode: str = "folded") -> DataFrame:
    """(keyword, key): every row of `df` for every distinct keyword of the table `keywords` its text holds.

    A keyword meets the lists of its rarest pieces, is in question where all of them have a row, and is then looked for
    in the text. Keywords shorter than a piece meet the letters and pairs of letters of all texts.

    Files say little about the size of lists, texts and their letters (they pack well, and exploded rows are not counted), so
    none of these is ever broadcast; short keywords are where they were counted to be few.
    """
    spark = df.sparkSession
    asked = keywords.select("keyword").filter("keyword IS NOT NULL").distinct().withColumn("_ok", _indexable(F.col("keyword")))
    asked = stored(asked, "keywords")
    cut = asked.filter("_ok").select("keyword", F.explode(pieces(F.col("keyword"))).alias("piece"))
    sizes = spark.read.parquet(f"{path}/sizes").select("piece", "n").hint("merge")
    order = Window.partitionBy("keyword").orderBy(F.col("n").asc_nulls_first(), "piece")
    ranked = cut.join(sizes, "piece", "left").withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= LISTS)
    whole = Window.partitionBy("keyword")
    chosen = ranked.withColumn("_all", F.count(F.lit(1)).over(whole)).withColumn("_met", F.count("n").over(whole))
    chosen = chosen.filter("_all = _met").select("keyword", "piece", "_all")
    lists = spark.read.parquet(f"{path}/lists").select("piece", "key")
    near = (
        lists.hint("merge").join(chosen, "piece")
        .groupBy("keyword", F.col("key").alias(key))
        .agg(F.count(F.lit(1)).alias("_n"), F.first("_all").alias("_all"))
        .filter("_n = _all")
        .select("keyword", key)
    )
    texts = df.select(key, F.col(column).alias("_text"))
    test = holds(F.col("_text"), F.col("keyword"), mode)
    found = near.join(texts.hint("merge"), key).filter(test).select("keyword", key)
    folded = fold_accents(F.col("keyword"))
    whole_piece = F.when((F.length(folded) < PIECE) & ~F.contains("keyword", F.lit("Σ")), folded).otherwise("")
    short = asked.filter("NOT _ok").select("keyword", whole_piece.alias("_piece"))
    little = F.concat(F.array(F.lit("")), *[pieces(F.col("_text"), n) for n in range(1, PIECE)])
    letters = texts.filter("_text IS NOT NULL").withColumn("_piece", F.explode(little))
    if short.count() <= BROADCAST_KEYS:
        short = F.broadcast(short)
    else:
        letters = letters.hint("merge")
    return found.unionByName(letters.join(short, "_piece").filter(test).select("keyword", key))


# -- pages --------------------------------------------------------------------


def page_starts(df: DataFrame, key: str, size: int) -> DataFrame:
    """(page, first, n): the key each page of `size` rows starts with, in order of the distinct `key`, counted from 0.

    Keys are sorted by ranges; a range's rows start after those of the ranges before it, which takes one number per
    range. So no row is numbered in one place, and a page is found without passing over those before it.
    """
    keys = df.select(F.col(key).alias("first")).repartitionByRange("first").sortWithinPartitions("first")
    placed = materialize(
        keys.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    ranges = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    number = F.col("_before") + F.col("_at")
    paged = placed.join(F.broadcast(ranges), "_part").withColumn("page", F.floor(number / size))
    return paged.groupBy("page").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n"))


def page_at(df: DataFrame, key: str, starts: DataFrame, number: int) -> DataFrame:
    """The rows of a page, read by the range of its keys; `starts` is the stored table of `page_starts`."""
    near = starts.filter(F.col("page").isin(number, number + 1)).agg(
        F.max(F.when(F.col("page") == number, F.col("first"))).alias("low"),
        F.max(F.when(F.col("page") == number + 1, F.col("first"))).alias("high"),
    )
    low, high = near.first()
    if low is None:
        return df.limit(0)
    rows = df.filter(F.col(key) >= F.lit(low))
    return (rows if high is None else rows.filter(F.col(key) < F.lit(high))).orderBy(key)
