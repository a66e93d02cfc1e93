"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from marquee.llm.common import fresh, n_words, stored

#: Weights of the sources in code-point order, null last, repeating; repeats a document may have; slots of a schedule.
WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SLOTS = 1 << 17
#: Chunks in which a source's slots are ranked. Its documents are laid end to end in 4096, by three hex digits of a hash.
CHUNKS = 1024
#: The fractional part of the golden ratio, in units of 2 ** -32, so that points are exact whole numbers.
GOLDEN = 2654435769
UNIT = 1 << 32
#: A mixture names its sources; more than this is a mistake in the source column.
MOST_SOURCES = 100_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> list[tuple[float, int]]:
    """(target, whole words) for each source: all sizes shared by weight, none above `most` times its own size.

    What the capped sources leave is shared again by weight among the others until none is above its cap.
    """
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out: dict[int, tuple[float, int]] = {}
    left = sum(sizes)
    while True:
        free = [i for i in range(len(sizes)) if i not in out]
        shares = sum(weight[i] for i in free)
        above = [i for i in free if left * weight[i] > most * sizes[i] * shares]
        if not above:
            return [out.get(i) or (left * weight[i] / shares, left * weight[i] // shares) for i in range(len(sizes))]
        for i in above:
            out[i] = (float(most * sizes[i]), most * sizes[i])
        left -= sum(out[i][1] for i in above)


def _laid_out(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    """(id, source, size, text_hash, start): each source's documents end to end, in the order of their hashes."""
    mixed = F.md5(F.concat_ws("/", F.lit("mix"), F.col(id_column).cast("string")).cast("binary"))
    rows = stored(
        docs.select(
            F.col(id_column).alias("id"),
            F.col(source_column).alias("source"),
            n_words(F.col(text_column)).alias("size"),
            mixed.alias("h"),
            F.xxhash64(text_column).alias("text_hash"),
        ).withColumn("chunk", F.conv(F.substring("h", 1, 3), 16, 10).cast("int")),
        "sizes",
    )
    key = [F.col("source"), F.col("chunk")]
    inside = Window.partitionBy(*key).orderBy("h", "id", "size", "text_hash")
    ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*key).agg(F.sum("size").alias("sum"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base")
    )
    placed = rows.withColumn("ahead", F.coalesce(F.sum("size").over(ahead), F.lit(0)))
    met = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("chunk") == F.col("c")))
    return met.select("id", "source", "size", "text_hash", (F.col("base") + F.col("ahead")).alias("start"))


def schedule(spark, plan: list[dict], slots: int) -> DataFrame:
    """(slot, src, rank): which source each slot of the mixture draws from, and its how-manieth draw that is.

    Slot i holds the point i * golden ratio modulo 1; the sources' cumulative targets cut the unit interval. However
    far the mixture is read, each source is within a few blocks of its share. Draws that a source is still short of
    after the last point (a few blocks, by the points' discrepancy) follow at the end; draws beyond its target go.
    """
    total = sum(p["words"] for p in plan)
    ends, sofar = [], 0
    for p in plan:
        sofar += p["words"]
        ends.append(sofar * UNIT // total if total else 0)
    bounds = spark.createDataFrame(
        [(p["src"], ends[i - 1] if i else 0, ends[i], p["draws"]) for i, p in enumerate(plan)],
        "src int, low long, high long, draws long",
    )
    points = spark.range(slots).withColumn("point", F.pmod(F.col("id") * GOLDEN, F.lit(UNIT)))
    if len(plan) <= 64:
        src = F.lit(None).cast("int")
        for p, low, high in zip(plan, [0, *ends], ends):
            src = F.when((F.col("point") >= low) & (F.col("point") < high), F.lit(p["src"])).otherwise(src)
        drawn = points.withColumn("src", src).where(F.col("src").isNotNull())
    else:
        cut = F.broadcast(bounds.where("high > low"))  # at most MOST_SOURCES rows
        cell = F.shiftright("point", 16)
        cells = cut.withColumn("cell", F.explode(F.sequence(F.shiftright("low", 16), F.shiftright(F.col("high") - 1, 16))))
        drawn = points.withColumn("cell", cell).join(F.broadcast(cells), "cell").where("point >= low and point < high")
    drawn = drawn.select(F.col("id").alias("slot"), "src", F.floor(F.col("id") / F.lit(max(1, slots // CHUNKS))).alias("chunk"))
    counts = drawn.groupBy("src", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("src", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("src", "chunk").orderBy("slot")
    ranked = drawn.withColumn("place", F.row_number().over(inside) - 1).join(base, ["src", "chunk"])
    ranked = ranked.select("slot", "src", (F.col("base") + F.col("place")).alias("rank"))
    ranked = ranked.join(F.broadcast(bounds.select("src", "draws")), "src").where("rank < draws").drop("draws")
    have = counts.groupBy("src").agg(F.sum("n").alias("have"))
    short = bounds.join(F.broadcast(have), "src", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < draws")
    extra = short.select("src", F.explode(F.sequence("have", F.col("draws") - 1)).alias("rank"))
    return ranked.unionByName(extra.select((F.lit(slots) + F.col("rank")).alias("slot"), "src", "rank"))


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_REPEATS,
    slots: int = SLOTS,
) -> tuple[DataFrame, DataFrame]:
    """The mixture, and what it takes of each row.

    First: (slot, source, block, epoch, first_word, n_words): the blocks of the mixture in reading order. A block is
    n_words words of its source's stream (its documents end to end in hash order, repeated) from `first_word` of the
    stream's current pass on; blocks are equal but for the last of a pass and the last of a target.
    Second: (id, size, source_size, target, taken, text_hash), one row per row of `docs`: its words, its source's words, what the
    mixture should take of the source and what it takes of the row, repeats counted.

    Sources are ordered by code point, null (a source like others) last; they weigh `weights`, repeating, and share the
    sum of all sizes, none more than `most` times its own. A document whose text is null, empty or white space has no
    words and none is taken; a long one is spread over many blocks. Rows repeated, also with equal or null ids, are
    documents of their own. An empty table gives empty results; other columns are ignored.

    A block has 1 / slots of all words, so the schedule is as long for any input; documents meet the blocks they
    overlap in a join on (source, block). More than MOST_SOURCES sources raise an error: their list is on the driver.
    """
    spark = docs.sparkSession
    laid = stored(_laid_out(docs, id_column, text_column, source_column), "laid")
    totals = laid.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    totals.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    block = max(1, -(-sum(r.size for r in totals) // slots))
    plan = []
    for i, (r, (target, words)) in enumerate(zip(totals, targets([r.size for r in totals], weights, most))):
        a_pass = -(-r.size // block)
        full, part = divmod(words, r.size) if r.size else (0, 0)
        plan.append(
            {"src": i, "source": r.source, "size": r.size, "target": target, "words": words, "a_pass": a_pass,
             "draws": full * a_pass + -(-part // block)}
        )
    known = T.StructType.fromDDL(
        "src int, name string, source_size long, target double, words long, a_pass long, draws long"
    )
    named = F.broadcast(
        spark.createDataFrame(
            [(p["src"], p["source"], p["size"], p["target"], p["words"], p["a_pass"], p["draws"]) for p in plan], known
        )
    )
    drawn = schedule(spark, plan, slots).join(named, "src")
    epoch, number = F.floor(F.col("rank") / F.col("a_pass")), F.col("rank") % F.col("a_pass")
    first = number * block
    size = F.least(F.lit(block), F.col("source_size") - first, F.col("words") - epoch * F.col("source_size") - first)
    blocks = stored(
        drawn.select(
            "slot", "src", F.col("name").alias("source"), number.alias("block"), epoch.alias("epoch"),
            first.alias("first_word"), size.alias("n_words"),
        ),
        "schedule",
    )
    rows = laid.join(named, F.col("source").eqNullSafe(F.col("name")))
    last = F.col("start") + F.col("size") - 1
    pieces = rows.where("size > 0").select(
        "src", "id", "start", "size",
        F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(last / block))).alias("block"),
    )
    # a block is taken once in each full pass and perhaps cut in the last: at most `most` lengths for each
    lengths = blocks.groupBy("src", "block").agg(F.collect_list("n_words").alias("lengths"))
    low = F.greatest(F.col("start"), F.col("block") * block)
    overlap = lambda n: F.greatest(
        F.lit(0), F.least(F.col("start") + F.col("size"), F.col("block") * block + n) - low
    )
    met = pieces.join(lengths, ["src", "block"]).withColumn(
        "words", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + overlap(n))
    )
    taken = met.groupBy(F.col("src").alias("s"), F.col("start").alias("at")).agg(F.sum("words").alias("taken"))
    # a start belongs to one row with words; rows without words take none
    out = rows.join(taken, (F.col("src") == F.col("s")) & (F.col("start") == F.col("at")) & (F.col("size") > 0), "left")
    return blocks.drop("src"), out.select(
        F.col("id").alias(id_column), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"),
        "text_hash",
    )


def mixed_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The mixture in whole documents: each row of `docs` ceil(taken / size) times (see `mix`), 0 to `most` of them.

    A row without words stays once, as it takes no room. Rows that repeat both id and text get the same number each.
    """
    key, h, n = (fresh(docs.columns, x) for x in ("id_mixed", "text_mixed", "copies"))
    taken = mix(docs, id_column, text_column, **options)[1]
    times = F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.col("taken") / F.col("size"))).cast("int")
    copies = taken.groupBy(F.col(id_column).alias(key), F.col("text_hash").alias(h)).agg(F.max(times).alias(n))
    same = F.col(id_column).eqNullSafe(F.col(key)) & (F.xxhash64(text_column) == F.col(h))
    met = docs.join(copies.where(F.col(n) > 0), same)
    return met.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(docs.columns)
