"""Exact n-gram Jaccard join: position-skipping prefix index, and answers taken over from highly similar sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.llm.common import SPACES, fresh, small_batches, stored
from marquee.llm.components import components
from marquee.llm.shingles import Hasher

PERCENT = 80
#: Shingles in at least OFTEN of the counted places are put last in the order of the index, FREQUENT of them at most;
#: the lists of such a shingle are cut into PARTS.
OFTEN = 6
FREQUENT = 200_000
PARTS = 64
#: Shingles of a bucket when they are counted.
BUCKET = 250_000
#: In rounds before all pairs that are left are formed, a set meets so many random others of each of its lists.
PARTNERS = (1, 5)
#: Up to so many ids are broadcast to find their texts; more are joined by a shuffle.
BROADCAST_IDS = 200_000


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=32).digest()


def describe(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, text_hash, n, digest) of every row's shingle set."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            made = [(len(x), _digest(x)) for x in hasher.sets(batch.column("t"))]
            sizes, digests = pa.array([x[0] for x in made], pa.int64()), pa.array([x[1] for x in made], pa.binary())
            kept = [batch.column("id"), batch.column("text_hash")]
            yield pa.RecordBatch.from_arrays([*kept, sizes, digests], names=["id", "text_hash", "n", "digest"])

    text = F.coalesce(text_column, F.lit(""))
    read = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("text_hash"), text.alias("t"))
    kind = docs.schema[id_column].dataType.simpleString()
    return read.mapInArrow(sets, f"id {kind}, text_hash long, n long, digest binary")


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def frequent_shingles(docs: DataFrame, text_column: str, total: int, percent: int, most: int) -> tuple[np.ndarray, int]:
    """Leading bits of frequent shingle hashes, rarest first, and by how many bits a hash is shifted for them.

    Each task packs the smaller hashes of its distinct sets (half as many again as a prefix holds), and of the others
    those it has seen twice, into buckets by their first bits, five bytes each; a bucket is then counted as one array. The `most` most frequent ones are the result,
    those with equal counts by value; they decide the order of the index only, never what is found.
    """
    bits = max(8, (max(1, total * (100 - percent) * 3 // 200) // BUCKET).bit_length())
    shift = 64 - bits - 40

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, low, high, held = Hasher(), set(), [], [], 0
        for batch in batches:
            for values in hasher.sets(batch.column("t")):
                digest = _digest(values)
                if len(values) and digest not in seen:
                    seen.add(digest)
                    cut = _prefix(len(values), percent) * 3 // 2
                    low.append(values[:cut])
                    high.append(values[cut:])
                    held += len(values)
                    if held > 500_000:
                        yield packed(low, high)
                        low, high, held = [], [], 0
        if held:
            yield packed(low, high)

    def packed(low: list[np.ndarray], high: list[np.ndarray]) -> pa.RecordBatch:
        others, times = np.unique(np.concatenate(high), return_counts=True)
        repeated = np.repeat(others[times > 1], times[times > 1])
        values = np.sort(np.concatenate([*low, repeated])) >> np.uint64(shift)
        bucket = (values >> np.uint64(40)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        raw = values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:]
        blobs = [raw[i:j].tobytes() for i, j in zip(starts, [*starts[1:], len(values)])]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def count(key: tuple, table: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(table.column("blob").to_pylist()), dtype=np.uint8).reshape(-1, 5)
        wide = np.zeros((len(raw), 8), dtype=np.uint8)
        wide[:, 3:] = raw
        values, times = np.unique(wide.view(">u8").ravel().astype(np.int64), return_counts=True)
        often = times >= OFTEN
        return pa.table({"value": values[often] + (key[0].as_py() << 40), "times": times[often]})

    packs = docs.select(F.coalesce(text_column, F.lit("")).alias("t")).mapInArrow(pack, "bucket long, blob binary")
    counted = packs.groupBy("bucket").applyInArrow(count, "value long, times long")
    top = counted.orderBy(F.desc("times"), "value").limit(most).collect()
    return np.array([r.value for r in top][::-1], dtype=np.int64).view(np.uint64), shift


def _sid(digest: Column, part: int) -> Column:
    return F.conv(F.hex(F.substring(digest, 8 * part + 1, 8)), 16, -10).cast("long")


def postings(docs: DataFrame, text_column: str, frequent: np.ndarray, shift: int, part: int, percent: int) -> DataFrame:
    """(token, sid, n, pos, often): the prefix of each set under the order of the index, once a task for equal sets.

    Rare shingles come first, by hash; then the frequent ones, rarer before. Two sets of at least the similarity asked
    for share a shingle among the first n - ceil(percent % of n) + 1 of either.
    """
    order = np.argsort(frequent, kind="stable")
    known = frequent[order]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = Hasher(), set()
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            held = 0
            for values in hasher.sets(batch.column("t")):
                n = len(values)
                if not n:
                    continue
                digest = _digest(values)
                if digest in seen:
                    continue
                seen.add(digest)
                length = _prefix(n, percent)
                heads = values >> np.uint64(shift)
                places = np.searchsorted(known, heads)
                places[places == len(known)] = 0
                often = known[places] == heads if len(known) else np.zeros(n, dtype=bool)
                rare = values[~often][:length]
                tail = values[often][np.argsort(order[places[often]], kind="stable")][: length - len(rare)]
                prefix = np.concatenate([rare, tail])
                sid = int.from_bytes(digest[8 * part : 8 * part + 8], "big", signed=True)
                for column, made in zip(
                    out,
                    (prefix.view(np.int64), np.full(len(prefix), sid), np.full(len(prefix), n, dtype=np.int32),
                     np.arange(len(prefix), dtype=np.int32), np.arange(len(prefix)) >= len(rare)),
                ):
                    column.append(made)
                held += len(prefix)
                if held > 200_000:
                    yield _batch(out)
                    out, held = [[], [], [], [], []], 0
            if held:
                yield _batch(out)

    def _batch(columns):
        arrays = [pa.array(np.concatenate(c)) for c in columns]
        return pa.RecordBatch.from_arrays(arrays, names=["token", "sid", "n", "pos", "often"])

    read = docs.select(F.coalesce(text_column, F.lit("")).alias("t"))
    return read.mapInArrow(prefixes, "token long, sid long, n int, pos int, often boolean")


def _may_link(percent: int, first: bool) -> Column:
    """Whether sizes and positions of l and r leave room for the overlap asked.

    With `first` the shared shingle is taken for their first in common, as some shared one is for every pair; otherwise
    those before it may be shared as well.
    """
    n, m, at, to = F.col("l.n"), F.col("r.n"), F.col("l.pos"), F.col("r.pos")
    close = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    room = F.least(n - at, m - to) + (F.lit(0) if first else F.least(at, to))
    return close & (room * (100 + percent) >= (n + m) * percent)


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, id_column: str, text_column: str, part: int, percent: int) -> DataFrame:
    """The pairs (a, b) of sets whose similarity reaches `percent`, computed on the whole sets; repeats are possible."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    holders = stored(classes.join(asked, "sid").select(F.col("holder").alias("id_")).distinct(), "holders")
    if holders.count() <= BROADCAST_IDS:
        holders = F.broadcast(holders)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                made = [x for x in hasher.sets(whole.slice(start, 500).column("t")) if len(x)]
                sids = [int.from_bytes(_digest(x)[8 * part : 8 * part + 8], "big", signed=True) for x in made]
                tokens = pa.array([x.view(np.int64) for x in made], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), tokens], names=["sid", "tokens"])

    read = docs.select(F.col(id_column).alias("id"), F.coalesce(text_column, F.lit("")).alias("t"))
    held = read.join(holders, F.col("id").eqNullSafe(F.col("id_")), "left_semi").select("t")
    found = held.mapInArrow(sets, "sid long, tokens array<long>")
    left, right = (found.select(F.col("sid").alias(c), F.col("tokens").alias(f"of_{c}")) for c in "ab")
    met = pairs.join(left, "a").join(right, "b").withColumn("shared", F.size(F.array_intersect("of_a", "of_b")))
    union = F.size("of_a") + F.size("of_b") - F.col("shared")
    return met.where(F.col("shared") * 100 >= union * percent).select("a", "b")


def _ordered(met: DataFrame) -> DataFrame:
    return met.select(F.least("l.sid", "r.sid").alias("a"), F.greatest("l.sid", "r.sid").alias("b")).where("a <> b").distinct()


def _mixed_lists(index: DataFrame, roots: DataFrame) -> DataFrame:
    """The lists of more than one component, each with its `main` one, which has most entries."""
    placed = index.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    shares = placed.groupBy("token", "root").agg(F.count("*").alias("c"))
    mixed = shares.groupBy("token").agg(F.count("*").alias("roots"), F.max(F.struct("c", "root")).alias("m"))
    return placed.join(mixed.where("roots > 1").select("token", F.col("m.root").alias("main")), "token")


def join_classes(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT, frequent: int = FREQUENT
) -> DataFrame:
    """(id, n_shingles, component_id, text_hash), one row per row of `docs`.

    A row's set are the distinct runs of five words (A-Z lower-cased, cut at white space); all words if there are fewer;
    empty without words or text. Two rows link if their sets' intersection is at least `percent` % of the union, exactly;
    an empty set links with nothing. component_id is the smallest id that links lead to, the row's own included. Null
    ids are never the smallest unless there is no other; rows repeated are in one component; an empty table gives an
    empty result; other columns are ignored. Whole texts count; shingles are compared by 64-bit hashes.

    Equal sets are one node. The prefixes of all sets form an index: a list of (set, size, position) per shingle. Pairs
    are skipped whose sizes, or positions in a list, leave too few shingles for the overlap asked. In the first rounds a
    set is compared with a few random others of each of its lists only. Where two are found to be highly similar, one takes
    over what the other is connected with; lists that one component fills are skipped, and then only pairs of different
    components that share a list are left. The component that fills most of a list is never paired with itself, so a
    large group of near copies costs as many comparisons as members, not as pairs. Nothing is capped: the last round
    forms all pairs that are left.
    """
    small_batches(docs)
    rows = stored(describe(docs, id_column, text_column), "sets")
    part = 0
    while True:  # four independent 8-byte names for the sets; at 10**10 sets one of them might not be unique
        named = rows.select("digest", _sid(F.col("digest"), part).alias("sid")).distinct()
        if named.groupBy("sid").count().where("count > 1").isEmpty():
            break
        part += 1
    rows = rows.withColumn("sid", _sid(F.col("digest"), part)).drop("digest")
    classes = stored(
        rows.where("n > 0").groupBy("sid").agg(F.min("id").alias("holder"), F.max("n").alias("n")), "classes"
    )
    total = classes.agg(F.sum("n")).first()[0] or 0
    often, shift = frequent_shingles(docs, text_column, total, percent, frequent)
    index = postings(docs, text_column, often, shift, part, percent)
    # lists of one set are dropped; those of frequent shingles are cut into parts and kept
    lists = Window.partitionBy("token", "part")
    spread = F.when(F.col("often"), F.pmod(F.xxhash64("sid", "token"), F.lit(PARTS))).otherwise(0).cast("int")
    index = index.withColumn("part", spread).withColumn("low", F.min("sid").over(lists)).withColumn("high", F.max("sid").over(lists))
    index = stored(index.where("often or low < high").select("token", "part", "sid", "n", "pos"), "index")

    check = lambda pairs: verified(pairs, docs, classes, id_column, text_column, part, percent)
    mine = F.struct("sid", "n", "pos", "root")
    tried, roots, placed = None, None, index.withColumn("root", F.col("sid"))
    for turn, partners in enumerate(PARTNERS):
        lists = Window.partitionBy("token", "part").orderBy(F.xxhash64(F.lit(turn), "token", "sid"), "sid")
        others = F.array(*[F.lead(mine, k + 1).over(lists) for k in range(partners)])
        met = placed.select("token", mine.alias("l"), others.alias("others")).select(
            "l", F.explode(F.filter("others", lambda r: r["root"] != F.col("l.root"))).alias("r")
        )
        pairs = _ordered(met.where(_may_link(percent, first=False)))
        pairs = stored(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = check(pairs)
        if roots is not None:
            links = links.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = stored(components(links), "roots")
        placed = stored(_mixed_lists(index, roots), "mixed")
    rest = placed.where("root <> main").alias("l").join(placed.alias("r"), "token")
    rest = rest.where("l.root <> r.root and (r.root = r.main or l.sid < r.sid)").where(_may_link(percent, first=True))
    pairs = stored(_ordered(rest).join(tried, ["a", "b"], "left_anti"), "pairs")
    links = check(pairs).unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
    whole = stored(components(links), "roots")

    placed = classes.join(whole.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = placed.groupBy("root").agg(F.min("holder").alias("component_id"))
    of = placed.join(least, "root").select("sid", "component_id")
    return rows.join(of, "sid", "left").select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        "text_hash",
    )


def drop_near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT
) -> DataFrame:
    """The rows of `docs`, with all their columns, but for those that link to a row of a smaller id (see `join_classes`).

    Of each component the row with the smallest id stays; of rows that repeat both its id and its text, one. Rows
    without words all stay, as they link with nothing.
    """
    classes = stored(join_classes(docs, id_column, text_column, percent), "classes")
    key, h = fresh(docs.columns, "id_lost"), fresh(docs.columns, "text_lost")
    lost = classes.where(~F.col(id_column).eqNullSafe(F.col("component_id")))
    lost = stored(lost.select(F.col(id_column).alias(key), F.col("text_hash").alias(h)).distinct(), "lost")
    small = F.broadcast(lost) if lost.count() <= BROADCAST_IDS else lost
    same = F.col(id_column).eqNullSafe(F.col(key)) & (F.xxhash64(text_column) == F.col(h))
    kept = docs.join(small, same, "left_anti")
    worded = classes.where("n_shingles > 0")
    if worded.groupBy(id_column, "text_hash").count().where("count > 1").isEmpty():
        return kept
    blank = F.btrim(F.coalesce(text_column, F.lit("")), F.lit(SPACES)) == ""
    return kept.where(~blank).dropDuplicates([id_column, text_column]).unionByName(kept.where(blank))
