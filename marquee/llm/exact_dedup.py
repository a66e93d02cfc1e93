"""Exact de-duplication: frequent digests are settled by a small broadcast table, the rest by an ordinary shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import ascii_lower, fresh, stored

#: A digest in at least this share of the rows counts as frequent; so there are at most 1 / SUPPORT of them.
SUPPORT = 0.001


def text_digest(text: Column) -> Column:
    """SHA-256 (lower-case hex) of the text with A-Z lower-cased; null counts as empty."""
    return F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256)


def _verdicts(digests: DataFrame) -> DataFrame:
    return digests.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))


def frequent_winners(digests: DataFrame, support: float = SUPPORT) -> DataFrame:
    """(digest, keep_id, group_size) of the digests that really reach `support`: at most 1 / support rows.

    The candidates come from Spark's frequent-items aggregate, a Misra-Gries summary of 1 / support counters that is
    merged from the partitions' summaries; it may name rare digests, so each candidate is counted exactly.
    """
    least = digests.count() * support
    named = digests.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest")).distinct()
    return _verdicts(digests.join(F.broadcast(named), "digest")).where(F.col("group_size") >= least)


def mark_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", support: float = SUPPORT
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row per row of `docs`.

    Texts are equal if they are identical after lower-casing A-Z; null is the empty text. Of equal texts the largest
    id stays. An id that is null loses to any other; in a group of null ids alone, keep_id is null and all rows are
    kept = true. Rows repeating both id and text are the same document: all of them count in group_size and carry the
    same verdict (`drop_duplicates` leaves one). An empty table gives an empty result; other columns are ignored.
    Only ids and digests are shuffled, never texts, so these may be of any length.
    """
    digests = stored(docs.select(F.col(id_column).alias("id"), text_digest(F.col(text_column)).alias("digest")), "digests")
    winners = F.broadcast(stored(frequent_winners(digests, support), "winners"))
    frequent = digests.join(winners, "digest")
    others = digests.join(winners, "digest", "left_anti")
    rest = others.join(_verdicts(others), "digest")
    columns = ["id", "keep_id", "group_size", "digest"]
    both = frequent.select(columns).unionByName(rest.select(columns))
    return both.select(
        F.col("id").alias(id_column),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", support: float = SUPPORT
) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one row for each text, by the rules of `mark_duplicates`.

    Losers of frequent digests are removed where they are read, by the broadcast winners; only the others are shuffled,
    to meet their winner. Where rows repeat both id and text, one more shuffle leaves one of them.
    """
    digest, winner, hot = (fresh(docs.columns, x) for x in ("digest", "winner_id", "hot"))
    keyed = docs.withColumn(digest, text_digest(F.col(text_column)))
    digests = stored(keyed.select(F.col(id_column).alias("id"), F.col(digest).alias("digest")), "digests")
    frequent = stored(frequent_winners(digests, support), "winners")
    cold = _verdicts(digests.join(F.broadcast(frequent), "digest", "left_anti"))
    named = lambda t: t.select(F.col("digest").alias(digest), F.col("keep_id").alias(winner))
    wins = F.col(id_column).eqNullSafe(F.col(winner))
    seen = keyed.join(F.broadcast(named(frequent).withColumn(hot, F.lit(True))), digest, "left")
    settled = seen.where(F.col(hot) & wins).select(docs.columns + [digest])
    shuffled = seen.where(F.col(hot).isNull()).drop(winner).join(named(cold), digest).where(wins)
    kept = settled.unionByName(shuffled.select(docs.columns + [digest]))
    twins = digests.groupBy("digest", "id").count().where("count > 1")
    return (kept if twins.isEmpty() else kept.dropDuplicates([digest])).select(docs.columns)
