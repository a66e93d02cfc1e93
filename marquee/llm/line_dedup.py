"""Line de-duplication: lines that many documents share are dropped everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.common import SPACES, ascii_lower, fresh, stored


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """White space stripped at both ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _hash(line: Column) -> Column:
    return F.unhex(F.md5(line_key(line).cast("binary")))


def frequent_lines(docs: DataFrame, text_column: str, min_docs: int, min_length: int) -> DataFrame:
    """(h, n_docs): hashes of the keys of at least `min_length` code points in at least `min_docs` rows.

    Each row counts a key once (its lines are made distinct before they are exploded), so the count needs no distinct
    and is summed where the rows are read; a key that is in every row costs one row per task.
    """
    keys = F.array_distinct(F.transform(lines(F.col(text_column)), line_key))
    each = docs.select(F.explode(keys).alias("key")).where(F.length("key") >= min_length)
    counts = each.groupBy(F.unhex(F.md5(F.col("key").cast("binary"))).alias("h")).agg(F.count("*").alias("n_docs"))
    return counts.where(F.col("n_docs") >= min_docs)


def drop_repeated_lines(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_docs: int = 10, min_length: int = 1
) -> DataFrame:
    """`docs` with text_column replaced by the lines that stay, and n_lines, n_dropped (long) appended.

    A text is cut at newlines; null and the empty text are one empty line. A key (`line_key`) of at least `min_length`
    code points found in at least `min_docs` rows loses all its lines in all rows; the others stay in place, joined by
    newlines, and a document that loses all its lines becomes "". A row is a document: rows repeated count each, also
    with equal or null ids. Texts may be of any length and number of lines; a text is held in memory as a whole. An empty table stays empty. Columns of `docs` named n_lines or n_dropped are replaced.

    Lines are dealt out by hash as (hash, row key, position); the row key is the id and a hash of the text, so rows that
    cannot be told apart get the same positions. The list of frequent keys grows with the data, so it is joined by a
    shuffle whose skewed keys Spark splits; the texts are dealt once, by row key, to meet the positions they lose.
    """
    h, key = (fresh(docs.columns, x) for x in ("text_hash", "row_id"))
    tagged = docs.withColumn(key, F.col(id_column)).withColumn(h, F.xxhash64(F.col(text_column)))
    frequent = stored(frequent_lines(docs, text_column, min_docs, min_length), "lines")
    placed = tagged.select(
        F.col(key).alias("id"), F.col(h).alias("t"), F.posexplode(lines(F.col(text_column))).alias("pos", "line")
    ).select("id", "t", "pos", _hash(F.col("line")).alias("h"))
    lost = placed.join(frequent, "h", "left_semi").groupBy("id", "t").agg(F.collect_set("pos").alias("gone"))
    gone = fresh(tagged.columns, "gone")
    lost = lost.select(F.col("id").alias(key + "_r"), F.col("t").alias(h + "_r"), F.col("gone").alias(gone))
    met = tagged.join(lost, F.col(key).eqNullSafe(F.col(key + "_r")) & (F.col(h) == F.col(h + "_r")), "left")
    whole = lines(F.col(text_column))
    none = F.col(gone).isNull()
    places = F.array_except(F.sequence(F.lit(0), F.size(whole) - 1), F.col(gone))
    # bound once: a text is not split again for each line that stays
    kept = F.transform(F.array(whole), lambda w: F.transform(places, lambda i: F.get(w, i)))[0]
    shown = {
        "n_lines": F.size(whole).cast("long"),
        "n_dropped": F.when(none, 0).otherwise(F.size(gone)).cast("long"),
        text_column: F.when(none, F.coalesce(F.col(text_column), F.lit(""))).otherwise(F.array_join(kept, "\n")),
    }
    return met.select(
        *[shown[c].alias(c) if c in shown else F.col(c) for c in docs.columns],
        *[v.alias(c) for c, v in shown.items() if c not in docs.columns],
    )
