"""Rule checks over tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee import fixed_values as V
from marquee.functions.text import is_blank, quality_flags
from marquee.operators.anchored import anchored_windows


def invalid_ratings(comments: DataFrame) -> DataFrame:
    return comments.filter(~F.col("rated").between(V.MIN_RATING, V.MAX_RATING))


def invalid_halls(halls: DataFrame) -> DataFrame:
    """Halls whose name looks like SQL or is another's too, or with fewer than MIN_HALL_SIDE rows or columns."""
    names = halls.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    reason = (
        F.when(F.col("name").rlike(V.SQL_PATTERN), V.HALL_BAD_NAME)
        .when(F.col("_n") > 1, V.HALL_EXISTS)
        .when(F.least("total_row", "total_col") < V.MIN_HALL_SIDE, V.HALL_TOO_SMALL)
    )
    return halls.join(names, "name", "left").withColumn("reason", reason).drop("_n").filter("reason IS NOT NULL")


def duplicate_keys(keys: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(kind, key, n) for every value of a column that should be unique and is not."""
    counted = [
        df.groupBy(F.col(column).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
            F.lit(kind).alias("kind"), "key", "n"
        )
        for kind, (df, column) in keys.items()
    ]
    return reduce(DataFrame.unionByName, counted)


def missing_fields(df: DataFrame, required: list[str]) -> DataFrame:
    """Rows with the list of required fields that are null or, for text, blank."""
    kinds = dict(df.dtypes)
    blank = [
        F.when(is_blank(F.col(c)) if kinds[c] == "string" else F.col(c).isNull(), F.lit(c)) for c in required
    ]
    return df.withColumn("missing", F.array_compact(F.array(*blank))).filter(F.size("missing") > 0)


def text_flags(df: DataFrame, column: str) -> DataFrame:
    return df.withColumns(quality_flags(F.col(column)))


def login_throttle(
    attempts: DataFrame, limit: int = V.LOGIN_LIMIT, seconds: int = V.LOGIN_SECONDS, **chunking
) -> DataFrame:
    """Attempts with their number in the window the first of them opened, and whether that is over the limit."""
    placed = anchored_windows(attempts, "login_key", "ts", "attempt_id", seconds * 1_000_000, "attempt_no", **chunking)
    return placed.withColumn("rejected", F.col("attempt_no") > limit)
