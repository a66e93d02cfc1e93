"""Seats of shows as bits: per show and status a few 64-bit words, from which counts and full shows are read.

A seat's place in its hall is row * width + column; word w holds places 64 w to 64 w + 63. A show of n seats takes at
most one word per 64 seats and status, whatever tables of one row per seat would take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many halls, of which two numbers are needed, are broadcast; more are joined by a shuffle.
BROADCAST_HALLS = 1_000_000


def _place(width: Column) -> Column:
    return F.col("row_index") * width + F.col("col_index")


def _few(halls: DataFrame) -> DataFrame:
    return F.broadcast(halls) if halls.count() <= BROADCAST_HALLS else halls


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))


def seat_words(show_seats: DataFrame, halls: DataFrame) -> DataFrame:
    """(show_id, hall_id, status, word, bits) of a table of seats; combined where the rows are read."""
    place = _place(F.col("total_col"))
    rows = show_seats.join(_few(halls.select("hall_id", "total_col")), "hall_id").select(
        "show_id", "hall_id", "status", F.floor(place / 64).cast("int").alias("word"), _bit(place).alias("bit")
    )
    return rows.groupBy("show_id", "hall_id", "status", "word").agg(F.bit_or("bit").alias("bits"))


def moved(words: DataFrame, changes: DataFrame, halls: DataFrame) -> DataFrame:
    """Words after changes (show_id, row_index, col_index, new_status): a seat leaves the status it had for the new one.

    Of several changes of a seat the greatest status counts. Changes of seats that a show does not have change nothing.
    Words and changes meet once, as the short lists of a show, and what a show becomes is worked out where they met.
    """
    had = words.groupBy("show_id").agg(F.collect_list(F.struct("hall_id", "word", "status", "bits")).alias("_words"))
    wanted = changes.groupBy("show_id", "row_index", "col_index").agg(F.max("new_status").alias("new_status"))
    wanted = wanted.groupBy("show_id").agg(F.collect_list(F.struct("row_index", "col_index", "new_status")).alias("_changes"))
    widths = halls.groupBy("hall_id").agg(F.collect_set("total_col").alias("_widths"))
    at = F.explode(F.array_distinct(F.transform("_words", lambda w: F.struct(w["hall_id"].alias("hall_id"), w["word"].alias("word")))))
    rows = had.join(wanted, "show_id", "left").select("show_id", at.alias("_at"), "_words", "_changes")
    rows = rows.select("show_id", "_at.*", "_words", "_changes").join(_few(widths), "hall_id", "left")

    zero = F.lit(0).cast("long")
    here = lambda w: w["hall_id"].eqNullSafe(F.col("hall_id")) & w["word"].eqNullSafe(F.col("word"))
    place = lambda c, width: c["row_index"] * width + c["col_index"]
    falls = lambda c, width: F.floor(place(c, width) / 64) == F.col("word")
    bit = lambda c, width: F.struct(c["new_status"].alias("status"), _bit(place(c, width)).alias("bits"))
    by_width = lambda width: F.transform(F.filter("_changes", lambda c: falls(c, width)), lambda c: bit(c, width))
    rows = rows.withColumn("_had", F.filter("_words", here)).withColumn("_to", F.flatten(F.transform("_widths", by_width)))
    bits_of = lambda a: F.aggregate(a, zero, lambda x, w: x.bitwiseOR(F.coalesce(w["bits"], zero)))
    rows = rows.withColumn("_seats", bits_of("_had")).withColumn("_touched", F.coalesce(bits_of("_to"), zero))
    changed = lambda w, bits: F.struct(w["status"].alias("status"), bits.alias("bits"))
    kept = F.transform("_had", lambda w: changed(w, w["bits"].bitwiseAND(F.bitwise_not(F.col("_touched")))))
    added = F.transform("_to", lambda c: changed(c, c["bits"].bitwiseAND(F.col("_seats"))))
    after = rows.select("show_id", "hall_id", "word", F.explode(F.when(F.col("_to").isNull(), kept).otherwise(F.concat(kept, added))).alias("_w"))
    after = after.groupBy("show_id", "hall_id", F.col("_w.status").alias("status"), "word").agg(F.bit_or("_w.bits").alias("bits"))
    return after.filter("bits <> 0").select("show_id", "hall_id", "status", "word", "bits")


def status_counts(words: DataFrame) -> DataFrame:
    return words.groupBy("show_id", "status").agg(F.sum(F.bit_count("bits")).alias("n"))


def availability(words: DataFrame) -> DataFrame:
    """Available and booked seats of every show."""
    count = lambda status: F.sum(F.when(F.col("status") == status, F.bit_count("bits")).otherwise(0))
    return words.groupBy("show_id").agg(count("AVAILABLE").alias("available"), count("BOOKED").alias("reserved"))


def full_shows(shows: DataFrame, words: DataFrame) -> DataFrame:
    """Shows without an available seat."""
    return shows.join(words.filter("status = 'AVAILABLE' AND bits <> 0").select("show_id"), "show_id", "left_anti")
