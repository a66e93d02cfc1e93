"""Seats as bits against tables of one row per seat."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marquee.operators import seat_bits as W
from marquee.operators import shows as S


@pytest.fixture(scope="module")
def seats(spark):
    rng = random.Random(2)
    halls = [("h1", 3, 4), ("h2", 9, 17), ("h3", 8, 8)]
    rows = [
        (f"s{k}", h, r, c, "BOOKED" if k == 2 else rng.choice(["AVAILABLE", "BOOKED", "PENDING"]))
        for k in range(9) for h, height, width in halls[k % 3 : k % 3 + 1] for r in range(height) for c in range(width)
    ]
    table = spark.createDataFrame(rows, "show_id string, hall_id string, row_index int, col_index int, status string")
    return table, spark.createDataFrame(halls, "hall_id string, total_row int, total_col int")


def same(a, b):
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_counts_and_full_shows(spark, seats):
    table, halls = seats
    words = W.seat_words(table, halls)
    assert words.filter("word > 0").count() > 0  # halls of more than 64 seats, the sign bit included
    same(W.status_counts(words), S.seat_status_counts(table))
    same(W.availability(words), S.availability(table))
    shows = table.select("show_id").distinct().unionByName(spark.createDataFrame([("none",)], "show_id string"))
    same(W.full_shows(shows, words), S.full_shows(shows, table))
    assert {r.show_id for r in W.full_shows(shows, words).collect()} >= {"s2", "none"}


def test_changes(spark, seats):
    table, halls = seats
    rng = random.Random(5)
    asked = [(f"s{rng.randrange(10)}", rng.randrange(10), rng.randrange(18), rng.choice(["AVAILABLE", "BOOKED", "CLOSED"])) for _ in range(300)]
    changes = spark.createDataFrame(asked, "show_id string, row_index int, col_index int, new_status string")
    # places beyond a hall's width would be other seats' places
    widths = table.groupBy("show_id").agg(F.max("col_index").alias("_w"), F.max("row_index").alias("_h"))
    changes = changes.join(widths, "show_id").filter("col_index <= _w AND row_index <= _h + 1").drop("_w", "_h")
    last = changes.groupBy("show_id", "row_index", "col_index").agg(F.max("new_status").alias("_new"))
    after = table.join(last, ["show_id", "row_index", "col_index"], "left").withColumn("status", F.coalesce("_new", "status"))
    got = W.moved(W.seat_words(table, halls), changes, halls)
    same(got, W.seat_words(after.select(table.columns), halls))
    same(W.moved(got, changes.limit(0), halls), got)
