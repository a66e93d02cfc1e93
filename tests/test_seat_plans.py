"""Seats of shows are many times the shows: their rows are neither shuffled, broadcast nor written."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from marquee.operators import bookings as B
from marquee.operators import seat_bits as W
from marquee.operators import shows as S
from marquee.plans.all import PLANS
from marquee.session import tune
from marquee.sources.testdata import Views


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def above_the_seats(plan: str) -> str:
    return plan[: plan.index("Generate explode(sequence")]


def test_seat_map_moves_no_seat(spark, tiny):
    plan = physical(PLANS["seat_map"](Views(tune(spark), tiny)))
    assert "Exchange" not in above_the_seats(plan)
    assert "ObjectHashAggregate" not in plan


def shuffles(plan: str) -> int:
    return len(re.findall(r"(?<!Broadcast)Exchange ", plan))


def test_seat_words_move_no_seat(spark, tiny):
    v = Views(tune(spark), tiny)
    assert shuffles(above_the_seats(physical(W.seat_words(v.show_seats, v.halls)))) == 0


def test_words_and_changes_meet_once(spark):
    words = spark.createDataFrame([("s", "h", "A", 0, 7), ("s", "h", "A", 1, 1), ("t", "g", "A", 0, 1)], "show_id string, hall_id string, status string, word int, bits long")
    changes = spark.createDataFrame(
        [("s", 0, 1, "B"), ("s", 0, 1, "A"), ("s", 0, 9, "B"), ("t", 0, 0, "B"), ("u", 0, 0, "B"), ("s", 6, 4, "C")],
        "show_id string, row_index int, col_index int, new_status string",
    )
    halls = spark.createDataFrame([("h", 10), ("h", 10)], "hall_id string, total_col int")  # a hall that comes twice, one that is not there
    after = W.moved(words, changes, halls)
    assert sorted(map(tuple, after.collect())) == [
        ("s", "h", "A", 0, 5), ("s", "h", "B", 0, 2), ("s", "h", "C", 1, 1), ("t", "g", "A", 0, 1),
    ]
    assert physical(after).count("Join") - physical(after).count("BroadcastHashJoin") <= 1
    assert shuffles(physical(W.status_counts(after))) <= 4


def test_requests_are_checked_without_dealing_out_seats(spark, tiny, monkeypatch):
    name = "stored" if hasattr(B, "stored") else "materialize"
    kept, plans = getattr(B, name), []
    monkeypatch.setattr(B, name, lambda df, *label: plans.append(physical(df)) or kept(df, *label))
    v = Views(tune(spark), tiny)
    B.check_requests(v.booking_requests, v.users, v.shows, v.request_seats)
    assert len(plans) == 2 and not re.search(r"Exchange hashpartitioning\([^)]*seat_id", plans[0])


def test_problems_of_seats(spark):
    stock = "array(struct('1', 'AVAILABLE'), struct('2', 'BOOKED'), struct('2', 'AVAILABLE'), struct('3', null))"
    rows = spark.createDataFrame(
        [(["1"],), (["1", "2"],), (["4", "2"],), (["3", "4"],), ([],), (None,), (["1", None],)], "seat_ids array<string>"
    ).withColumn("stock", F.expr(f"cast({stock} as array<struct<seat_id:string,status:string>>)"))
    got = rows.select(B._problem(F.col("seat_ids"), F.col("stock"))["text"].alias("a"), B._problem(F.col("seat_ids"), F.lit(None))["text"].alias("b"))
    assert [r.a for r in got.collect()] == [None, "Seat ID 2 is reserved", "Seat ID 2 is reserved", "Not found seat id: 3", None, None, None]
    assert [r.b for r in got.collect()] == [
        "Not found seat id: 1", "Not found seat id: 1", "Not found seat id: 2", "Not found seat id: 3", None, None, None,
    ]


def test_status_counts_send_no_grid_to_the_driver(spark, tiny):
    plan = physical(PLANS["seat_status_counts"](Views(tune(spark), tiny)))
    assert "Exchange" not in above_the_seats(plan)


def test_inventory_sends_no_grid_to_the_driver(spark, tiny):
    above = above_the_seats(physical(PLANS["show_seat_inventory"](Views(tune(spark), tiny))))
    assert above[above.rindex("Exchange") :].startswith("Exchange hashpartitioning(hall_id")


def test_many_seats_of_halls_meet_as_lists(spark, monkeypatch):
    shown = spark.createDataFrame(
        [("s", "h", 0, 0, "A"), ("s", "h", 0, 1, "B"), ("s", "h", 0, 1, "B"), ("t", "h", 0, 0, None), ("s", "g", 0, 0, "A"),
         ("t", "h", 9, 9, "A"), ("u", "no", 0, 0, "A"), ("v", None, 0, 0, "A"), (None, "h", 0, 0, "C")],
        "show_id string, hall_id string, row_index int, col_index int, status string",
    )
    seats = spark.createDataFrame(
        [("h", 0, 0, "R", "h0.0", 1.0), ("h", 0, 1, "P", "h0.1", 2.0), ("g", 0, 0, "R", "g0.0", 1.0), ("g", 0, 0, "P", "again", 2.0)],
        "hall_id string, row_index int, col_index int, seat_type string, seat_name string, price double",
    )
    few = S.seat_list(shown, seats)
    monkeypatch.setattr(S, "BROADCAST_SEATS", 0)
    many = S.seat_list(shown, seats)
    assert many.columns == few.columns and "BroadcastExchange" not in physical(many)
    assert sorted(map(repr, many.collect())) == sorted(map(repr, few.collect())) and few.count() == 7


def test_conflicts_deal_out_halls_once(spark):
    made = "cast(id AS string) show_id, cast(id % 3 AS string) hall_id, timestamp_seconds(id * 60) start_time, timestamp_seconds(id * 60 + 500) end_time"
    shows = spark.range(40).selectExpr(*made.split(", "))
    asked = spark.range(40, 60).selectExpr(*made.split(", "))
    met = S.conflicts(asked, shows)
    assert shuffles(physical(met)) == 1
    pairs = S.conflicting_shows(asked, shows).groupBy("candidate_id").count().collect()
    assert {r.show_id: r.n_conflicts for r in met.collect() if r.n_conflicts} == {r[0]: r[1] for r in pairs}
