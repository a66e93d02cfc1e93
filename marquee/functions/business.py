"""Column expressions for show times, seats and money."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee import fixed_values as V

REQUEST_FORMAT = "dd/MM/yyyy HH:mm"


def minutes(n: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), n.cast("int"), F.lit(0))


def parse_request_time(text: Column) -> Column:
    """Null for text that is no such time."""
    return F.try_to_timestamp(text, F.lit(REQUEST_FORMAT)).cast("timestamp_ntz")


def show_end(start: Column, duration_mins: Column) -> Column:
    return start + minutes(duration_mins + V.CLEANING_MINUTES)


def event_date(ts: Column, zone: str | None = None) -> Column:
    return F.to_date(ts if zone is None else F.from_utc_timestamp(ts, zone))


def event_hour(ts: Column, zone: str | None = None) -> Column:
    return F.hour(ts if zone is None else F.from_utc_timestamp(ts, zone))


def show_time_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm - dd/MM/yyyy")


def iso_minutes(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm")


def seat_price(seat_type: Column) -> Column:
    return F.when(seat_type == "REGULAR", V.REGULAR_PRICE).otherwise(V.OTHER_PRICE)


def seat_name(hall_name: Column, row: Column, col: Column) -> Column:
    return F.concat(hall_name, row.cast("string"), F.lit("."), col.cast("string"))


def capacity(rows: Column, cols: Column) -> Column:
    return rows * cols


def minor_units(amount: Column) -> Column:
    return F.round(amount * 100).cast("long")


def major_units(minor: Column) -> Column:
    return minor / 100
