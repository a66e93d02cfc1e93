"""Column expressions over text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee import fixed_values as V


def fold_accents(text: Column) -> Column:
    source = "".join(V.FOLDED_LETTERS.values())
    target = "".join(plain * len(accented) for plain, accented in V.FOLDED_LETTERS.items())
    return F.translate(F.lower(text), source, target)


def escape_html(text: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), V.HTML_ESCAPES, text)


def quality_flags(text: Column) -> dict[str, Column]:
    return {
        "is_email": text.rlike(V.EMAIL_PATTERN),
        "has_sql": text.rlike(V.SQL_PATTERN),
        "has_xss": text.rlike(V.XSS_PATTERN),
        "is_normal_text": text.rlike(V.NORMAL_TEXT_PATTERN),
        "is_good_password": text.rlike(V.GOOD_PASSWORD_PATTERN),
        "is_username": text.rlike(V.USERNAME_PATTERN),
    }


def joined_hash(*fields: Column) -> Column:
    return F.sha2(F.concat_ws("&", *fields), 256)


def txn_ref(payment_id: Column, suffix: Column) -> Column:
    """First 16 characters of the id without dashes, and a four-digit suffix."""
    return F.concat(F.substring(F.replace(payment_id, F.lit("-"), F.lit("")), 1, 16), suffix)


def duration_text(minutes: Column) -> Column:
    return F.when(minutes < 60, F.format_string("%d phút", minutes)).otherwise(
        F.format_string("%d giờ %d phút", F.floor(minutes / 60), minutes % 60)
    )


def role_text(roles: Column) -> Column:
    """Role names without their ROLE_ prefix, joined."""
    return F.array_join(F.transform(roles, lambda r: F.regexp_replace(r, "^ROLE_", "")), ", ")


def first_name(full_name: Column) -> Column:
    return F.substring_index(F.trim(full_name), " ", 1)


def last_name(full_name: Column) -> Column:
    return F.substring_index(F.trim(full_name), " ", -1)


def stars(rating: Column, symbol: str = "♥") -> Column:
    return F.repeat(F.lit(symbol), F.greatest(rating, F.lit(0)))


def is_blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")
