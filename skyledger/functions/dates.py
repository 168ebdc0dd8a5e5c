"""Date handling for string timestamps of mixed shape."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F

_HAS_ZONE = r"(Z|[+-]\d{2}:?\d{2})$"
_DATE_ONLY = r"^\d{4}-\d{2}-\d{2}$"


def parse_timestamp(text: Column) -> Column:
    """Instant of an ISO string; no zone means UTC, unreadable text gives NULL.

    The zone is made explicit, so the session time zone has no influence.
    """
    zoned = (
        F.when(text.rlike(_DATE_ONLY), F.concat(text, F.lit("T00:00:00Z")))
        .when(text.rlike(_HAS_ZONE), text)
        .otherwise(F.concat(text, F.lit("Z")))
    )
    return F.try_to_timestamp(zoned)


def utc_wall_clock(ts: Column) -> Column:
    return F.to_utc_timestamp(ts, F.current_timezone())


def display_date(text: Column) -> Column:
    """``7 Sep 2024`` in UTC; ``Unknown Date`` when there is none."""
    shown = F.date_format(utc_wall_clock(parse_timestamp(text)), "d MMM yyyy")
    missing = text.isNull() | (text == "") | (text == "Unknown Date")
    return F.when(missing, F.lit("Unknown Date")).otherwise(F.coalesce(shown, F.lit("Invalid Date")))


def end_of_day(date_end: str) -> str:
    """Upper bound used for string comparison.

    ``…T23:59:59Z`` sorts after it ('Z' > '.') while ``…T23:59:59+00:00`` does not.
    """
    return date_end + "T23:59:59.999Z"


def date_preset(name: str, as_of: dt.date) -> tuple[str, str]:
    """(start, end) of a preset: ``week``, ``month``, ``year`` (to date) or ``any``."""
    if name == "any":
        return "", ""
    starts = {
        "week": as_of - dt.timedelta(days=7),
        "month": as_of - dt.timedelta(days=30),
        "year": as_of.replace(month=1, day=1),
    }
    return starts[name].isoformat(), as_of.isoformat()


def date_range_label(start: Column, end: Column, as_of: dt.date) -> Column:
    """Name of the preset a saved date range stands for."""
    start, end = F.coalesce(start, F.lit("")), F.coalesce(end, F.lit(""))

    def is_last(days: int) -> Column:
        return (start == (as_of - dt.timedelta(days=days)).isoformat()) & (end == as_of.isoformat())

    return (
        F.when((start == "") & (end == ""), "Any Date")
        .when(is_last(7), "Past Week")
        .when(is_last(30), "Past Month")
        .when(start == as_of.replace(month=1, day=1).isoformat(), "This Year")
        .otherwise("Custom Date")
    )
