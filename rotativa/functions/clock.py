"""Time functions; whatever is "now" is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

MEXICO = "America/Mexico_City"


def local_day(ts: Column | str, zone: str = MEXICO) -> Column:
    """Calendar day of a UTC instant in a zone."""
    return F.to_date(F.from_utc_timestamp(_col(ts), zone))


def in_local_days(ts: Column | str, first: str, last: str, zone: str = MEXICO) -> Column:
    """Whether an instant lies between two local days, both included."""
    t = _col(ts)
    return (t >= F.to_utc_timestamp(F.lit(first).cast("timestamp"), zone)) & (t < F.to_utc_timestamp(F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"), zone))


def minutes_between(a: Column | str, b: Column | str) -> Column:
    """Whole minutes from a to b, at least 0."""
    return F.greatest(F.lit(0), F.floor((F.unix_micros(_col(b)) - F.unix_micros(_col(a))) / 60_000_000)).cast("long")


def lane(ts: Column | str, now: Column) -> Column:
    """Lane of a recovery by age: live, 24h, 72h or lost."""
    hours = (F.unix_micros(now) - F.unix_micros(_col(ts))) / 3_600_000_000
    return F.when(hours <= 2, "live").when(hours <= 24, "24h").when(hours <= 72, "72h").otherwise("lost")


def backoff_minutes(attempt: Column, first: int = 15, most: int = 3600, attempts: int = 8) -> Column:
    """Wait before the next attempt, doubling; null when there is none."""
    return F.when(attempt.between(1, attempts), F.least(F.lit(most), (F.lit(first) * F.pow(F.lit(2), attempt - 1)).cast("long")))
