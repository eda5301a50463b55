"""Dates. The present is always a parameter; the session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
WEEKDAYS = ("dimanche", "lundi", "mardi", "mercredi", "jeudi", "vendredi", "samedi")


def instant(text: Column) -> Column:
    """A timestamp, or null where the text is none; a date alone is midnight."""
    return F.try_to_timestamp(text.cast("string"))


def day(text: Column) -> Column:
    """The UTC day of an instant, as YYYY-MM-DD."""
    return F.date_format(instant(text), "yyyy-MM-dd")


def days_between(earlier: Column, later: Column) -> Column:
    """Fractional days."""
    return (F.unix_millis(later) - F.unix_millis(earlier)) / DAY_MS


def days_left(deadline: Column, as_of: Column) -> Column:
    """Whole days up to a deadline, rounded up; null without one."""
    return F.ceil(days_between(as_of, instant(deadline)))


def is_open(deadline: Column, as_of_day: str) -> Column:
    """No deadline, or one that is not before the day; compared as text."""
    return deadline.isNull() | (deadline >= F.lit(as_of_day))


def french_date(value: Column) -> Column:
    return F.date_format(value, "dd/MM/yyyy")


def french_weekday(value: Column) -> Column:
    return F.element_at(F.array(*(F.lit(d) for d in WEEKDAYS)), F.dayofweek(value))


def french_range(since: Column, until: Column) -> Column:
    return F.when(until.isNull() | (since == until), F.concat(F.lit("le "), french_date(since))).otherwise(F.concat(F.lit("du "), french_date(since), F.lit(" au "), french_date(until)))


def reads_feed(value: Column) -> Column:
    """The secondary feed is read on Wednesdays and Fridays."""
    return F.dayofweek(value).isin(4, 6)
