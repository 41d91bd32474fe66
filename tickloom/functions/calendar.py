"""Clock and weekday arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickloom import constants as C


def second_of_day(ts: Column) -> Column:
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECONDS"), ts).cast("double")


def in_session(ts: Column) -> Column:
    """Weekday, and between the opening and the closing bell, both ends included."""
    return (F.weekday(ts) < 5) & second_of_day(ts).between(C.SESSION_OPEN, C.SESSION_CLOSE)


def phase(ts: Column) -> Column:
    """What the clock allows: nothing, entries, model entries too, or exits only."""
    s = second_of_day(ts)
    return (F.when(s < C.ENTRY_FROM, "wait")
            .when(s < C.MODEL_ENTRY_FROM, "entry")
            .when(s < C.HARD_EXIT_FROM, "model_entry")
            .otherwise("hard_exit"))


def add_weekdays(day: Column, n: Column | int) -> Column:
    """`n` >= 1 weekdays later; a weekend start counts from the Friday before it."""
    n = F.lit(n) if isinstance(n, int) else n
    wd = F.weekday(day)
    start = F.least(wd, F.lit(4))
    total = start + n
    jump = F.floor(total / 5) * 7 + total % 5 - wd
    return F.date_add(day, jump.cast("int"))


def sessions_held(opened: Column, today: Column) -> Column:
    """Weekday age of a holding, approximated from calendar days."""
    return F.greatest((F.datediff(today, opened) * 5 / 7).cast("int"), F.lit(0))


def to_zone(ts: Column, zone: str | None) -> Column:
    """A UTC instant or naive UTC stamp as local wall-clock time; `None` means it is local already."""
    return ts if zone is None else F.from_utc_timestamp(ts, zone)
