"""Exchange clock: New York time of UTC timestamps, sessions and windows of the day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def eastern(t: Column) -> Column:
    return F.from_utc_timestamp(t.cast("timestamp"), "America/New_York")


def minute_of_day(t: Column) -> Column:
    return F.hour(eastern(t)) * 60 + F.minute(eastern(t))


def ny_date(t: Column) -> Column:
    """The New York date of a UTC time, which is the trading date."""
    return F.to_date(eastern(t))


def session_window(t: Column) -> Column:
    """opening_window [09:30, 11:00), midday_dead_zone [12, 14), power_hour [15, 16), other_session_hours, outside_regular_hours."""
    m, open_day = minute_of_day(t), F.weekday(eastern(t)) < 5
    return (
        F.when(~open_day | (m < 570) | (m >= 960), "outside_regular_hours")
        .when(m < 660, "opening_window")
        .when((m >= 720) & (m < 840), "midday_dead_zone")
        .when(m >= 900, "power_hour")
        .otherwise("other_session_hours")
    )


def floor_time(t: Column, minutes: int) -> Column:
    return F.window(t, f"{minutes} minutes").getField("start")


def is_open(t: Column) -> Column:
    """Monday to Friday, 09:30 to before 16:00 in New York."""
    m = minute_of_day(t)
    return (F.weekday(eastern(t)) < 5) & (m >= 570) & (m < 960)


def _opening(day: Column) -> Column:
    return F.to_utc_timestamp(day.cast("timestamp") + F.expr("interval 570 minutes"), "America/New_York")


def next_open(t: Column) -> Column:
    """The first weekday's 09:30 in New York strictly after a time, in UTC."""
    day = F.date_add(F.to_date(eastern(t)), F.when(minute_of_day(t) >= 570, 1).otherwise(0))
    return _opening(F.date_add(day, F.greatest(7 - F.weekday(day), F.lit(0)) * (F.weekday(day) >= 5).cast("int")))


def session_open(t: Column) -> Column:
    """The opening of the session in progress, in UTC; null while the market is closed."""
    return F.when(is_open(t), _opening(F.to_date(eastern(t))))


def seconds_to_open(t: Column) -> Column:
    return F.unix_seconds(next_open(t)) - F.unix_seconds(t.cast("timestamp"))
