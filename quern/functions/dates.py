"""Date and time functions of the dialects. Timestamps are without a time zone; times are hh:mm:ss texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import seconds_to_time, time_to_seconds


def day_of_week(ts: Column) -> Column:
    """1 for Sunday to 7 for Saturday (DAYOFWEEK)."""
    return F.dayofweek(ts)


def microsecond(ts: Column) -> Column:
    return F.date_format(ts, "SSSSSS").cast("int")


def time_of(ts: Column) -> Column:
    """hh:mm:ss of a timestamp (TIME)."""
    return F.date_format(ts, "HH:mm:ss")


def to_seconds(ts: Column) -> Column:
    """Seconds since the year 0 (TO_SECONDS)."""
    return (F.unix_date(ts.cast("date")) + 719528).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def week(ts: Column, mode: int = 0) -> Column:
    """WEEK by mode: 0 and 2 begin on Sunday, 1 and 3 on Monday; 0 and 1 count from week 0."""
    day, year = ts.cast("date"), F.year(ts)
    first = F.make_date(year, F.lit(1), F.lit(1))
    if mode == 0:  # weeks begin with the year's first Sunday
        return F.floor((F.dayofyear(day) + 6 - (F.dayofweek(day) - 1)) / 7).cast("int")
    if mode == 3:
        return F.weekofyear(day)
    if mode == 1:  # a first week of four days or more is week 1
        begin = F.weekday(first)
        return F.floor((F.dayofyear(day) + begin - 1) / 7).cast("int") + F.when(begin <= 3, 1).otherwise(0)
    if mode == 2:
        zero = week(day, 0)
        last = F.make_date(year - 1, F.lit(12), F.lit(31))
        return F.when(zero == 0, week(last, 0)).otherwise(zero)
    raise ValueError(f"mode {mode} of WEEK")


def year_week(ts: Column) -> Column:
    """yyyyww of the Sunday's week (YEARWEEK)."""
    sunday = F.date_sub(ts.cast("date"), F.dayofweek(ts) - 1)
    return F.year(sunday) * 100 + week(sunday, 0)


def add_time(time: Column, more: Column) -> Column:
    """ADDTIME of two times."""
    return seconds_to_time(time_to_seconds(time) + time_to_seconds(more))


def sub_time(time: Column, less: Column) -> Column:
    """SUBTIME, TIMEDIFF of two times."""
    return seconds_to_time(time_to_seconds(time) - time_to_seconds(less))


def make_time(hour: Column, minute: Column, second: Column) -> Column:
    """MAKETIME; null where minute or second is none."""
    return F.when(minute.between(0, 59) & second.between(0, 59), seconds_to_time(hour * 3600 + minute * 60 + second))


def timestamp_add(unit: str, n: Column, ts: Column) -> Column:
    """TIMESTAMPADD, DATE_ADD and ADDDATE with an INTERVAL of one unit."""
    return F.timestamp_add(unit, n.cast("int"), ts.cast("timestamp_ntz"))


def add_parts(ts: Column, days: int = 0, hours: int = 0, minutes: int = 0, seconds: int = 0) -> Column:
    """DATE_ADD with a composite unit such as DAY_SECOND."""
    return ts + F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes), F.lit(seconds))


def timestamp_diff(unit: str, start: Column, end: Column) -> Column:
    """Whole units from start to end (TIMESTAMPDIFF): a month counts once its day and time are reached."""
    return F.timestamp_diff(unit, start.cast("timestamp_ntz"), end.cast("timestamp_ntz"))


def from_unixtime(n: Column) -> Column:
    """FROM_UNIXTIME in UTC, as a timestamp without a time zone."""
    return F.timestamp_add("SECOND", n.cast("int"), F.lit("1970-01-01").cast("timestamp_ntz"))


def convert_tz(ts: Column, source: str, target: str) -> Column:
    """CONVERT_TZ between named zones."""
    return F.convert_timezone(F.lit(source), F.lit(target), ts.cast("timestamp_ntz"))


def format_pico_time(n: Column) -> Column:
    """Picoseconds with a unit (FORMAT_PICO_TIME)."""
    text = F.format_string("%d ps", n.cast("long"))
    for size, unit in ((1e3, "ns"), (1e6, "us"), (1e9, "ms"), (1e12, "s"), (6e13, "min"), (3.6e15, "h"), (8.64e16, "d")):
        text = F.when(n >= size, F.format_string(f"%.2f {unit}", n / size)).otherwise(text)
    return text
