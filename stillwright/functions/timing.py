"""Seconds, clock texts and frame rates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_of(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.unix_date(ts.cast("date")).cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def hms(sec: Column) -> Column:
    """H:MM:SS, or MM:SS below an hour."""
    h, m, s = (sec / 3600).cast("bigint"), (sec % 3600 / 60).cast("bigint"), (sec % 60).cast("bigint")
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%02d:%02d", m, s))


def minutes_mark(sec: Column) -> Column:
    """<m>m<ss>, minutes unbounded."""
    return F.format_string("%dm%02d", (sec / 60).cast("bigint"), (sec % 60).cast("bigint"))


def clock_seconds(text: Column) -> Column:
    """Seconds of [H:]MM:SS, hours of any number of digits; null for anything else."""
    pattern = r"^(?:(\d+):)?(\d{1,2}):(\d{2})$"
    part = lambda i: F.coalesce(F.regexp_extract(text, pattern, i).try_cast("int"), F.lit(0))
    return F.when(text.rlike(pattern), part(1) * 3600 + part(2) * 60 + part(3))


def frame_rate(text: Column, default: float = 30.0) -> Column:
    """'num/den' or a number; the default where that is no rate."""
    parts = F.split(text, "/")
    rate = F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(1.0)))
    return F.coalesce(F.when(rate > 0, rate), F.lit(default))


def backoff(attempt: Column) -> Column:
    """Seconds to wait after a failed attempt: 5, doubled each time, 60 at most."""
    return F.least(F.lit(5.0) * F.pow(F.lit(2.0), attempt - 1), F.lit(60.0))
