"""Clock times as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(s: Column) -> Column:
    """Seconds of "359", "5:59.5" or "1:05:59" as struct<seconds, error>; null and blank give neither.

    A plain number is tried first, so exponents, inf and nan count; minutes of the two-part form are unbounded.
    """
    s = F.trim(s)
    number = s.try_cast("double")
    form = r"^(?:(\d+):)?(\d+):(\d+(?:\.\d*)?)$"
    part = lambda k: F.regexp_extract(s, form, k).try_cast("double")
    sec, low = part(3), s.rlike(form)
    bad = (sec >= 60) | ((F.regexp_extract(s, form, 1) != "") & (part(2) >= 60))
    clock = F.coalesce(part(1), F.lit(0.0)) * 3600 + part(2) * 60 + sec
    value = F.when(number.isNotNull(), F.when((number >= 0) | F.isnan(number), number)).when(low & ~bad, clock)
    error = F.when(s.isNull() | (s == ""), None).when(number < 0, "negative").when(number.isNotNull(), None).when(~low, "form").when(bad, "range")
    return F.struct(value.alias("seconds"), error.alias("error"))


def format_time(sec: Column) -> Column:
    """m:ss.mmm, or h:mm:ss.mmm from an hour on."""
    whole = F.floor(sec / 60).cast("bigint")
    s = sec - whole * 60
    return F.when(whole >= 60, F.format_string("%d:%02d:%06.3f", F.floor(whole / 60), whole % 60, s)).otherwise(F.format_string("%d:%06.3f", whole, s))


def parse_clock(s: Column) -> Column:
    """The strict form: plain digits, or one or two digits of minutes and seconds; null where it doesn't parse."""
    s = F.trim(F.coalesce(s, F.lit("")))
    form = r"^(?:(\d+):)?(\d{1,2}):(\d{1,2}(?:\.\d+)?)$"
    part = lambda k: F.regexp_extract(s, form, k).try_cast("double")
    ok = (part(3) < 60) & ~((F.regexp_extract(s, form, 1) != "") & (part(2) >= 60))
    return F.when(s.rlike(r"^\d+(\.\d+)?$"), s.try_cast("double")).when(s.rlike(form) & ok, F.coalesce(part(1), F.lit(0.0)) * 3600 + part(2) * 60 + part(3))


def format_clock(sec: Column) -> Column:
    """m:ss or h:mm:ss of the nearest whole second; negative and missing times are 0."""
    total = F.greatest(F.lit(0), F.floor(F.coalesce(F.nanvl(sec, F.lit(0.0)), F.lit(0.0)) + 0.5)).cast("bigint")
    h, m, s = F.floor(total / 3600), F.floor(total % 3600 / 60), total % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def default_range(current: Column, duration: Column, half: float = 30.0) -> Column:
    """struct<start, end>: whole seconds around the current time, within the duration if that is known."""
    d = F.when(duration > 0, duration)
    c = F.greatest(F.lit(0.0), F.least(F.coalesce(current, F.lit(0.0)), d))
    end = F.ceil(F.least(d, c + half))
    return F.struct(F.floor(F.greatest(F.lit(0.0), c - half)).alias("start"), end.alias("end"))


def iso(ts: Column, millis: bool = True) -> Column:
    """A UTC time (without zone) as 2026-01-31T23:59:59.123Z, cut to milliseconds, or to seconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'" if millis else "yyyy-MM-dd'T'HH:mm:ss'Z'")


def now_iso(millis: bool = True) -> Column:
    """The query's own time as iso() gives it: the same for all rows."""
    return iso(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), millis)
