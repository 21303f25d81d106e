"""Clamped settings and small classifications as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import clamp

#: Least, greatest and default value. Fixed values.
LIMITS = {"ratio": (1.1, 1.5, 1.2), "min_stroke": (0.5, 4.0, 1.5), "min_conf": (0.0, 1.0, 0.5)}
SHAPES = ("stadium", "circle")


def setting(value: Column, name: str) -> Column:
    """A finite number clamped to its limits, else the default."""
    lo, hi, default = LIMITS[name]
    v = value.try_cast("double")
    odd = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return F.when(odd, default).otherwise(clamp(v, lo, hi))


def shape_setting(value: Column) -> Column:
    return F.when(value.isin(*SHAPES), value).otherwise(SHAPES[0])


def flag_setting(value: Column, default: bool) -> Column:
    return F.coalesce(value, F.lit(default))


def request_error(start: Column, end: Column) -> Column:
    """Why a job request is refused, or null."""
    return F.when(start < 0, "start must not be negative").when(end <= 0, "end must be positive").when(end <= start, "end must be after start")


def prompt_range(start: Column, end: Column, duration: Column) -> Column:
    """struct<start, end, error> of a typed range: its end is cut at a known duration."""
    known = duration > 0
    error = F.when(start.isNull() | end.isNull(), "form").when(end <= start, "order").when(known & (start >= duration), "beyond")
    cut = F.when(known, F.least(end, duration)).otherwise(end)
    return F.struct(F.when(error.isNull(), start).alias("start"), F.when(error.isNull(), cut).alias("end"), error.alias("error"))


def suppressed(ad: Column, mini: Column, pip: Column, hidden: Column) -> Column:
    """The first reason that hides the overlay, or null."""
    return F.coalesce(F.when(ad, "ad"), F.when(mini, "miniplayer"), F.when(pip, "pip"), F.when(hidden, "tab-hidden"))


def badge(kind: Column, progress: Column) -> Column:
    return F.when(kind == "processing", F.concat(F.floor(progress * 100 + 0.5).cast("string"), F.lit("%"))).when(kind == "ready", "on").when(kind == "failed", "!").otherwise("")


def frame_rate(avg: Column, base: Column) -> Column:
    """Of "n/d" strings: the average rate unless it is zero or missing, else the base rate."""
    rate = lambda s: F.try_divide(F.split(s, "/")[0].try_cast("double"), F.coalesce(F.get(F.split(s, "/"), F.lit(1)).try_cast("double"), F.lit(1.0)))
    return F.coalesce(F.when(rate(avg) > 0, rate(avg)), rate(base))


def interlace_vote(tff: Column, bff: Column, progressive: Column) -> Column:
    """struct<interlaced, parity> from field counters."""
    return F.struct((tff + bff > F.greatest(F.lit(10), 2 * progressive)).alias("interlaced"), F.when(tff >= bff, "tff").otherwise("bff").alias("parity"))
