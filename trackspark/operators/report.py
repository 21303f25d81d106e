"""Lines of text about videos, tracks and saves, as a command line prints them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import format_time


def short_number(v: Column) -> Column:
    """A number with up to six significant digits, without zeros at its end; for 0.0001 up to a million."""
    digits = F.greatest(F.lit(0), 5 - F.floor(F.log10(F.greatest(F.abs(v), F.lit(1e-9))))).cast("int")
    text = F.coalesce(*(F.when(digits == k, F.format_string(f"%.{k}f", v)) for k in range(11)), F.format_string("%.6f", v))
    return F.when(v == 0, "0").otherwise(F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def spans(segments: Column, number=short_number) -> Column:
    """start-end of each segment, joined by commas; - for none."""
    text = F.array_join(F.transform(segments, lambda s: F.concat(number(s["start"]), F.lit("-"), number(s["end"]))), ", ")
    return F.coalesce(F.when(text != "", text), F.lit("-"))


def video_lines(videos: DataFrame) -> DataFrame:
    """video_id, line of the list of videos (segments is array<struct<start, end>>)."""
    return videos.select("video_id", F.concat(F.rpad("video_id", 18, " "), F.lit(" "), F.rpad("status", 11, " "), F.lit(" "), F.col("updated_at"), F.lit("  "), spans(F.col("segments")), F.lit("  "), F.col("url")).alias("line"))


def track_lines(counted: DataFrame) -> DataFrame:
    """video_id, imported, valid, merged: what an import, a check and a merge say of tracks (video_id, n_rows, segments)."""
    rows, n = F.col("n_rows").cast("string"), F.size("segments").cast("string")
    return counted.select(
        "video_id", F.concat(F.lit("imported "), "video_id", F.lit(": "), rows, F.lit(" rows, "), n, F.lit(" segment(s)")).alias("imported"),
        F.concat(F.lit("ok: "), "video_id", F.lit(" "), rows, F.lit(" rows, segments "), F.coalesce(F.array_join(F.transform("segments", lambda s: F.concat(format_time(s["start"]), F.lit("-"), format_time(s["end"]))), ", "), F.lit(""))).alias("valid"), F.concat(F.lit("ok: "), rows, F.lit(" rows")).alias("merged"),
    )
