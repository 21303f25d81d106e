"""Made tracks and clips for demonstrations and tests, by formula."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def circular_track(spark: SparkSession, video_id: str, start: float, end: float, fps: float = 25.0) -> DataFrame:
    """A point on a circle, with half a second missing in every ten."""
    n = max(0, int(math.floor((end - start) * fps)) + 1)
    t = F.round(F.lit(float(start)) + F.col("id") / fps, 3)
    a = F.col("t") * (2 * math.pi / 4)
    rows = spark.range(n).select(F.lit(video_id).alias("video_id"), t.alias("t")).where(F.col("t") % 10 < 9.5)
    return rows.withColumns({"x": F.round(0.5 + 0.25 * F.cos(a), 5), "y": F.round(0.5 + 0.25 * F.sin(a), 5), "r": F.lit(0.004), "conf": F.lit(0.9), "ring": F.lit("#101010"), "flags": F.lit(0), "sl": F.lit(0.0), "sa": F.lit(0.0)})


def pts_table(n: int, fps: float, spark: SparkSession, double: bool = False) -> DataFrame:
    """frame, pts of evenly spaced frames; doubled ones have a field half a frame later each."""
    p = spark.range(n).select((F.col("id") / fps).alias("pts"))
    if double:
        p = p.select(F.explode(F.array("pts", F.col("pts") + 0.5 / fps)).alias("pts"))
    return p.select(F.floor(F.col("pts") * fps * (2 if double else 1) + 0.5).cast("int").alias("frame"), "pts")


def in_range(rows: DataFrame, start: float | None, end: float | None, eps: float = 1e-6, t: str = "t") -> DataFrame:
    """Rows of the half-open range [start, end); a missing bound is open."""
    keep = (F.col(t) >= start - eps) if start is not None else F.lit(True)
    return rows.where(keep & ((F.col(t) < end - eps) if end is not None else F.lit(True)))


def clip_offset(clip: DataFrame, source: DataFrame, n: int = 8) -> DataFrame:
    """offset, mse for every place of the source (frame, pixel, v) that the first n frames of the clip may come from."""
    c = clip.where(F.col("frame") < n).select(F.col("frame").alias("k"), "pixel", F.col("v").alias("a"))
    s = source.select("frame", "pixel", F.col("v").alias("b"))
    j = c.join(s, "pixel").withColumn("offset", F.col("frame") - F.col("k")).where("offset >= 0")
    full = j.groupBy("offset").agg(F.avg(F.pow(F.col("a") - F.col("b"), F.lit(2.0))).alias("mse"), F.countDistinct("k").alias("frames"))
    return full.where(F.col("frames") == n).drop("frames")


def log_times(lines: DataFrame, line: str = "value") -> DataFrame:
    """Every pts_time of log lines in order; for counters of fields see sources.probe.field_counts()."""
    return lines.select(F.explode(F.regexp_extract_all(line, F.lit(r"pts_time:(-?[0-9.]+)"), F.lit(1))).cast("double").alias("pts"))


#: Fixed values of the designed clip: size, frames and rows a second, seconds, when it begins in its source, the ball's radius, the shutter's share of a frame, and exposures of a frame.
DESIGN = {"width": 640, "height": 360, "fps": 25, "row_fps": 50, "seconds": 12.0, "offset": 100.0, "radius": 5.0, "shutter": 0.9, "exposures": 12}
#: Fixed values, in seconds of the clip. The ball stands still; no rows at all; every other row missing; one row alone; rows of low confidence.
HOLD, GONE, THIN, LONE, UNSURE = (9.6, 10.4), (6.0, 6.5), (3.0, 3.1), (6.8, 7.0, 7.2), (8.0, 8.5)
#: Fixed values. Seconds from side to side, margin at the sides, ground and height of a bounce as shares of the height, the band where the ring must be dark.
CROSSING, MARGIN, GROUND, BOUNCE, BAND = 3.0, 60.0, 0.78, 0.55, (280.0, 360.0)


def designed_place(t: Column) -> tuple[Column, Column]:
    """Where the designed ball is at a time: to and fro, three bounces each way, but for a hold."""
    moved = t - F.greatest(F.lit(0.0), F.least(t, F.lit(HOLD[1])) - HOLD[0])
    way = moved / CROSSING
    u = way - F.floor(way)
    across = F.when(F.floor(way) % 2 == 0, u).otherwise(1 - u)
    h = DESIGN["height"]
    return MARGIN + (DESIGN["width"] - 2 * MARGIN) * across, h * GROUND - F.abs(F.sin(3 * math.pi * u)) * h * BOUNCE


def _exposed(t: Column) -> Column:
    """array<struct<x, y>> of the ball during the exposure around a time."""
    n, open_ = DESIGN["exposures"], DESIGN["shutter"] / DESIGN["fps"]
    at = lambda k: designed_place(t + open_ * ((k + 0.5) / n - 0.5))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.struct(at(k)[0].alias("x"), at(k)[1].alias("y")))


def designed_track(spark: SparkSession, video_id: str = "SYNTHETIC00") -> DataFrame:
    """Rows of a track with every case that drawing must get right: a gap, thin rows, a row alone, low confidence, a hold, bounces, and a ring that turns dark."""
    n, half = int(DESIGN["seconds"] * DESIGN["row_fps"]), DESIGN["shutter"] / DESIGN["fps"] / 2
    t = F.col("t")
    lies = lambda span: (t >= span[0]) & (t < span[1])
    dropped = lies(GONE) | ((t > THIN[0]) & (t < THIN[1]) & (F.col("id") % 2 == 1)) | (t.between(LONE[0], LONE[2]) & (t != LONE[1]))
    rows = spark.range(n).withColumn("t", F.col("id") / DESIGN["row_fps"]).where(~dropped)
    mean = lambda c: F.aggregate(F.transform("e", lambda q: q[c]), F.lit(0.0), lambda s, v: s + v) / DESIGN["exposures"]
    (ax, ay), (bx, by) = designed_place(t - half), designed_place(t + half)
    rows = rows.withColumn("e", _exposed(t)).withColumns({"px": mean("x"), "py": mean("y"), "dx": bx - ax, "dy": by - ay})
    w, h = DESIGN["width"], DESIGN["height"]
    flags = F.when(F.abs(designed_place(t)[1] - h * GROUND) < 2, 2).otherwise(0) + F.when(F.col("id") % 150 == 0, 4).otherwise(0)
    return rows.select(
        F.lit(video_id).alias("video_id"), F.round(t + DESIGN["offset"], 3).alias("t"), F.round(F.col("px") / w, 6).alias("x"), F.round(F.col("py") / h, 6).alias("y"), F.lit(round(DESIGN["radius"] / w, 6)).alias("r"), F.when(lies(UNSURE), 0.3).otherwise(0.92).alias("conf"),
        F.when(F.col("px").between(*BAND), "#101010").otherwise("#f5f5f5").alias("ring"), flags.alias("flags"), F.round(F.hypot("dx", "dy") / 2 / w, 6).alias("sl"), F.round(F.atan2("dy", "dx"), 4).alias("sa"),
    )


def designed_outline(spark: SparkSession, video_id: str = "SYNTHETIC00") -> DataFrame:
    """video_id, frame, x, y: centres of the ball over each frame's exposure, both ends of the shutter included."""
    n, half = int(DESIGN["seconds"] * DESIGN["fps"]), DESIGN["shutter"] / DESIGN["fps"] / 2
    t = F.col("id") / DESIGN["fps"]
    ends = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in (designed_place(t - half), designed_place(t + half))))
    return spark.range(n).select(F.lit(video_id).alias("video_id"), F.col("id").cast("int").alias("frame"), F.explode(F.concat(_exposed(t), ends)).alias("q")).select("video_id", "frame", F.round("q.x", 3).alias("x"), F.round("q.y", 3).alias("y"))
