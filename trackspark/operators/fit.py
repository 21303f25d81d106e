"""How well drawn rings fit what they surround: outlines held against circles and stadiums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import clamp


def along(x: Column, y: Column, angle: Column) -> Column:
    """How far a point lies along an axis through the origin."""
    return x * F.cos(angle) + y * F.sin(angle)


def axis_distance(x: Column, y: Column, half: Column, angle: Column) -> Column:
    """Distance of a point from the segment of half-length `half` around the origin; without length, from the origin."""
    a = clamp(along(x, y, angle), -half, half)
    return F.hypot(x - a * F.cos(angle), y - a * F.sin(angle))


def fit_check(rings: DataFrame, outline: DataFrame, r: Column, key: str = "video_id", frame: str = "frame") -> DataFrame:
    """key, frame, n, overshoot, side_gap, tip_gap of each drawn ring that has points: how far they reach beyond its inner edge at most, and what is left inside it across and along its axis.

    rings have key, frame, cx, cy, half, angle, radius, line (the drawn line's width); outline has key, frame, x, y: centres of discs of radius r (of columns of rings)
    that together are the ball's true footprint. A ring that hugs it has gaps of about 0. One join by frame and one aggregate.
    """
    j = rings.withColumns({"inner": F.col("radius") - F.col("line") / 2, "_r": r}).join(outline.select(key, frame, F.col("x").alias("_x"), F.col("y").alias("_y")), [key, frame])
    dx, dy = F.col("_x") - F.col("cx"), F.col("_y") - F.col("cy")
    j = j.withColumns({"_far": axis_distance(dx, dy, F.col("half"), F.col("angle")) + F.col("_r"), "_along": F.abs(along(dx, dy, F.col("angle"))) + F.col("_r")})
    g = j.groupBy(key, frame, "inner", "half").agg(F.count("*").alias("n"), F.max("_far").alias("_far"), F.max("_along").alias("_along"))
    return g.select(key, frame, "n", (F.col("_far") - F.col("inner")).alias("overshoot"), (F.col("inner") - F.col("_far")).alias("side_gap"), (F.col("half") + F.col("inner") - F.col("_along")).alias("tip_gap"))


def worst(checks: DataFrame, key: str = "video_id") -> DataFrame:
    """key, n, overshoot, side_gap, tip_gap: of a video's frames the largest overshoot and the largest gaps."""
    return checks.groupBy(key).agg(F.count("*").alias("n"), *(F.max(c).alias(c) for c in ("overshoot", "side_gap", "tip_gap")))
