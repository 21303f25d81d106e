"""Where drawn things lie: overlays over a picture in its box, rings in pixels, zoomed windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import clamp, content_rect, ring_geometry


def overlay_layout(box: Column, parent: Column, video_w: Column, video_h: Column, fit: Column, dpr: Column) -> Column:
    """struct<left, top, w, h, px_w, px_h> of an overlay over a picture; null while the picture is smaller than 2 by 2 or a size is unknown.

    box is struct<left, top, width, height> of the picture's element, parent struct<left, top, border_left, border_top> of what the overlay is placed in.
    Lengths are CSS pixels, px_w and px_h device pixels (at least one, halves up).
    """
    r = content_rect(box["width"], box["height"], video_w, video_h, fit)
    ratio = F.coalesce(F.when(dpr > 0, dpr), F.lit(1.0))
    pixels = lambda c: F.greatest(F.lit(1), F.floor(c * ratio + 0.5)).cast("int")
    at = F.struct((box["left"] + r["x"] - parent["left"] - parent["border_left"]).alias("left"), (box["top"] + r["y"] - parent["top"] - parent["border_top"]).alias("top"), r["w"].alias("w"), r["h"].alias("h"), pixels(r["w"]).alias("px_w"), pixels(r["h"]).alias("px_h"))
    return F.when((r["w"] >= 2) & (r["h"] >= 2), at)


def rgb_of(colour: Column) -> Column:
    """struct<r, g, b> of #rrggbb."""
    part = lambda k: F.conv(F.substring(colour, k, 2), 16, 10).cast("int")
    return F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b"))


def drawn_ring(sample: Column, width: Column, height: Column, scale: Column, circle_only: Column, ratio: float = 1.2, least_stroke: float = 1.5, least_streak: float = 0.5) -> Column:
    """struct<x, y, inner, outer, half, angle, colour> in pixels of a sampled row (x, y, r, sl, sa, ring) on a picture of width x height.

    scale is pixels a CSS pixel, in which the least stroke is given. A streak shorter than its share of the radius is a circle.
    """
    r, sl = sample["r"] * width, sample["sl"] * width
    ring = ring_geometry(r, F.lit(ratio), least_stroke * scale)
    half = F.when(~circle_only & (sl > 0) & (sl >= least_streak * r), sl).otherwise(0.0)
    return F.struct((sample["x"] * width).alias("x"), (sample["y"] * height).alias("y"), (ring["radius"] - ring["width"] / 2).alias("inner"), (ring["radius"] + ring["width"] / 2).alias("outer"), half.alias("half"), sample["sa"].alias("angle"), rgb_of(sample["ring"]).alias("colour"))


def zoom_window(cx: Column, cy: Column, width: Column, height: Column, box: int = 60, zoom: int = 5, margin: int = 10) -> Column:
    """struct<x0, y0, left, top, size>: the window of `box` pixels around a point, kept within the picture, and where it stands zoomed in the upper right corner."""
    at = lambda c, size: clamp(F.bround(c, 0) - box // 2, 0, size - box).cast("int")
    size = box * zoom
    return F.struct(at(cx, width).alias("x0"), at(cy, height).alias("y0"), (width - size - margin).cast("int").alias("left"), F.lit(margin).alias("top"), F.lit(size).alias("size"))
