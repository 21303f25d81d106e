"""Windows of frames: what a ball, its search or its ring needs of a frame is read as a small window, and only windows are shuffled.

Windows are planned from rows (which frame, which square), read from packed files by range, put together with the windows at the
same place in frames nearby, and compared with the median of those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import LUMINANCE_WEIGHTS
from ..sources import frames as packed
from .series import shots

#: Fixed values. Frames whose windows make the background, in order; how many of them serve, and how many where none is like the window.
OFFSETS, USED, ELSE = (-4, 4, -8, 8, -12, 12), 4, 3
#: Fixed values. A window is like another if the differences at this percentile are within UNLIKE; the percentile for a search, and for a measurement.
UNLIKE, SEARCH_AT, MEASURE_AT = 12.0, 75, 90
#: Fixed values. Weights of red, green and blue in a light difference.
LIGHT = (0.299, 0.587, 0.114)
#: Frames of a file that one task reads windows of, at most.
REGION = 256


def square(cx: Column, cy: Column, half: Column, width: float, height: float) -> Column:
    """struct<x0, y0, x1, y1> of the square of 2 * half around a centre, cut at the frame; null where less than half a side is left."""
    lo = [F.bround(c, 0).cast("int") - half.cast("int") for c in (cx, cy)]
    a = [F.greatest(F.lit(0), c) for c in lo]
    b = [F.least(F.lit(int(size)), c + 2 * half.cast("int")) for c, size in zip(lo, (width, height), strict=True)]
    return F.when((b[0] - a[0] >= half) & (b[1] - a[1] >= half), F.struct(a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1")))


def with_background(wanted: DataFrame, known: DataFrame, near: Column, cuts: DataFrame, files: DataFrame, key: str = "video_id") -> DataFrame:
    """key, frame, offset, other, box: the window of each wanted row (key, frame, box) in its own frame (offset 0) and in those OFFSETS away in the same shot.

    Frames where `near` holds are left out; it sees the wanted row, and the ball in the other frame as qx, qy (from known: key, frame, x, y).
    """
    w = wanted.withColumn("offset", F.explode(F.array(*map(F.lit, (0, *OFFSETS))))).withColumn("other", F.col("frame") + F.col("offset"))
    w = w.join(files.select(key, F.col("n").alias("_n")), key).where("other >= 0 AND other < _n").drop("_n")
    w = shots(w, cuts, key).withColumnRenamed("shot_id", "_own")
    w = shots(w, cuts.select(key, F.col("frame").alias("other")), key, "other").where(F.col("shot_id") == F.col("_own"))
    q = known.select(key, F.col("frame").alias("other"), F.col("x").alias("qx"), F.col("y").alias("qy"))
    w = w.join(q, [key, "other"], "left").where((F.col("offset") == 0) | ~F.coalesce(near, F.lit(False)))
    return w.select(key, "frame", "offset", "other", "box")


def cut(windows: DataFrame, files: DataFrame, key: str = "video_id") -> DataFrame:
    """windows (key, frame, offset, other, box) with rgb, the window's bytes, read from packed files (key, path: see sources.frames.frame_files).

    Rows are dealt by regions of a file and read in order; of a frame only the rows of pixels that its window crosses are read.
    """
    named = windows.join(files.select(key, "path"), key)
    kinds = ", ".join(f"{c} {windows.schema[c].dataType.simpleString()}" for c in (key, "frame", "offset", "box"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f, head = None, None, None
        for b in batches:
            out = []
            for to, other, box in zip(b.column("path").to_pylist(), b.column("other").to_pylist(), b.column("box").to_pylist(), strict=True):
                if to != path:
                    if f is not None:
                        f.close()
                    store, at = packed.opened(to)
                    path, head, f = to, packed.read_header(store, at), store.open_input_file(at)
                line = head.width * 3
                f.seek(head.begin + other * head.frame_bytes() + box["y0"] * line)
                rows = np.frombuffer(f.read((box["y1"] - box["y0"]) * line), np.uint8).reshape(-1, head.width, 3)
                out.append(rows[:, box["x0"] : box["x1"]].tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (key, "frame", "offset", "box")), pa.array(out, pa.binary())], names=[key, "frame", "offset", "box", "rgb"])
        if f is not None:
            f.close()

    ordered = named.repartition(F.col(key), F.floor(F.col("other") / REGION)).sortWithinPartitions(key, "other")
    return ordered.select(key, "frame", "offset", "other", "box", "path").mapInArrow(run, f"{kinds}, rgb binary")


def _background(own: np.ndarray, others: list[tuple[int, np.ndarray]], percentile: float, outside: np.ndarray | None) -> np.ndarray | None:
    """The median of the windows that are most like `own`, cut to whole numbers; needs two. outside: where a measurement compares, None for a search."""
    judged = []
    for offset, image in others:
        apart = np.abs(image.astype(np.int16) - own.astype(np.int16)).max(axis=2)
        apart = apart if outside is None else apart[outside]
        judged.append((float(np.percentile(apart, percentile)) if apart.size else 0.0, abs(offset), OFFSETS.index(offset), image))
    by_error = sorted(judged, key=lambda j: (j[0], j[2]))
    used = by_error[:USED]
    if outside is not None:
        good = sorted((j for j in judged if j[0] <= UNLIKE), key=lambda j: (j[1], j[0], j[2]))[:USED]
        used = good if len(good) >= 2 else by_error[:ELSE]
    return np.median(np.stack([j[3] for j in used]), axis=0).astype(np.uint8) if len(used) >= 2 else None


def differences(cuts_: DataFrame, measuring: DataFrame | None = None, key: str = "video_id") -> DataFrame:
    """key, frame, x0, y0, h, w, values, light: how far each window lies from its background, in colour and in light (flat arrays).

    cuts_ are of cut(). For measurements, measuring has key, frame, cx, cy, away: surroundings are compared beyond `away` of (cx, cy).
    Windows whose background has less than two windows are absent.
    """
    got = cuts_.groupBy(key, "frame").agg(F.collect_list(F.struct("offset", "box", "rgb")).alias("all"))
    cols = ["cx", "cy", "away"] if measuring is not None else []
    got = got.join(measuring.select(key, "frame", *cols), [key, "frame"]) if cols else got
    head = f"{key} {cuts_.schema[key].dataType.simpleString()}, frame {cuts_.schema['frame'].dataType.simpleString()}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                box = {c["offset"]: c["box"] for c in row.all}.get(0)
                if box is None:
                    continue
                shape = (box["y1"] - box["y0"], box["x1"] - box["x0"], 3)
                images = {c["offset"]: np.frombuffer(c["rgb"], np.uint8).reshape(shape) for c in row.all}
                outside = None
                if cols:
                    yy, xx = np.mgrid[0 : shape[0], 0 : shape[1]]
                    outside = np.hypot(xx + box["x0"] - row.cx, yy + box["y0"] - row.cy) > row.away
                ground = _background(images[0], [(o, images[o]) for o in OFFSETS if o in images], MEASURE_AT if cols else SEARCH_AT, outside)
                if ground is not None:
                    apart = images[0].astype(np.float64) - ground
                    out.append((getattr(row, key), row.frame, box["x0"], box["y0"], shape[0], shape[1], np.sqrt((apart**2).sum(axis=2)).ravel(), (apart @ np.array(LIGHT)).ravel()))
            yield pd.DataFrame(out, columns=[key, "frame", "x0", "y0", "h", "w", "values", "light"])

    return got.mapInPandas(run, f"{head}, x0 int, y0 int, h int, w int, values array<double>, light array<double>")


def ring_box(width: float, height: float) -> Column:
    """The window around the ball of x, y, r, sl, sa that its ring's surroundings need; null outside the frame."""
    outer = F.greatest(2.5 * F.col("r"), 1.3 * F.col("r") + 1.0)
    ex, ey = (F.abs(F.col("sl") * f("sa")) + outer + 1 for f in (F.cos, F.sin))
    lo = lambda c, e: F.greatest(F.lit(0), F.floor(F.col(c) - e)).cast("int")
    hi = lambda c, e, size: F.least(F.lit(int(size)), F.ceil(F.col(c) + e)).cast("int")
    x0, y0, x1, y1 = lo("x", ex), lo("y", ey), hi("x", ex, width), hi("y", ey, height)
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def luminances(cuts_: DataFrame, balls: DataFrame, key: str = "video_id") -> DataFrame:
    """key, frame, lum of the median linear colour between the radii of the ring around each ball (x, y, r, sl, sa); null where fewer than 4 pixels are seen."""
    got = cuts_.join(balls.select(key, "frame", "x", "y", "r", "sl", "sa"), [key, "frame"])
    head = f"{key} {cuts_.schema[key].dataType.simpleString()}, frame {cuts_.schema['frame'].dataType.simpleString()}"
    weights = np.array(LUMINANCE_WEIGHTS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for q in pdf.itertuples(index=False):
                h, w = q.box["y1"] - q.box["y0"], q.box["x1"] - q.box["x0"]
                yy, xx = np.mgrid[0:h, 0:w] + 0.5
                dx, dy = xx + q.box["x0"] - q.x, yy + q.box["y0"] - q.y
                along = np.clip(dx * np.cos(q.sa) + dy * np.sin(q.sa), -q.sl, q.sl)
                off = np.hypot(dx - along * np.cos(q.sa), dy - along * np.sin(q.sa))
                seen = (off >= 1.3 * q.r) & (off <= max(2.5 * q.r, 1.3 * q.r + 1))
                lum = None
                if seen.sum() >= 4:
                    c = np.frombuffer(q.rgb, np.uint8).reshape(h, w, 3)[seen] / 255.0
                    lum = float(np.median(np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4), axis=0) @ weights)
                out.append((getattr(q, key), q.frame, lum))
            yield pd.DataFrame(out, columns=[key, "frame", "lum"])

    return got.mapInPandas(run, f"{head}, lum double")
