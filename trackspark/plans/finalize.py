"""From track points and measurements to final rows: centres, radii, streaks, confidence, ring colours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BLACK, FLAG_BOUNCE, FLAG_HIT, RADIUS_MAX, RADIUS_MIN
from ..functions.geometry import clamp, segment_distance
from ..operators import ring, series, stats


def centres(points: DataFrame, measured: DataFrame, width: float, key: str = "video_id") -> DataFrame:
    """points with cx, cy, wgt, measured and the measurement's columns: a good measurement near the fit, else the detection, else the fit.

    Positions that are not measured are moved back by the estimated lead along the motion.
    """
    keys = [key, "shot_id", "piece"]
    p = series.velocity(points, keys).join(measured.withColumnsRenamed({"x": "mx", "y": "my"}), [key, "frame"], "left")
    est = stats.lead(p.where("mx IS NOT NULL AND raw_x IS NOT NULL").withColumns({"x": F.col("raw_x"), "y": F.col("raw_y")}), [key]).withColumnRenamed("lead", "_lead")
    p = p.join(est, key, "left").withColumn("_lead", F.coalesce("_lead", F.lit(0.45)))
    p = p.withColumns({"_fx": F.col("x") - F.col("_lead") * F.col("vx"), "_fy": F.col("y") - F.col("_lead") * F.col("vy"), "_rx": F.col("raw_x") - F.col("_lead") * F.col("vx"), "_ry": F.col("raw_y") - F.col("_lead") * F.col("vy")})
    on_streak = (F.col("sl") > 0) & (segment_distance(F.col("_fx"), F.col("_fy"), F.col("mx"), F.col("my"), F.col("sl"), F.col("angle")) <= F.col("r") + 0.004 * width) & (F.col("sl") <= 0.04 * width)
    near = (F.hypot(F.col("mx") - F.col("_fx"), F.col("my") - F.col("_fy")) <= 0.008 * width) | on_streak
    good = F.coalesce((F.col("weight") >= F.when(F.col("detected"), 0.15).otherwise(0.6)) & near, F.lit(False))
    raw = F.coalesce(F.hypot(F.col("_rx") - F.col("_fx"), F.col("_ry") - F.col("_fy")) <= 0.006 * width, F.lit(False))
    p = p.withColumn("measured", good)
    pick = lambda m, r, f: F.when(F.col("measured"), F.col(m)).when(raw, F.col(r)).otherwise(F.col(f))
    p = p.withColumns({"cx": pick("mx", "_rx", "_fx"), "cy": pick("my", "_ry", "_fy"), "wgt": F.when(F.col("measured"), 0.5 + 0.5 * F.col("weight")).when(raw, 0.4).otherwise(0.15)})
    return p.drop("_lead", "_fx", "_fy", "_rx", "_ry", "vx", "vy")


def radii(points: DataFrame, width: float, height: float, key: str = "video_id") -> DataFrame:
    """points (frame, y, meas_r, meas_w) with `radius`: a depth model by shot times its smoothed ratio, within the plausible range."""
    keys = [key, "shot_id"]
    lo, hi = RADIUS_MIN * width, RADIUS_MAX * width
    ok = F.col("meas_r").isNotNull() & (F.col("meas_w") > 0)
    model = stats.depth_model(points.where(ok).select(*keys, "y", F.col("meas_r").alias("r"), F.col("meas_w").alias("w")), keys, height)
    mid = points.where(ok).groupBy(key).agg(F.percentile("meas_r", 0.5).alias("_mid"))
    p = points.join(model, keys, "left").join(mid, key, "left")
    base = clamp(F.coalesce(F.col("a") + F.col("b") * F.col("y") / height, F.col("_mid"), F.lit(0.0025 * width)), lo, hi)
    p = p.withColumn("_base", base)
    grid = series.dense(p.withColumns({"_q": F.when(ok, F.col("meas_r") / F.col("_base")), "_qw": F.when(ok, F.col("meas_w"))}), keys, ["_q", "_qw"])
    g = series.fill_linear(grid, keys, "_q", "_filled").withColumn("_filled", F.coalesce("_filled", F.lit(1.0)))
    g = series.median_filter(g, keys, "_filled", "_med").withColumn("_w", F.coalesce("_qw", F.lit(0.0)) + 0.05)
    g = series.gauss_filter(g, keys, "_med", "_w", "_ratio").select(*keys, "frame", "_ratio")
    out = p.join(g, [*keys, "frame"])
    return out.withColumn("radius", clamp(F.col("_base") * clamp(F.col("_ratio"), 0.75, 1.3), lo, hi)).drop("_base", "_ratio", "_mid", "a", "b")


def finalize(points: DataFrame, measured: DataFrame, width: float, height: float, key: str = "video_id") -> DataFrame:
    """key, shot_id, frame, x, y, r, conf, flags, detected, measured, sl, sa of a track's points.

    points come from operators.gapfill.track; measured has key, frame, x, y, r, sl, angle, elong, weight.
    """
    keys = [key, "shot_id", "piece"]
    p = centres(points, measured, width, key)
    p = series.local_quadratic(p, keys, "cx", "wgt", "sx")
    p = series.local_quadratic(p, keys, "cy", "wgt", "sy")
    known = lambda c: F.when(F.col("measured"), F.col(c))
    p = p.withColumns({"meas_r": known("r"), "meas_w": F.coalesce(known("weight"), F.lit(0.0)), "sl_meas": known("sl"), "ang_meas": known("angle"), "ang_w": F.coalesce(known("weight") * clamp(F.col("elong") - 1.2, 0.0, 1.0), F.lit(0.0))})
    p = radii(p.withColumn("y", F.col("sy")), width, height, key)
    p = p.select(key, "shot_id", "frame", "piece", F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("radius").alias("r"), "conf", "flags", "detected", "measured", "meas_w", "sl_meas", "ang_meas", "ang_w")
    p = series.velocity(p, keys).withColumns({"speed": F.hypot("vx", "vy"), "sl_w": F.col("meas_w")})
    k = stats.exposure(p, [key])
    p = p.join(k, key)
    # the exposure is one number a video, so the length is smoothed in units of it
    p = _streaks(p, keys, width)
    p = series.streak_angle(p, keys)
    kink = (F.col("flags").bitwiseAND(FLAG_BOUNCE | FLAG_HIT) != 0) & ~F.col("measured")
    conf = F.when(F.col("detected") & F.col("measured"), 1 - (1 - F.col("conf")) * (1 - 0.4 * F.col("meas_w"))).when(F.col("detected"), 0.85 * F.col("conf")).otherwise(F.col("conf"))
    return p.select(key, "shot_id", "frame", "x", "y", "r", clamp(conf, 0.0, 1.0).alias("conf"), "flags", "detected", "measured", F.when(kink, 0.0).otherwise(F.col("sl")).alias("sl"), "sa")


def _streaks(p: DataFrame, keys: list[str], width: float) -> DataFrame:
    """streak_length() with each row's own exposure: the model enters as k * speed."""
    return series.streak_length(p, keys, F.col("exposure"), width).drop("exposure")


def ring_pass(final: DataFrame, luminances: DataFrame, max_gap: int = 8, key: str = "video_id") -> DataFrame:
    """final with `ring`: colours chosen span by span from luminances (key, frame, lum)."""
    b = series.breaks(final.join(luminances, [key, "frame"], "left"), [key], "shot_id", max_gap)
    colours = ring.choose(b.select(key, "span", "frame", "lum"), [key, "span"]).select(key, "frame", "ring")
    return final.join(colours, [key, "frame"], "left").withColumn("ring", F.coalesce("ring", F.lit(BLACK)))
