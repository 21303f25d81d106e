"""Window operators over ordered frames: differences, local fits, filters with edge padding, islands."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.geometry import wrap_angle


def _w(keys: list[str], frame: str = "frame") -> Window:
    return Window.partitionBy(*keys).orderBy(frame)


def velocity(points: DataFrame, keys: list[str], values: tuple[str, ...] = ("x", "y"), frame: str = "frame") -> DataFrame:
    """points with v<value> per frame: central differences of adjacent frames, one-sided at ends, 0 alone."""
    w, f = _w(keys, frame), F.col(frame)
    prev, nxt = F.lag(frame).over(w) == f - 1, F.lead(frame).over(w) == f + 1
    has_prev, has_next = F.coalesce(prev, F.lit(False)), F.coalesce(nxt, F.lit(False))
    out = {}
    for v in values:
        a, b, c = F.lag(v).over(w), F.col(v), F.lead(v).over(w)
        out[f"v{v}"] = F.when(has_prev & has_next, (c - a) / 2).when(has_next, c - b).when(has_prev, b - a).otherwise(0.0)
    return points.withColumns(out)


def local_quadratic(points: DataFrame, keys: list[str], value: str, weight: str, out: str, frame: str = "frame", reach: int = 2, least: int = 4) -> DataFrame:
    """points with `out`: the value at each frame of a weighted quadratic through the frames within reach.

    The normal equations' power sums are taken relative to each frame, so the fit's constant is the answer; with fewer than
    `least` frames the value stays.
    """
    near = F.collect_list(F.struct(frame, value, weight)).over(Window.partitionBy(*keys).orderBy(frame).rangeBetween(-reach, reach))
    p = points.withColumn("_n", near)
    t = lambda e: (e[frame] - F.col(frame)).cast("double")
    power = lambda k, of: F.aggregate("_n", F.lit(0.0), lambda a, e: a + of(e) * F.pow(t(e), F.lit(float(k))))
    s = [power(k, lambda e: e[weight]) for k in range(5)]
    m = [power(k, lambda e: e[weight] * e[value]) for k in range(3)]
    p = p.withColumns({f"_s{k}": c for k, c in enumerate(s)} | {f"_m{k}": c for k, c in enumerate(m)})
    s, m = [F.col(f"_s{k}") for k in range(5)], [F.col(f"_m{k}") for k in range(3)]
    det = s[0] * (s[2] * s[4] - s[3] * s[3]) - s[1] * (s[1] * s[4] - s[2] * s[3]) + s[2] * (s[1] * s[3] - s[2] * s[2])
    top = m[0] * (s[2] * s[4] - s[3] * s[3]) - s[1] * (m[1] * s[4] - m[2] * s[3]) + s[2] * (m[1] * s[3] - m[2] * s[2])
    fit = F.when(F.size("_n") >= least, F.try_divide(top, det))
    return p.withColumn(out, F.coalesce(fit, F.col(value).cast("double"))).drop("_n", *(f"_s{k}" for k in range(5)), *(f"_m{k}" for k in range(3)))


def streak_length(points: DataFrame, keys: list[str], k: float, width: float, frame: str = "frame") -> DataFrame:
    """points (speed, r, sl_meas, sl_w) with `sl`: measured half-lengths and the exposure model k * speed, averaged over two frames each way.

    A neighbour counts half, its value rescaled to this row's speed if both move; a row without any measurement near takes the
    model. The length is at most 0.75 speed + 0.5 r, and 4 % of the width.
    """
    w = Window.partitionBy(*keys).orderBy(frame).rangeBetween(-2, 2)
    has = F.col("sl_meas").isNotNull() & (F.col("sl_w") > 0)
    part = lambda cond, e: F.sum(F.when(has & cond, e)).over(w)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    fast = F.col("speed") > 2
    p = points.withColumns({
        "_wv": zero(part(F.lit(True), F.col("sl_w") * F.col("sl_meas") * 0.5)), "_wr": zero(part(fast, F.col("sl_w") * F.col("sl_meas") / F.col("speed") * 0.5)),
        "_ws": zero(part(~fast, F.col("sl_w") * F.col("sl_meas") * 0.5)), "_w": zero(part(F.lit(True), F.col("sl_w") * 0.5)), "_own": zero(F.when(has, 0.5 * F.col("sl_w"))), "_near": zero(part(F.lit(True), F.lit(1.0))),
    })
    model = k * F.col("speed")
    others = F.when(fast, F.col("_wr") * F.col("speed") + F.col("_ws")).otherwise(F.col("_wv"))
    num = 0.3 * model + others + F.col("_own") * zero(F.col("sl_meas"))
    sl = F.when(F.col("_near") > 0, num / (0.3 + F.col("_w") + F.col("_own"))).otherwise(model)
    cap = F.least(0.75 * F.col("speed") + 0.5 * F.col("r"), F.lit(0.04 * width))
    return p.withColumn("sl", F.greatest(F.lit(0.0), F.least(sl, cap))).drop("_wv", "_wr", "_ws", "_w", "_own", "_near")


def streak_angle(points: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """points (vx, vy, ang_meas, ang_w) with `sa`: directions averaged as doubled angles with the motion's, turned along the motion."""
    w = Window.partitionBy(*keys).orderBy(frame).rangeBetween(-2, 2)
    has = F.col("ang_meas").isNotNull() & (F.col("ang_w") > 0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    term = lambda f: 0.5 * zero(F.sum(F.when(has, F.col("ang_w") * f(2 * F.col("ang_meas")))).over(w)) + 0.5 * zero(F.when(has, F.col("ang_w") * f(2 * F.col("ang_meas"))))
    speed, va = F.hypot("vx", "vy"), F.atan2("vy", "vx")
    wv = F.when(speed > 1, 0.3 * F.least(F.lit(1.0), speed / 8)).otherwise(0.0)
    p = points.withColumns({"_c": term(F.cos) + wv * F.cos(2 * va), "_s": term(F.sin) + wv * F.sin(2 * va)})
    a = F.when((F.col("_c") != 0) | (F.col("_s") != 0), 0.5 * F.atan2("_s", "_c")).otherwise(va)
    a = F.when((speed > 1) & (F.cos(a - va) < 0), a + math.pi).otherwise(a)
    return p.withColumn("sa", wrap_angle(a)).drop("_c", "_s")


def box_filter(points: DataFrame, keys: list[str], value: str, out: str, frame: str = "frame", reach: int = 2) -> DataFrame:
    """Moving mean whose window is filled up with the first and last value at the ends."""
    w, all_ = _w(keys, frame), _w(keys, frame).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ahead, behind = F.row_number().over(w) - 1, F.count("*").over(all_) - F.row_number().over(w)
    lack = lambda n: F.greatest(F.lit(0), reach - n)
    total = F.sum(value).over(w.rowsBetween(-reach, reach)) + lack(ahead) * F.first(value).over(all_) + lack(behind) * F.last(value).over(all_)
    return points.withColumn(out, total / (2 * reach + 1))


def dense(points: DataFrame, keys: list[str], values: list[str], frame: str = "frame") -> DataFrame:
    """A row for every frame from each key's first to last; missing values are null."""
    grid = points.groupBy(*keys).agg(F.min(frame).alias("_a"), F.max(frame).alias("_b")).select(*keys, F.explode(F.sequence("_a", "_b")).alias(frame))
    return grid.join(points.select(*keys, frame, *values), [*keys, frame], "left")


def _back(keys: list[str], frame: str) -> WindowSpec:
    """This row and all after it, as a window that grows row by row (from the last row on)."""
    return Window.partitionBy(*keys).orderBy(F.desc(frame)).rowsBetween(Window.unboundedPreceding, 0)


def fill_linear(grid: DataFrame, keys: list[str], value: str, out: str, frame: str = "frame") -> DataFrame:
    """Null values between known ones by linear interpolation, beyond them by the nearest."""
    w = _w(keys, frame)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(frame).alias("f"), F.col(value).alias("v")))
    lo = F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    hi = F.last(known, ignorenulls=True).over(_back(keys, frame))
    g = grid.withColumns({"_lo": lo, "_hi": hi})
    x = F.col("_lo.v") + (F.col("_hi.v") - F.col("_lo.v")) * (F.col(frame) - F.col("_lo.f")) / (F.col("_hi.f") - F.col("_lo.f"))
    return g.withColumn(out, F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_lo").isNull(), F.col("_hi.v")).when(F.col("_hi").isNull(), F.col("_lo.v")).otherwise(x)).drop("_lo", "_hi")


def _padded(grid: DataFrame, keys: list[str], value: str, reach: int, frame: str) -> tuple[Column, Column]:
    """The values within reach as an array, and how many must be repeated before its first and after its last."""
    w = _w(keys, frame)
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = F.collect_list(value).over(w.rowsBetween(-reach, reach))
    ahead, behind = F.row_number().over(w) - 1, F.count("*").over(all_) - F.row_number().over(w)
    lack = lambda n: F.greatest(F.lit(0), reach - n).cast("int")
    return near, F.struct(lack(ahead).alias("before"), lack(behind).alias("after"))


def _window_array(near: str, lack: str) -> Column:
    n = F.col(near)
    return F.concat(F.array_repeat(n[0], F.col(f"{lack}.before")), n, F.array_repeat(F.element_at(n, -1), F.col(f"{lack}.after")))


def median_filter(grid: DataFrame, keys: list[str], value: str, out: str, frame: str = "frame", reach: int = 6) -> DataFrame:
    """The middle of 2 * reach + 1 values, the end ones repeated beyond the ends. Needs a dense grid without nulls."""
    near, lack = _padded(grid, keys, value, reach, frame)
    g = grid.withColumns({"_near": near, "_lack": lack})
    return g.withColumn(out, F.sort_array(_window_array("_near", "_lack"))[reach]).drop("_near", "_lack")


def gauss_filter(grid: DataFrame, keys: list[str], value: str, weight: str, out: str, frame: str = "frame", sigma: float = 6.0) -> DataFrame:
    """Weighted Gaussian mean over four sigmas each way, end values repeated beyond the ends."""
    reach = int(4 * sigma + 0.5)
    kernel = F.array(*(F.lit(math.exp(-0.5 * (k / sigma) ** 2)) for k in range(-reach, reach + 1)))
    g = grid.withColumns({"_p": F.col(weight) * F.col(value)})
    (a, lack), (b, _) = _padded(g, keys, "_p", reach, frame), _padded(g, keys, weight, reach, frame)
    g = g.withColumns({"_a": a, "_b": b, "_lack": lack})
    dot = lambda c: F.aggregate(F.zip_with(_window_array(c, "_lack"), kernel, lambda v, k: v * k), F.lit(0.0), lambda s, v: s + v)
    return g.withColumn(out, dot("_a") / dot("_b")).drop("_p", "_a", "_b", "_lack")


def runs(points: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """first, last, n of each run of consecutive frames."""
    island = F.col(frame) - F.row_number().over(_w(keys, frame))
    return points.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min(frame).alias("first"), F.max(frame).alias("last"), F.count("*").alias("n")).drop("_i")


def breaks(points: DataFrame, keys: list[str], shot: str, max_gap: int = 8, frame: str = "frame") -> DataFrame:
    """points with `is_break` (first of a key, a new shot, or too long a gap) and `span`, a running number of breaks."""
    w = _w(keys, frame)
    new = F.coalesce((F.col(shot) != F.lag(shot).over(w)) | (F.col(frame) - F.lag(frame).over(w) > max_gap + 1), F.lit(True))
    p = points.withColumn("is_break", new)
    return p.withColumn("span", F.sum(F.col("is_break").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def visits(points: DataFrame, keys: list[str], gap: int = 2, frame: str = "frame") -> DataFrame:
    """frames, span, visits by key: distinct frames, from first to last, and how often the key was come back to."""
    d = points.select(*keys, frame).distinct()
    back = (F.col(frame) - F.lag(frame).over(_w(keys, frame)) > gap).cast("int")
    return d.withColumn("_b", back).groupBy(*keys).agg(F.count("*").alias("frames"), (F.max(frame) - F.min(frame)).alias("span"), (1 + F.coalesce(F.sum("_b"), F.lit(0))).alias("visits"))


def shots(frames: DataFrame, cuts: DataFrame, key: str = "video_id", frame: str = "frame") -> DataFrame:
    """frames with `shot_id`, the number of cuts at or before each."""
    both = frames.withColumn("_cut", F.lit(0)).unionByName(cuts.select(key, frame).withColumn("_cut", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(frame).rangeBetween(Window.unboundedPreceding, 0)
    return both.withColumn("shot_id", F.sum("_cut").over(w)).where("_cut = 0").drop("_cut")


def detected_neighbours(points: DataFrame, keys: list[str], detected: str, frame: str = "frame") -> DataFrame:
    """points with prev_dist and next_dist, the frames to the nearest detected ones, and decay by the nearer."""
    w = _w(keys, frame)
    at = F.when(F.col(detected), F.col(frame))
    p = points.withColumns({"prev_dist": F.col(frame) - F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "next_dist": F.last(at, ignorenulls=True).over(_back(keys, frame)) - F.col(frame)})
    gap = F.col("prev_dist") + F.col("next_dist") - 1
    return p.withColumn("decay", F.pow(F.when(gap <= 4, 0.93).otherwise(0.85), F.least("prev_dist", "next_dist").cast("double")))


def temporal_stack(frames: DataFrame, keys: list[str], value: str, frame: str = "frame") -> DataFrame:
    """frames with `stack`: this frame's value and the two before it in its shot, or after it where there are none."""
    w = _w(keys, frame)
    b1, b2, a1, a2 = F.lag(value).over(w), F.lag(value, 2).over(w), F.lead(value).over(w), F.lead(value, 2).over(w)
    v = F.col(value)
    return frames.withColumn("stack", F.when(b2.isNotNull(), F.array(v, b1, b2)).when(a2.isNotNull(), F.array(v, a1, a2)).when(b1.isNotNull() & a1.isNotNull(), F.array(v, b1, a1)).otherwise(F.array(v, F.coalesce(b1, a1, v), F.coalesce(b1, a1, v))))


def unsorted(points: DataFrame, keys: list[str], order: str, t: str = "t") -> DataFrame:
    """The rows whose time is less than that of the row before."""
    return points.withColumn("_p", F.lag(t).over(_w(keys, order))).where(F.col(t) < F.col("_p")).drop("_p")


def top_k(points: DataFrame, keys: list[str], by: str, tie: str, k: int = 4) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(by), tie)
    return points.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def spaced(n: Column, k: int) -> Column:
    """At most k distinct places spread evenly over 0 .. n - 1, halves rounded to even."""
    step = (n - 1) / F.lit(float(max(1, k - 1)))
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.bround(i * step, 0).cast("int"))))
