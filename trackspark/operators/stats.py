"""Aggregates: run statistics, robust estimates, fits and moments."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_stats(rows: DataFrame, keys: list[str], n_frames: Column, width: float) -> DataFrame:
    """The statistics record of a track, by key; medians are null and shares 0 without rows."""
    flag = lambda b: F.count_if(F.col("flags").bitwiseAND(b) != 0)
    pct = lambda c: F.round(100.0 * c / F.greatest(F.lit(1), n_frames), 1)
    sl, r = F.col("sl") * width, F.col("r") * width
    return rows.groupBy(*keys).agg(
        F.count("*").alias("rows"), pct(F.count("*")).alias("rows_pct"), F.count_if(F.col("conf") >= 0.5).alias("rows_conf_ge_0_5"), pct(F.count_if(F.col("conf") >= 0.5)).alias("visible_pct"),
        F.count_if(sl >= 0.5 * r).alias("stadium_rows"), F.round(F.percentile(sl, 0.5), 2).alias("streak_median"), F.round(F.percentile((sl + r) / r, 0.5), 2).alias("streak_ratio_median"),
        flag(1).alias("interpolated_rows"), pct(flag(1)).alias("interpolated_pct"), (F.count("*") - flag(1)).alias("detected_rows"), flag(2).alias("bounces"), flag(4).alias("hits"),
    )


def mad_noise(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """key, median, noise = 1.4826 * median absolute deviation + 1."""
    mid = rows.groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"))
    return rows.join(mid, keys).groupBy(*keys).agg(F.first("median").alias("median"), (1.4826 * F.percentile(F.abs(F.col(value) - F.col("median")), 0.5) + 1).alias("noise"))


def _median_of(rows: DataFrame, keys: list[str], value: Column, ok: Column, least: int, default: float, top: float) -> Column:
    v = F.when(ok, value)
    return F.when(F.count(v) >= least, F.least(F.lit(top), F.greatest(F.lit(0.0), F.percentile(v, 0.5)))).otherwise(default)


def lead(rows: DataFrame, keys: list[str]) -> DataFrame:
    """key, lead: median of how far measured centres (mx, my) trail detections (x, y) along the motion, in frames."""
    v2 = F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")
    k = -((F.col("mx") - F.col("x")) * F.col("vx") + (F.col("my") - F.col("y")) * F.col("vy")) / v2
    return rows.groupBy(*keys).agg(_median_of(rows, keys, k, (F.col("weight") >= 0.5) & (v2 >= 9.0), 8, 0.45, 1.0).alias("lead"))


def exposure(rows: DataFrame, keys: list[str]) -> DataFrame:
    """key, exposure: median of measured streak half-length over speed."""
    ok = F.col("sl_meas").isNotNull() & (F.col("sl_w") >= 0.5) & (F.col("speed") >= 4.0)
    return rows.groupBy(*keys).agg(_median_of(rows, keys, F.col("sl_meas") / F.col("speed"), ok, 8, 0.25, 0.6).alias("exposure"))


def tracklet_score(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("score").alias("score"), F.count("*").alias("points"), (F.max("x") - F.min("x") + F.max("y") - F.min("y")).alias("extent"))


def quad_fit(rows: DataFrame, keys: list[str], value: str, frame: str = "frame") -> DataFrame:
    """c0, c1, c2 and n of the least-squares quadratic in frames since the key's first; fewer than 3 different frames give null."""
    base = rows.join(rows.groupBy(*keys).agg(F.min(frame).alias("_f0")), keys).withColumn("_t", (F.col(frame) - F.col("_f0")).cast("double"))
    t, v = F.col("_t"), F.col(value)
    sums = {f"s{k}": F.sum(F.pow(t, F.lit(float(k)))) for k in range(5)} | {f"m{k}": F.sum(v * F.pow(t, F.lit(float(k)))) for k in range(3)}
    g = base.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("_t").alias("_d"), *(e.alias(k) for k, e in sums.items()))
    s, m = [F.col(f"s{k}") for k in range(5)], [F.col(f"m{k}") for k in range(3)]
    det3 = lambda a, b, c: a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])
    rows_ = [[s[0], s[1], s[2]], [s[1], s[2], s[3]], [s[2], s[3], s[4]]]
    det = det3(*rows_)
    solve = lambda k: F.when(F.col("_d") >= 3, F.try_divide(det3(*[[m[i] if j == k else rows_[i][j] for j in range(3)] for i in range(3)]), det))
    return g.select(*keys, "n", *(solve(k).alias(f"c{k}") for k in range(3)))


def moments(points: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Weighted centroid and the half-axes and direction of the weighted covariance of (x, y, w).

    With `order`, whose columns must tell a key's rows apart, sums are taken in that order, so that reruns agree to the last bit.
    """
    w, x, y = F.col("w"), F.col("x"), F.col("y")
    terms = {"w": w, "sx": w * x, "sy": w * y, "sxx": w * x * x, "syy": w * y * y, "sxy": w * x * y}
    if order is None:
        g = points.groupBy(*keys).agg(*(F.sum(e).alias(n) for n, e in terms.items()))
    else:
        # running sums add row after row; the last row of a key holds them all
        ordered = Window.partitionBy(*keys).orderBy(*order)
        running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = [F.sum(e).over(running).alias(n) for n, e in terms.items()]
        g = points.select(*keys, *sums, F.lead(F.lit(1)).over(ordered).isNull().alias("_last")).where("_last")
    cx, cy = F.col("sx") / w, F.col("sy") / w
    a, b, c = F.col("sxx") / w - cx * cx, F.col("syy") / w - cy * cy, F.col("sxy") / w - cx * cy
    root = F.sqrt(F.pow((a - b) / 2, F.lit(2.0)) + c * c)
    axis = lambda sign: 2 * F.sqrt(F.greatest(F.lit(0.0), (a + b) / 2 + sign * root))
    return g.select(*keys, cx.alias("cx"), cy.alias("cy"), axis(1).alias("major"), axis(-1).alias("minor"), (0.5 * F.atan2(2 * c, a - b)).alias("angle"))


def histogram(rows: DataFrame, keys: list[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Share of each key's values by bin; values at or beyond an end fall in the end bin."""
    b = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col(value) - lo) / (hi - lo) * bins)))
    n = rows.groupBy(*keys, b.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return n.join(n.groupBy(*keys).agg(F.sum("n").alias("_all")), keys).select(*keys, "bin", (F.col("n") / F.col("_all")).alias("share"))


def bhattacharyya(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """key, distance of two histograms of shares; keys that only one side has are 1 apart."""
    p, q = a.withColumnRenamed("share", "_p"), b.withColumnRenamed("share", "_q")
    j = p.join(q, [*keys, "bin"], "full").groupBy(*keys).agg(F.sum(F.sqrt(F.coalesce("_p", F.lit(0.0)) * F.coalesce("_q", F.lit(0.0)))).alias("_s"))
    return j.select(*keys, F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("_s"))).alias("distance"))


def depth_model(rows: DataFrame, keys: list[str], height: float) -> DataFrame:
    """key, a, b of the radius a + b * y / height by iterated reweighting with the soft-L1 loss; constant medians for thin data.

    One row of at most a shot's measurements goes to each group. Rows without a positive weight are left out.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y, r, w = (pdf[c].to_numpy(float) for c in ("y", "r", "w"))
        mid = float(np.median(r))
        a, b = mid, 0.0
        if len(r) >= 8 and np.ptp(y) >= 0.1 * height:
            x, scale, u = np.c_[np.ones(len(y)), y / height], 0.3 * mid, w.copy()
            for _ in range(100):
                g = x.T * u
                new = np.linalg.lstsq(g @ x, g @ r, rcond=None)[0]
                done = np.allclose(new, (a, b), atol=1e-10)
                a, b = map(float, new)
                if done:
                    break
                u = w / np.sqrt(1 + w * (x @ new - r) ** 2 / scale**2)
            if b < 0:
                a, b = mid, 0.0
        return pdf[keys].head(1).assign(a=a, b=b)

    ok = rows.where((F.col("w") > 0) & F.col("r").isNotNull()).select(*keys, "y", "r", "w")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ok.schema.fields[: len(keys)]) + ", a double, b double"
    return ok.groupBy(*keys).applyInPandas(fit, schema)


def best_two(rows: DataFrame, keys: list[str], error: str, at: str) -> DataFrame:
    """The argument of the least error, and whether it is clear: under half the second and under 30."""
    g = rows.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct(error, at))), 1, 2).alias("_b"))
    first, second = F.col("_b")[0], F.get("_b", F.lit(1))
    return g.select(*keys, first[at].alias(at), first[error].alias(error), ((first[error] < 0.5 * F.coalesce(second[error], F.lit(float("inf")))) & (first[error] < 30)).alias("verified"))
