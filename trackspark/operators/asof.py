"""As-of lookups in both directions with tolerances: one shuffle by key and a sort each way, no range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EPS, EPS_PREVIEW, INTERP_FRAMES, NEAREST_FRAMES

#: Rows and probes of a key beyond which its times are cut into PARTS stretches, looked up GROUP at a time.
LONG, PARTS, GROUP = 1_000_000, 256, 16


def time_cuts(rows: DataFrame, probes: DataFrame, key: str, t: str) -> DataFrame | bool:
    """key, _cuts of the keys with more than LONG rows and probes: times that cut each into about equal parts; False without such keys.

    Counts all keys at once; what comes to the driver is PARTS times for each long key.
    """
    both = rows.select(key, F.col(t).cast("double").alias("_v")).unionAll(probes.select(key, F.col(t).cast("double")))
    long = both.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > LONG).select(F.col(key).alias("_k")).collect()
    if not long:
        return False
    names = rows.sparkSession.createDataFrame(long, f"_k {both.schema[key].dataType.simpleString()}")
    at = both.join(F.broadcast(names), F.col(key).eqNullSafe(F.col("_k"))).groupBy("_k").agg(F.percentile_approx("_v", [k / PARTS for k in range(1, PARTS)]).alias("v")).collect()
    cuts = [(r["_k"], sorted(set(r["v"] or []))) for r in at]
    grouped = [(k, [v[i : i + GROUP] for i in range(0, len(v), GROUP)]) for k, v in cuts]
    return rows.sparkSession.createDataFrame(grouped, f"_k {both.schema[key].dataType.simpleString()}, _cuts array<array<double>>")


def _stretch(cuts: Column, at: Column) -> Column:
    """How many cuts lie before a time; 0 without cuts or time."""
    group = F.size(F.filter(cuts, lambda g: F.element_at(g, -1) < at))
    return F.coalesce(group * GROUP + F.coalesce(F.size(F.filter(F.get(cuts, group), lambda v: v < at)), F.lit(0)), F.lit(0))


def neighbours(rows: DataFrame, probes: DataFrame, key: str, t: str, eps: float = 0.0, extra: list[str] | None = None, cuts: DataFrame | bool | None = None) -> DataFrame:
    """Probes (key, t, and the columns of `extra`) with `lo`, the last row at or before t + eps, and `hi`, the first after it.

    lo and hi are structs of the rows' columns. Rows and probes of a key are merged in one window; a row that ties with a probe
    comes first. Rows without a time are ignored; a probe without one keeps null neighbours. Both frames start at the window's
    beginning, the second one's in descending order, so they grow row by row and cost is linear in a key's rows. A long key (see
    time_cuts, whose answer may be given) is cut into stretches of time, a window each; what a stretch lacks comes from those beside it.
    """
    extra = extra or []
    cuts = time_cuts(rows, probes, key, t) if cuts is None else cuts
    row = F.struct(t, *(c for c in rows.columns if c not in (key, t)))
    a = rows.where(F.col(t).isNotNull()).select(key, F.col(t).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast("double").alias("_t"), row.alias("_row"), *(F.lit(None).cast(probes.schema[c].dataType).alias(c) for c in extra))
    b = probes.select(key, (F.col(t) + eps).alias("_at"), F.lit(1).alias("_side"), F.col(t).cast("double").alias("_t"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *extra)
    both = a.unionByName(b)
    part = [key]
    if cuts is not False:
        both = both.join(F.broadcast(cuts), F.col(key).eqNullSafe(F.col("_k")), "left").withColumn("_part", _stretch(F.col("_cuts"), F.col("_at"))).withColumn("_long", F.col("_cuts").isNotNull()).drop("_k", "_cuts")
        part = [key, "_part"]
    order = Window.partitionBy(*part).orderBy("_at", "_side")
    lo = F.last("_row", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(*part).orderBy(F.desc("_at"), F.desc("_side"))
    hi = F.last("_row", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    found = both.select(*part, "_side", F.col("_t").alias(t), lo.alias("lo"), hi.alias("hi"), *extra).where("_side = 1").drop("_side")
    if cuts is False:
        return found
    time = F.when(F.col("_side") == 0, F.col("_at"))
    ends = both.where("_long").groupBy(*part).agg(F.min_by("_row", time).alias("_first"), F.max_by("_row", time).alias("_last"))
    along = Window.partitionBy(key).orderBy("_part")
    before = F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_first", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
    ends = ends.select(F.col(key).alias("_k"), F.col("_part").alias("_p"), before.alias("_before"), after.alias("_after"))
    found = found.join(F.broadcast(ends), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")), "left")
    return found.select(key, t, F.coalesce("lo", "_before").alias("lo"), F.coalesce("hi", "_after").alias("hi"), *extra)


def _between(a: str, w: Column) -> Column:
    return F.col(f"lo.{a}") * (1 - w) + F.col(f"hi.{a}") * w


def sample_overlay(rows: DataFrame, segments: DataFrame, probes: DataFrame, fps: float, min_conf: float = 0.5, key: str = "video_id") -> DataFrame:
    """What the overlay shows at each probe: key, t, mode, and x, y, r, sl, sa, conf, ring, flags where something is drawn.

    Segments must be disjoint (see intervals.union). Interpolated between rows at most INTERP_FRAMES apart, else the nearest row
    within NEAREST_FRAMES (the earlier on a tie); `outside` of all segments, `none`, or `lowconf` below min_conf.
    """
    cuts = time_cuts(rows, probes, key, "t")
    seg = neighbours(segments.select(key, F.col("start").alias("t"), F.col("end").alias("_end")), probes.select(key, "t"), key, "t", EPS, cuts=cuts)
    inside = seg.select(key, "t", (F.col("t") <= F.col("lo._end") + EPS).alias("_in"))
    d = neighbours(rows, inside, key, "t", EPS, extra=["_in"], cuts=cuts)
    gap, near = INTERP_FRAMES / fps + EPS, NEAREST_FRAMES / fps + EPS
    lo, hi, t = F.col("lo.t"), F.col("hi.t"), F.col("t")
    span = hi - lo
    w = F.when(span > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (t - lo) / span))).otherwise(0.0)
    interp = F.coalesce(span <= gap, F.lit(False))
    d_lo, d_hi = F.coalesce(t - lo, F.lit(float("inf"))), F.coalesce(hi - t, F.lit(float("inf")))
    use_lo = F.when(interp, w <= 0.5).otherwise(d_lo <= d_hi)
    hit = interp | (F.least(d_lo, d_hi) <= near)
    pick = lambda c: F.when(use_lo, F.col(f"lo.{c}")).otherwise(F.col(f"hi.{c}"))
    mix = lambda c: F.when(interp, _between(c, w)).otherwise(pick(c))
    conf = mix("conf")
    mode = F.when(~F.coalesce(F.col("_in"), F.lit(False)), "outside").when(~hit, "none").when(conf < min_conf, "lowconf").when(interp, "interp").otherwise("nearest")
    shown = mode.isin("interp", "nearest")
    return d.select(key, "t", mode.alias("mode"), *(F.when(shown, e).alias(n) for n, e in [*((c, mix(c)) for c in ("x", "y", "r", "sl", "conf")), *((c, pick(c)) for c in ("sa", "ring", "flags"))]))


def sample_preview(rows: DataFrame, probes: DataFrame, fps: float, min_conf: float = 0.5, key: str = "video_id") -> DataFrame:
    """The preview's lookup: rows below min_conf do not count, conf comes from the nearest row, segments are not asked."""
    d = neighbours(rows.where(F.col("conf") >= min_conf), probes.select(key, "t"), key, "t", -1e-12)
    lo, hi, t = F.col("lo.t"), F.col("hi.t"), F.col("t")
    span = hi - lo
    interp = F.coalesce(span <= INTERP_FRAMES / fps + EPS_PREVIEW, F.lit(False))
    w = F.when(span > 0, (t - lo) / span).otherwise(0.0)
    d_lo, d_hi = F.coalesce(F.abs(t - lo), F.lit(float("inf"))), F.coalesce(F.abs(hi - t), F.lit(float("inf")))
    hit = interp | (F.least(d_lo, d_hi) <= NEAREST_FRAMES / fps + EPS)
    pick = lambda c: F.when(d_lo <= d_hi, F.col(f"lo.{c}")).otherwise(F.col(f"hi.{c}"))
    mix = lambda c: F.when(interp, _between(c, w)).otherwise(pick(c))
    return d.where(hit).select(key, "t", *(mix(c).alias(c) for c in ("x", "y", "r", "sl")), *(pick(c).alias(c) for c in ("sa", "ring", "conf", "flags")))


def linear_at(rows: DataFrame, probes: DataFrame, value: str, key: str = "video_id", t: str = "t") -> DataFrame:
    """key, t, value by linear interpolation over any gap; the end values hold beyond the ends."""
    d = neighbours(rows.select(key, t, value), probes.select(key, t), key, t)
    lo, hi = F.col(f"lo.{t}"), F.col(f"hi.{t}")
    w = (F.col(t) - lo) / (hi - lo)
    return d.select(key, t, F.when(lo.isNull(), F.col(f"hi.{value}")).when(hi.isNull(), F.col(f"lo.{value}")).otherwise(_between(value, w)).alias(value))
