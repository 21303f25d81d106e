"""Sets of intervals by key: union, cover, clipping, membership and anti join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import neighbours

#: Parts of 0 to 1 by which shares are looked up.
SHARES = 1024


def union(segments: DataFrame, key: str = "video_id", eps: float = 1e-6) -> DataFrame:
    """Disjoint key, start, end: overlapping and touching (within eps) intervals become one."""
    before = Window.partitionBy(key).orderBy("start", "end")
    upto = before.rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end").over(upto)
    s = segments.select(key, "start", "end").withColumn("_new", F.coalesce((F.col("start") > reach + eps).cast("int"), F.lit(1)))
    s = s.withColumn("_island", F.sum("_new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def covered(segments: DataFrame, key: str = "video_id") -> DataFrame:
    return segments.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("seconds"), F.count("*").alias("n_segments"))


def clip(segments: DataFrame, lo: float, hi: float) -> DataFrame:
    """What of each interval lies within [lo, hi]; nothing of no length."""
    s = segments.withColumns({"start": F.greatest("start", F.lit(lo)), "end": F.least("end", F.lit(hi))})
    return s.where(F.col("end") > F.col("start"))


def proper(segments: DataFrame) -> DataFrame:
    return segments.where(F.col("end") > F.col("start"))


def membership(points: DataFrame, segments: DataFrame, key: str = "video_id", t: str = "t", eps: float = 1e-6) -> DataFrame:
    """points with `inside`: whether t lies in a closed interval of its key. The intervals are united first, so an as-of lookup answers."""
    rest = [c for c in points.columns if c not in (key, t)]
    u = union(segments, key, eps).select(key, F.col("start").alias(t), F.col("end").alias("_end"))
    d = neighbours(u, points, key, t, eps, extra=rest)
    return d.select(key, t, *rest, F.coalesce(F.col(t) <= F.col("lo._end") + eps, F.lit(False)).alias("inside"))


def outside(points: DataFrame, segments: DataFrame, key: str = "video_id", t: str = "t", eps: float = 1e-6) -> DataFrame:
    """The points in no interval of their key."""
    return membership(points, segments, key, t, eps).where("NOT inside").select(*points.columns)


def stages(weights: DataFrame, fractions: DataFrame) -> DataFrame:
    """fraction -> the stage whose cumulative share of all weights first reaches it (weights: pos, stage, weight); null beyond the last.

    Shares are dealt over SHARES equal parts of 0 to 1, so that the join is an equality, however many fractions there are.
    """
    w = Window.orderBy("pos")
    cum = weights.select("stage", "pos", (F.sum("weight").over(w) / F.sum("weight").over(Window.partitionBy())).alias("upto"))
    part = lambda c: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * SHARES).cast("int")
    lo = cum.withColumn("from", F.coalesce(F.lag("upto").over(w), F.lit(-1.0))).where("from < upto").withColumn("_part", F.explode(F.sequence(part(F.col("from")), part(F.col("upto")))))
    f = fractions.withColumn("_part", part(F.col("fraction"))).alias("f")
    on = (F.col("f._part") == F.col("l._part")) & (F.col("fraction") > F.col("from")) & (F.col("fraction") <= F.col("upto"))
    return f.join(lo.alias("l"), on, "left").select("fraction", "stage")
