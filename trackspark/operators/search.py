"""Where to look for a lost ball: predictions inside gaps and beyond the ends of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def plan(detected: DataFrame, n_frames: DataFrame, width: float, max_gap: int = 12, extend: int = 3, key: str = "video_id") -> DataFrame:
    """key, frame, x, y, radius for frames without a detection near the track.

    detected has key, frame, shot_id, x, y. Inside a gap of one shot the line between its ends; beyond an end whose other
    neighbour was detected too, up to `extend` frames by the last step, not past a detection, a cut or the clip's ends. Where a
    frame has several, the gap's comes first, then that of the earlier detection.
    """
    base = 0.012 * width
    w = Window.partitionBy(key).orderBy("frame")
    cols = ("frame", "shot_id", "x", "y")
    d = detected.withColumns({f"n_{c}": F.lead(c).over(w) for c in cols} | {f"p_{c}": F.lag(c).over(w) for c in cols})
    gap = F.col("n_frame") - F.col("frame") - 1
    inside = d.where((gap >= 1) & (gap <= max_gap) & (F.col("shot_id") == F.col("n_shot_id"))).withColumn("f", F.explode(F.sequence(F.col("frame") + 1, F.col("n_frame") - 1)))
    u = (F.col("f") - F.col("frame")) / (gap + 1)
    step = F.hypot(F.col("n_x") - F.col("x"), F.col("n_y") - F.col("y")) / (gap + 1)
    line = lambda c: F.col(c) + u * (F.col(f"n_{c}") - F.col(c))
    a = inside.select(key, F.col("f").alias("frame"), line("x").alias("x"), line("y").alias("y"), (base + 0.8 * step * F.least(F.col("f") - F.col("frame"), F.col("n_frame") - F.col("f"))).alias("radius"), F.lit(-1).alias("_rank"))

    def beyond(sign: int) -> DataFrame:
        back, on = ("p", "n") if sign > 0 else ("n", "p")
        e = d.where((F.col(f"{back}_frame") == F.col("frame") - sign) & (F.col(f"{on}_frame").isNull() | (F.col(f"{on}_frame") != F.col("frame") + sign)))
        e = e.join(n_frames, key).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(extend))))
        g = F.col("frame") + sign * F.col("k")
        free = F.col(f"{on}_frame").isNull() | ((F.col(f"{on}_frame") - g) * sign > 0)
        vx, vy = F.col("x") - F.col(f"{back}_x"), F.col("y") - F.col(f"{back}_y")
        e = e.where(free & (g >= 0) & (g < F.col("n_frames")))
        return e.select(key, g.alias("frame"), F.col("shot_id").alias("_shot"), (F.col("x") + vx * F.col("k")).alias("x"), (F.col("y") + vy * F.col("k")).alias("y"), (base + 0.5 * F.hypot(vx, vy) * F.col("k")).alias("radius"), (2 * F.col("frame") + (0 if sign > 0 else 1)).alias("_rank"))

    b = beyond(1).unionByName(beyond(-1))
    return a, b


def planned(detected: DataFrame, cuts: DataFrame, n_frames: DataFrame, width: float, key: str = "video_id", **kw) -> DataFrame:
    """plan() with the shots of the frames beyond the ends looked up among the cuts."""
    from .series import shots

    a, b = plan(detected, n_frames, width, key=key, **kw)
    b = shots(b, cuts, key).where(F.col("shot_id") == F.col("_shot")).drop("shot_id", "_shot")
    w = Window.partitionBy(key, "frame").orderBy("_rank")
    return a.unionByName(b).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_rank")
