"""From candidates and packed frames to final rows: tracking, refinement on the frames' pixels, gap recovery, ring colours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import TrackParams
from ..operators import crops, pixels, recover, series
from ..operators.gapfill import track
from ..operators.search import planned
from ..tables import table
from .finalize import finalize, ring_pass

#: Fixed values. How far detections lead a streak's centre, in frames of motion; half a window and how far a ball must be from the place its background is
#: taken at, as shares of the width.
LEAD, HALF, LEAST_HALF, APART = 0.45, 0.022, 20, 0.008


def measured(points: DataFrame, cuts: DataFrame, files: DataFrame, width: float, height: float, key: str = "video_id") -> DataFrame:
    """key, frame and pixels.MEASURED of the points of a track whose balls stand out from the frames around them."""
    p = series.velocity(points, [key, "shot_id", "piece"]).withColumn("pace", F.hypot("vx", "vy"))
    centre = lambda c: F.coalesce(f"raw_{c}", c) - LEAD * F.col(f"v{c}")
    p = p.select(
        key, "frame", F.col("x").alias("px"), F.col("y").alias("py"), centre("x").alias("cx"), centre("y").alias("cy"), F.lit(max(LEAST_HALF, round(HALF * width))).alias("half"),
        F.greatest(F.lit(0.008 * width), 0.6 * F.col("pace") + 0.005 * width).alias("away"), (0.004 + 0.5 * F.col("pace") / width).alias("search"),
    )
    wanted = p.withColumn("box", crops.square(F.col("cx"), F.col("cy"), F.col("half"), width, height)).where("box IS NOT NULL")
    still = F.hypot(F.col("qx") - F.col("px"), F.col("qy") - F.col("py")) < APART * width
    seen = crops.differences(crops.cut(crops.with_background(wanted, points, still, cuts, files, key), files, key), wanted, key)
    ready = seen.join(wanted.select(key, "frame", "cx", "cy", "search"), [key, "frame"]).withColumns({"cx": F.col("cx") - F.col("x0"), "cy": F.col("cy") - F.col("y0")})
    got = pixels.measure(ready, [key, "frame", "x0", "y0"], width)
    return got.withColumns({"x": F.col("x") + F.col("x0"), "y": F.col("y") + F.col("y0")}).drop("x0", "y0")


def refined(points: DataFrame, cuts: DataFrame, files: DataFrame, width: float, height: float, p: TrackParams = TrackParams(), key: str = "video_id", rings: bool = True) -> DataFrame:
    """finalize.finalize() of a track by what its frames show, and each row's ring colour by the pixels around the ball."""
    final = table(finalize(points, table(measured(points, cuts, files, width, height, key), "measured"), width, height, key), "final")
    if not rings:
        return final
    boxes = final.withColumn("box", crops.ring_box(width, height)).where("box IS NOT NULL").select(key, "frame", F.lit(0).alias("offset"), F.col("frame").alias("other"), "box")
    return ring_pass(final, crops.luminances(crops.cut(boxes, files, key), final, key), p.max_gap, key)


def processed(candidates: DataFrame, cuts: DataFrame, files: DataFrame, width: float, height: float, fps: float, p: TrackParams = TrackParams(), key: str = "video_id", recovery: bool = True) -> DataFrame:
    """Final rows (finalize.finalize(), ring) of the whole chain over candidates (key, frame, cand_idx, x, y, score) and the files their videos are in.

    With recovery, frames without a detection near the track are searched in their pixels, and what is found is tracked along with the rest.
    Frames are read as windows only; what is shuffled is rows and windows.
    """
    first = table(track(candidates, cuts, width, height, fps, p, key), "first")
    if recovery:
        final = refined(first, cuts, files, width, height, p, key, rings=False)
        detected = first.where("detected").select(key, "frame", "shot_id", "x", "y")
        plan = table(planned(detected, cuts, files.select(key, F.col("n").alias("n_frames")), width, key=key), "plan")
        found = recover.search_frames(plan, detected, final.select(key, "frame", "r"), cuts, files, width, height, key)
        cols = [key, "frame", "cand_idx", "x", "y", "score"]
        both = table(candidates.select(*cols).unionByName(recover.recovered(found, key).select(*cols)), "candidates")
        first = table(track(both, cuts, width, height, fps, p, key), "again")
    return refined(first, cuts, files, width, height, p, key)
