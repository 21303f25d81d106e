"""Gap recovery: frames without a detection are searched near the track, and what is found is tracked along with the rest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TrackParams
from ..tables import table
from . import crops
from .asof import linear_at
from .gapfill import track
from .pixels import lost_balls
from .search import planned

#: A found blob's score as a candidate, and the least that counts.
BASE, GAIN, LEAST = 0.25, 0.35, 0.15
#: Fixed values, as shares of the width: the widest search, and what a search's window shows around it.
WIDEST, AROUND = 0.06, 0.015
#: Frames from which a crop's background is taken; how unlike a good one may be, and how many serve.
OFFSETS, UNLIKE, GOOD, ELSE = (4, 8, 12), 12.0, 4, 3


def recovered(found: DataFrame, key: str = "video_id") -> DataFrame:
    """Candidates (cand_idx -1) from what a search found: key, frame, x, y, score."""
    return found.where(F.col("score") > LEAST).select(key, "frame", F.lit(-1).alias("cand_idx"), "x", "y", (BASE + GAIN * F.col("score")).alias("score"))


def retrack(candidates: DataFrame, cuts: DataFrame, n_frames: DataFrame, search: Callable[[DataFrame], DataFrame], width: float, height: float, fps: float, p: TrackParams = TrackParams(), key: str = "video_id") -> DataFrame:
    """track() over the candidates and those that `search` recovers for the frames planned from a first run.

    search takes key, frame, x, y, radius (see search.planned) and gives key, frame, x, y, score: pixels.lost_balls over
    crops of those frames, or any other. Both runs are whole; nothing of them passes the driver.
    """
    first = track(candidates, cuts, width, height, fps, p, key)
    plan = table(planned(first.where("detected"), cuts, n_frames, width, key=key), "plan")
    cols = [key, "frame", "cand_idx", "x", "y", "score"]
    both = table(candidates.select(*cols).unionByName(recovered(search(plan), key).select(*cols)), "candidates")
    return track(both, cuts, width, height, fps, p, key)


def search_frames(plan: DataFrame, detected: DataFrame, radii: DataFrame, cuts: DataFrame, files: DataFrame, width: float, height: float, key: str = "video_id") -> DataFrame:
    """key, frame, x, y, score of the balls that the planned frames' pixels show near their predicted places.

    plan is search.planned()'s, detected has key, frame, x, y, radii has key, frame, r (read between its frames), files is
    sources.frames.frame_files(). The radius of a search is at most WIDEST of the width. A ball's speed is that between its detections within two
    frames, which bounds how long a streak may be.
    """
    plan = plan.withColumn("radius", F.least(F.col("radius"), F.lit(WIDEST * width)))
    plan = plan.withColumn("half", F.ceil(F.col("radius") + AROUND * width).cast("int"))
    wanted = plan.withColumnsRenamed({"x": "px", "y": "py"})
    wanted = wanted.withColumn("box", crops.square(F.col("px"), F.col("py"), F.col("half"), width, height)).where("box IS NOT NULL")
    still = (F.abs(F.col("qx") - F.col("px")) < F.col("half")) & (F.abs(F.col("qy") - F.col("py")) < F.col("half"))
    seen = crops.differences(crops.cut(crops.with_background(wanted, detected, still, cuts, files, key), files, key), key=key)
    at = plan.select(key, "frame", F.explode(F.array(*map(F.lit, (-2, -1, 1, 2)))).alias("_o")).withColumn("_f", F.col("frame") + F.col("_o"))
    near = at.join(detected.select(key, F.col("frame").alias("_f"), F.struct("frame", "x", "y").alias("_p")), [key, "_f"]).groupBy(key, "frame").agg(F.min("_p").alias("a"), F.max("_p").alias("b"), F.count("*").alias("n"))
    pace = F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y")) / F.greatest(F.lit(1), F.col("b.frame") - F.col("a.frame"))
    near = near.select(key, "frame", F.when(F.col("n") >= 2, pace).otherwise(0.0).alias("speed"))
    size = linear_at(radii, plan.select(key, "frame"), "r", key, "frame").withColumnRenamed("r", "expected")
    ready = seen.join(wanted.select(key, "frame", "px", "py", "radius"), [key, "frame"]).join(size, [key, "frame"]).join(near, [key, "frame"], "left")
    ready = ready.withColumns({"px": F.col("px") - F.col("x0"), "py": F.col("py") - F.col("y0"), "speed": F.coalesce("speed", F.lit(0.0))})
    found = lost_balls(ready, [key, "frame", "x0", "y0"])
    return found.select(key, "frame", (F.col("x") + F.col("x0")).alias("x"), (F.col("y") + F.col("y0")).alias("y"), "score")


def background_frames(wanted: DataFrame, frames: DataFrame, mismatch: Callable[[str, str], Column], near: float, key: str = "video_id") -> DataFrame:
    """key, frame, other, offset, mismatch, rank: the frames whose crops make the background of each wanted frame.

    wanted and frames have key, frame, shot_id, x, y (the ball, null where unknown) and what mismatch compares. Frames of
    the same shot at the OFFSETS before and after, where the ball is not within `near` of the wanted place; like ones first, then
    close ones, then by mismatch: GOOD of the like ones, or where there are none, ELSE of the rest.
    """
    w = wanted.withColumn("offset", F.explode(F.array(*(F.lit(s * o) for o in OFFSETS for s in (-1, 1))))).withColumn("other", F.col("frame") + F.col("offset")).alias("w")
    o = frames.withColumnRenamed("frame", "other").alias("o")
    j = w.join(o, (F.col(f"w.{key}") == F.col(f"o.{key}")) & (F.col("w.other") == F.col("o.other")) & (F.col("w.shot_id") == F.col("o.shot_id")))
    away = F.coalesce(F.hypot(F.col("w.x") - F.col("o.x"), F.col("w.y") - F.col("o.y")) > near, F.lit(True))
    j = j.where(away).select(F.col(f"w.{key}").alias(key), "w.frame", "w.other", "w.offset", mismatch("w", "o").alias("mismatch"))
    unlike = F.col("mismatch") > UNLIKE
    each = Window.partitionBy(key, "frame")
    j = j.withColumns({"rank": F.row_number().over(each.orderBy(unlike, F.abs("offset"), "mismatch", "offset")), "_good": F.sum((~unlike).cast("int")).over(each)})
    return j.where(F.when(F.col("_good") > 0, ~unlike & (F.col("rank") <= GOOD)).otherwise(F.col("rank") <= ELSE)).drop("_good")


def paired(a: DataFrame, b: DataFrame, cols: list[str], tol: float = 1e-6, key: str = "video_id", t: str = "t") -> DataFrame:
    """Rows of a and b of one key whose times are within tol, the columns of b as other_<col>: an equality of buckets, not a range join."""
    bucket = lambda c: F.floor(F.col(c) / tol).cast("bigint")
    left = a.withColumn("_b", bucket(t))
    right = b.select(key, F.col(t).alias("_t"), *(F.col(c).alias(f"other_{c}") for c in cols), F.explode(F.array(bucket(t) - 1, bucket(t), bucket(t) + 1)).alias("_b"))
    return left.join(right, [key, "_b"]).where(F.abs(F.col(t) - F.col("_t")) <= tol).drop("_b", "_t")


def errors(pairs: DataFrame, error: Column, key: str = "video_id") -> DataFrame:
    """key, n, mean_error, max_error."""
    return pairs.withColumn("_e", error).groupBy(key).agg(F.count("*").alias("n"), F.avg("_e").alias("mean_error"), F.max("_e").alias("max_error"))


def source_time(frames: DataFrame, packets: DataFrame, offset: float, first: int = 0, key: str = "video_id") -> DataFrame:
    """frames (numbered from the clip's beginning) with t, the source's time by the packets' times (key, frame, pts), and frame counted from `first`."""
    return frames.join(packets, [key, "frame"]).withColumn("t", offset + F.col("pts")).withColumn("frame", F.col("frame") + first).drop("pts")


def offset_verified(best: Column, second: Column) -> Column:
    """Whether a clip's offset is certain: the best error is small, and less than half of the next one's."""
    return F.coalesce((best < 0.5 * second) & (best < 30.0), F.lit(False))


def dismissals(old: DataFrame, events: DataFrame, now: float, keep: float, key: str = "video_id") -> DataFrame:
    """key, at of what is dismissed after events (key, at, dismissed) on top of old ones: the last word of each key counts, and old ones lapse."""
    every = old.select(key, "at", F.lit(True).alias("dismissed")).unionByName(events.select(key, "at", "dismissed"))
    last = every.groupBy(key).agg(F.max_by("dismissed", F.struct("at", ~F.col("dismissed"))).alias("_d"), F.max("at").alias("at"))
    return last.where(F.col("_d") & (F.col("at") > now - keep)).select(key, "at")
