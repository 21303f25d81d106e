"""Saving tracks: validate, merge with what is stored, write, and tell the table of videos."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import intervals, jobs, merge, validate
from ..sources import tracks
from ..tables import table


class InvalidTrackError(ValueError):
    """A track that may not be saved; nothing has been written."""


def check(rows: DataFrame) -> None:
    """Raises InvalidTrackError with the first broken rule of one bad track; rows are judged in their order of `pos`."""
    bad = validate.first_violation(rows).orderBy("video_id").first()
    if bad:
        raise InvalidTrackError(f"{bad.video_id}: row {bad.pos}: {bad.rule}")


def refuse_bad_segments(segments: DataFrame) -> None:
    """Raises InvalidTrackError if a segment ends before it starts, or has no bounds."""
    odd = segments.where(~F.coalesce(F.col("end") >= F.col("start"), F.lit(False))).orderBy("video_id").first()
    if odd:
        raise InvalidTrackError(f"{odd.video_id}: bad segment")


def save_tracks(rows: DataFrame, segments: DataFrame, videos: DataFrame, heads: DataFrame, path: str, replace: bool = False) -> DataFrame:
    """The table of videos after the tracks of `rows` (with pos, their place in the track) and `segments` are in the store at `path`.

    heads: video_id, url, at of every track that is saved. A video that has a track (track_path is not null) keeps its rows and segments outside the
    new segments, unless `replace`; videos.segments is array<struct<start, end>>. All tracks are validated before anything is
    written, as they come and as they are after the merge; only their folders are replaced. A track that would be left without rows is refused, as is a
    segment that ends before it starts. Empty heads change nothing. Nothing but one broken rule passes the driver.
    """
    mine = heads.select("video_id")
    refuse_bad_segments(segments)
    check(rows)
    new = {"rows": rows.drop("pos").join(mine, "video_id", "left_semi"), "segments": segments.select("video_id", "start", "end").join(mine, "video_id", "left_semi")}
    known = videos.where("track_path IS NOT NULL").join(mine, "video_id", "left_semi")
    both = new
    if not replace and not known.isEmpty():
        stored = rows.sparkSession.read.parquet(path)
        wanted = known.select(F.col("video_id").cast(stored.schema["video_id"].dataType))  # the store's own type, so that its folders are chosen before they are read
        stored = stored.join(wanted, "video_id", "left_semi").withColumn("video_id", F.col("video_id").cast(rows.schema["video_id"].dataType))
        spans = known.select("video_id", F.explode("segments").alias("s")).select("video_id", "s.start", "s.end")
        both = merge.merge_tracks({"rows": stored, "segments": spans}, new, eps=0.0)
    kept = table(both["rows"], "tracks")  # the store is read and replaced
    check(tracks.numbered(kept))
    left = mine.join(kept, "video_id", "left_anti").orderBy("video_id").first()
    if left:
        raise InvalidTrackError(f"{left.video_id}: no rows are left")
    spans = both["segments"] if both is not new else intervals.union(new["segments"], eps=0.0)
    spans = table(spans.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("segments")), "segments")
    tracks.save(kept, path)
    saved = heads.join(spans, "video_id", "left").withColumn("track_path", F.concat(F.lit(f"{path}/video_id="), F.col("video_id").cast("string")))
    return jobs.upsert_tracks(videos, saved)
