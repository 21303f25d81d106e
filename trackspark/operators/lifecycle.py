"""What a page shows of its video, from navigations and the answers that come back: answers to an older navigation are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of events: a page turns to a video (or to none); answers about the video's record, its track, its job.
NAVIGATE, VIDEO, TRACK, JOB = "navigate", "video", "track", "job"
#: Outcomes of an answer. `invalid` is a track that does not parse.
OK, MISSING, UNREACHABLE, REFUSED, INVALID = "ok", "missing", "unreachable", "refused", "invalid"
#: Answers about a job in a row that may fail before the job counts as failed.
MOST_FAILURES = 8


def generations(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """events with `gen`, the navigations of their page so far, and `stale`: an answer (its `asked` is the generation it was asked in) to an older one."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    e = events.withColumn("gen", F.sum(F.when(F.col("kind") == NAVIGATE, 1).otherwise(0)).over(w))
    return e.withColumn("stale", (F.col("kind") != NAVIGATE) & ~F.coalesce(F.col("asked") == F.col("gen"), F.lit(False)))


def resolved(status: Column, has_job: Column, has_track: Column) -> Column:
    """What a record without a waiting track leads to; null where the track that is there goes on showing."""
    return F.when(F.coalesce(status.isin("queued", "processing") & has_job, F.lit(False)), "job").when(F.coalesce(has_track, F.lit(False)), F.lit(None)).when(status == "failed", "failed").otherwise("none")


def page_states(events: DataFrame, key: str = "page", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """key, order, gen, video_id, status, track (whether one is shown) after every event that counts; stale answers give no row.

    events have key, order, kind, asked, video_id (of a navigation), outcome, and of a record's answer status (queued, processing, ready, failed),
    has_track and has_job; of a job's answer status. A page is loading after it turned to a video, else idle. A record without a track to
    wait for decides at once, one with a track when the track's answer is there: a job that is queued or in work is followed, else
    a track is shown, else the record's failure or nothing. A job that is done waits for its track, a failed one leaves the track that was there;
    MOST_FAILURES failed questions in a row are a failure, too. All of it is windows over (page, generation).
    """
    e = generations(events, key, list(order)).where(~F.col("stale")).drop("stale")
    w = Window.partitionBy(key, "gen").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    kind, good = F.col("kind"), F.col("outcome") == OK
    last = lambda c, when: F.last(F.when(when, c), ignorenulls=True).over(w)
    record = F.struct(F.col("status").alias("status"), F.coalesce("has_track", F.lit(False)).alias("has_track"), F.coalesce("has_job", F.lit(False)).alias("has_job"))
    job_done = (kind == JOB) & good & F.col("status").isin("ready", "done")
    # what the last record said holds for the track that it sent for; a job's end sends for a fresh one
    e = e.withColumns({
        "_video": F.first(F.when(kind == NAVIGATE, F.col("video_id"))).over(w), "_record": last(record, (kind == VIDEO) & good),
        "_track": F.coalesce(F.max(F.when((kind == TRACK) & good, True)).over(w), F.lit(False)),
        "_fresh": F.coalesce(last(F.when(kind == VIDEO, False).otherwise(True), ((kind == VIDEO) & good) | job_done), F.lit(False)),
        "_told": F.sum(F.when((kind == JOB) & ~good, 0).otherwise(1)).over(w),
    })
    e = e.withColumn("_failures", F.sum(F.when((kind == JOB) & ~good, 1).otherwise(0)).over(Window.partitionBy(key, "gen", "_told").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    rec = lambda c: F.col(f"_record.{c}")
    waits = rec("has_track")  # the track's answer comes next
    after = F.coalesce(resolved(rec("status"), rec("has_job"), F.col("_track")), F.lit("ready"))
    at_video = F.when(F.col("outcome") == UNREACHABLE, "error").when(F.col("outcome") == MISSING, "none").when(~good, "error").when(~waits, after)
    at_track = F.when(F.col("_fresh"), F.when(good, "ready").otherwise("error")).otherwise(after)
    at_job = F.when(good & (F.col("status") == "failed"), F.when(F.col("_track"), "ready").otherwise("failed")).when(good, F.when(~F.col("status").isin("ready", "done"), "job")).when(F.col("_failures") >= MOST_FAILURES, "failed")
    new = F.when(kind == NAVIGATE, F.when(F.col("video_id").isNull(), "idle").otherwise("loading")).when(kind == VIDEO, at_video).when(kind == TRACK, at_track).when(kind == JOB, at_job)
    e = e.withColumn("_new", new).withColumn("state", F.coalesce(F.last("_new", ignorenulls=True).over(w), F.lit("idle")))
    return e.select(key, *order, "gen", F.col("_video").alias("video_id"), F.col("state").alias("status"), F.col("_track").alias("track"))
