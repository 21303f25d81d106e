"""The job table as pure functions of DataFrames: old table and events in, new table out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import fold_sorted

ACTIVE = ("queued", "processing")


def active() -> Column:
    return F.col("status").isin(*ACTIVE)


def latest_job(videos: DataFrame, jobs: DataFrame) -> DataFrame:
    """videos with the job that speaks for each: an active one first, then the newest."""
    w = Window.partitionBy("video_id").orderBy(active().desc(), F.desc("created_at"), F.desc("job_id"))
    best = jobs.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("video_id", F.col("job_id").alias("job_id"), F.col("status").alias("job_status"))
    return videos.join(best, "video_id", "left")


def public_videos(videos: DataFrame, jobs: DataFrame) -> DataFrame:
    """video_id, status, track_url, job_id: an active job's status first, else ready with a track, else the video's own."""
    v = latest_job(videos, jobs)
    busy = F.coalesce(F.col("job_status").isin(*ACTIVE), F.lit(False))
    has = F.col("track_path").isNotNull()
    return v.select("video_id", F.when(busy, F.col("job_status")).when(has, "ready").otherwise(F.col("status")).alias("status"), F.when(has, F.concat(F.lit("/v1/tracks/"), "video_id")).alias("track_url"), F.when(busy | ~has, F.col("job_id")).alias("job_id"))


def dedupe(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """requests with the active job of exactly the same video and range (nulls equal), the oldest of several."""
    w = Window.partitionBy("video_id", "start_s", "end_s").orderBy("created_at", "job_id")
    j = jobs.where(active()).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    j = j.select(F.col("video_id").alias("_v"), F.col("start_s").alias("_s"), F.col("end_s").alias("_e"), F.col("job_id").alias("existing_job"))
    on = F.col("video_id").eqNullSafe(F.col("_v")) & F.col("start_s").eqNullSafe(F.col("_s")) & F.col("end_s").eqNullSafe(F.col("_e"))
    return requests.join(j, on, "left").drop("_v", "_s", "_e")


def submit(jobs: DataFrame, requests: DataFrame, now: str) -> DataFrame:
    """jobs and a queued one for each request without an active twin; requests carry job_id, video_id, url, start_s, end_s."""
    new = dedupe(requests, jobs).where("existing_job IS NULL").dropDuplicates(["video_id", "start_s", "end_s"])
    fresh = {"status": F.lit("queued"), "stage": F.lit("queued"), "progress": F.lit(0.0), "message": F.lit(""), "error": F.lit(None).cast("string"), "created_at": F.lit(now), "updated_at": F.lit(now)}
    return jobs.unionByName(new.withColumns(fresh).select(*jobs.columns))


def _guarded(jobs: DataFrame, events: DataFrame, when: Column, change: dict[str, Column]) -> DataFrame:
    """Columns changed for rows with an event (job_id, and e_ columns) that are in the expected state; others stay."""
    j = jobs.join(events, "job_id", "left")
    hit = F.col("e_at").isNotNull() & when
    change = change | {"updated_at": F.col("e_at")}
    return j.select(*(F.when(hit, change[c]).otherwise(F.col(c)).alias(c) if c in change else F.col(c) for c in jobs.columns))


def start(jobs: DataFrame, events: DataFrame) -> DataFrame:
    return _guarded(jobs, events, F.col("status") == "queued", {"status": F.lit("processing")})


def progress(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """events: job_id, e_at, e_stage, e_progress (clamped to 0..1), e_message; only while processing."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("e_progress")))
    return _guarded(jobs, events, F.col("status") == "processing", {"stage": F.col("e_stage"), "progress": p, "message": F.col("e_message")})


def finish(jobs: DataFrame, events: DataFrame) -> DataFrame:
    return _guarded(jobs, events, F.col("status") == "processing", {"status": F.lit("ready"), "stage": F.lit("done"), "progress": F.lit(1.0), "message": F.lit("")})


def fail(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """events: job_id, e_at, e_error."""
    return _guarded(jobs, events, active(), {"status": F.lit("failed"), "error": F.col("e_error")})


def fail_videos(videos: DataFrame, jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Videos of failed jobs become failed unless they have a track."""
    hit = jobs.join(events.select("job_id", "e_at"), "job_id").groupBy("video_id").agg(F.max("e_at").alias("_at"))
    v, gone = videos.join(hit, "video_id", "left"), F.col("_at").isNotNull() & F.col("track_path").isNull()
    return v.withColumns({"status": F.when(gone, "failed").otherwise(F.col("status")), "updated_at": F.when(gone, F.col("_at")).otherwise(F.col("updated_at"))}).drop("_at")


def is_processing(jobs: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (job_id, ...) with `processing`: whether that job is there and at work; what a worker asks before it saves."""
    busy = jobs.where("status = 'processing'").select("job_id").distinct().withColumn("_busy", F.lit(True))
    return asked.join(busy, "job_id", "left").withColumn("processing", F.coalesce("_busy", F.lit(False))).drop("_busy")


def listed(videos: DataFrame, by: str = "updated_at", tie: str = "video_id") -> DataFrame:
    """The whole list, what changed last first."""
    return videos.orderBy(F.desc(by), tie)


def recover(jobs: DataFrame, now: str) -> DataFrame:
    """After a restart: what was processing has failed."""
    hit = F.col("status") == "processing"
    return jobs.withColumns({"error": F.when(hit, "interrupted").otherwise(F.col("error")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at")), "status": F.when(hit, "failed").otherwise(F.col("status"))})


def queue(jobs: DataFrame) -> DataFrame:
    return jobs.where("status = 'queued'").orderBy("created_at", "job_id")


def upsert_tracks(videos: DataFrame, saved: DataFrame) -> DataFrame:
    """saved: video_id, url, segments, track_path, at. Known videos keep url and created_at."""
    s = saved.select("video_id", *(F.col(c).alias(f"_{c}") for c in ("url", "segments", "track_path", "at")))
    v = videos.join(s, "video_id", "full")
    new = F.col("_at").isNotNull()
    return v.select("video_id", F.coalesce("url", "_url").alias("url"), F.when(new, "ready").otherwise(F.col("status")).alias("status"), F.coalesce("_segments", "segments").alias("segments"), F.coalesce("_track_path", "track_path").alias("track_path"), F.coalesce("created_at", "_at").alias("created_at"), F.coalesce("_at", "updated_at").alias("updated_at"))


def delete(videos: DataFrame, jobs: DataFrame, gone: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Without the videos, and with their active jobs cancelled."""
    j = jobs.join(gone.select("video_id").distinct().withColumn("_g", F.lit(True)), "video_id", "left")
    hit = F.coalesce(F.col("_g"), F.lit(False)) & active()
    j = j.withColumns({"error": F.when(hit, "cancelled").otherwise(F.col("error")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at")), "status": F.when(hit, "failed").otherwise(F.col("status"))})
    return videos.join(gone, "video_id", "left_anti"), j.select(*jobs.columns)


def newest(rows: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    """The k newest rows: bounded retention."""
    return rows.orderBy(F.desc(by), tie).limit(k)


def throttle(events: DataFrame, keys: list[str], least: float = 0.25) -> DataFrame:
    """Events (t, stage, fraction) that are told: a new stage, the end, or enough time since the last one told."""

    def step(told: tuple | None, e: tuple) -> tuple[tuple | None, tuple | None]:
        tell = told is None or told[1] != e[1] or e[0] - told[0] >= least or (e[2] is not None and e[2] >= 1)
        return (e, e) if tell else (told, None)

    cols = ["t", "stage", "fraction"]
    return fold_sorted(events.withColumns({c: F.col(c).cast("double") for c in ("t", "fraction")}), keys, cols, lambda: None, step, cols, "t double, stage string, fraction double")
