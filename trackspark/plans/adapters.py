"""The driver's tables seen as tracks, segments, probes, points and jobs. Each has its twin in SQL below."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a user's events lie hours apart: 2.5 frames are 10 hours.
FPS = 1 / 14400.0
HOUR = 3600.0


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def track_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, t, x, y, r, conf, ring, flags, sl, sa, event_id from events."""
    e = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"), (micros("ts") / 1e6).alias("t"), (e * 7919 % 10007 / 10007.0).alias("x"), (e * 104729 % 10009 / 10009.0).alias("y"), (0.002 + e % 50 / 10000.0).alias("r"),
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("conf"), F.when(e % 2 == 0, "#f5f5f5").otherwise("#101010").alias("ring"), (e % 8).cast("int").alias("flags"), (e % 30 / 10000.0).alias("sl"), (e % 628 / 100.0 - 3.14).alias("sa"), "event_id",
    )


ROWS = """
rows_ AS (SELECT user_id AS video_id, epoch_us(ts) / 1e6 AS t, (event_id * 7919 % 10007) / 10007.0::DOUBLE AS x, (event_id * 104729 % 10009) / 10009.0::DOUBLE AS y, 0.002::DOUBLE + (event_id % 50) / 10000.0::DOUBLE AS r,
  least(value / 100.0::DOUBLE, 1.0::DOUBLE) AS conf, CASE WHEN event_id % 2 = 0 THEN '#f5f5f5' ELSE '#101010' END AS ring, (event_id % 8)::INT AS flags, (event_id % 30) / 10000.0::DOUBLE AS sl, (event_id % 628) / 100.0::DOUBLE - 3.14::DOUBLE AS sa, event_id FROM events)"""


def whole_segments(rows: DataFrame) -> DataFrame:
    """One segment for each video: from its first row to two fifths of the way before its last."""
    g = rows.groupBy("video_id").agg(F.min("t").alias("start"), F.max("t").alias("_m"))
    return g.select("video_id", "start", (F.col("start") + (F.col("_m") - F.col("start")) * 0.875).alias("end"))


SEGMENTS = """segs AS (SELECT video_id, min(t) AS "start", min(t) + (max(t) - min(t)) * 0.875::DOUBLE AS "end" FROM rows_ GROUP BY video_id)"""


def probes(rows: DataFrame) -> DataFrame:
    """Three times around every row: an hour and a half before, at, and three hours and 20 minutes after it."""
    return rows.select("video_id", F.explode(F.array(F.col("t") - 1.5 * HOUR, F.col("t"), F.col("t") + 12000.0)).alias("t"))


PROBES = """probes AS (SELECT video_id, unnest([t - 5400.0::DOUBLE, t, t + 12000.0::DOUBLE]) AS t FROM rows_)"""


def order_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, start, end: for each customer's orders an interval of 30 to 209 days."""
    d = (micros("o_orderdate") / 86_400_000_000).cast("double")
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("video_id"), d.alias("start"), (d + 30 + F.col("o_orderkey") % 180).alias("end"), "o_orderkey")


ORDER_SEGMENTS = """osegs AS (SELECT o_custkey AS video_id, epoch_us(o_orderdate) / 86400000000.0::DOUBLE AS "start", epoch_us(o_orderdate) / 86400000000.0::DOUBLE + 30 + o_orderkey % 180 AS "end", o_orderkey FROM orders)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, frame, shot_id, x, y, w, score, cand from events: frames are tens of hours, thinned to one point each."""
    e = F.col("event_id")
    f = F.floor(micros("ts") / 1e6 / 90_000.0)
    g = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("video_id"), f.cast("int").alias("frame")).agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))
    return g.select("video_id", "frame", F.floor(F.col("frame") / 40).cast("int").alias("shot_id"), (e * 7919 % 1009 / 1.0).alias("x"), (e * 104729 % 1013 / 1.0).alias("y"), (e % 10 / 10.0 + 0.05).alias("w"), (e % 100 / 100.0).alias("score"), "event_id", "n")


FRAMES = """
frames AS (SELECT video_id, frame, floor(frame / 40.0)::INT AS shot_id, (event_id * 7919 % 1009)::DOUBLE AS x, (event_id * 104729 % 1013)::DOUBLE AS y, (event_id % 10) / 10.0::DOUBLE + 0.05::DOUBLE AS w, (event_id % 100) / 100.0::DOUBLE AS score, event_id, n
  FROM (SELECT user_id AS video_id, floor(epoch_us(ts) / 1e6 / 90000.0)::INT AS frame, min(event_id) AS event_id, count(*) AS n FROM events GROUP BY ALL))"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("queued", "processing", "ready", "failed"))), (o % 4 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select(o.cast("string").alias("job_id"), F.col("o_custkey").cast("string").alias("video_id"), F.when(o % 3 > 0, (o % 3).cast("double")).alias("start_s"), F.when(o % 5 > 2, (o % 5).cast("double")).alias("end_s"), status.alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"))


JOBS = """
jobs AS (SELECT o_orderkey::VARCHAR AS job_id, o_custkey::VARCHAR AS video_id, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 3)::DOUBLE END AS start_s, CASE WHEN o_orderkey % 5 > 2 THEN (o_orderkey % 5)::DOUBLE END AS end_s,
  ['queued', 'processing', 'ready', 'failed'][(o_orderkey % 4 + 1)::INT] AS status, strftime(o_orderdate, '%Y-%m-%d') AS created_at FROM orders)"""


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.cast("string").alias("video_id"), F.lit("new").alias("status"), F.when(k % 3 == 0, F.concat(F.lit("tracks/"), k.cast("string"))).alias("track_path"))


VIDEOS = """videos AS (SELECT c_custkey::VARCHAR AS video_id, 'new' AS status, CASE WHEN c_custkey % 3 = 0 THEN 'tracks/' || c_custkey::VARCHAR END AS track_path FROM customer)"""
