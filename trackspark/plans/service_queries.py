"""Rules of the service, the probe and the drawing as queries over the driver's tables, with their twins in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, geometry, ids, layout
from ..operators import asof, intervals, jobs, report
from ..sources import probe
from . import adapters as A
from .queries import _round, query

SEGMENTS_OF = """sg AS (SELECT o_custkey AS video_id, list({'start': (o_orderkey % 500)::DOUBLE / 4, 'end': (o_orderkey % 500)::DOUBLE / 4 + 1000 + o_orderkey % 7} ORDER BY o_orderkey) AS segments, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_custkey)"""


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    start = (k % 500).cast("double") / 4
    o = A.read(spark, sf_dir, "orders").where(k % 3 == 0).select(F.col("o_custkey").alias("video_id"), F.struct(k, start.alias("start"), (start + 1000 + k % 7).alias("end")).alias("s"))
    return o.groupBy("video_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("segments"), F.count("*").alias("n"))


NUMBER = lambda v: f"CASE WHEN {v} = floor({v}) THEN {v}::BIGINT::VARCHAR ELSE rtrim(printf('%.2f', {v}), '0') END"


@query(f"""WITH {SEGMENTS_OF}, u AS (SELECT video_id, unnest(segments) AS s, generate_subscripts(segments, 1) AS i FROM sg), l AS (SELECT video_id, string_agg({NUMBER("s.start")} || '-' || {NUMBER("s.end")}, ', ' ORDER BY i) AS t FROM u GROUP BY video_id)
SELECT c_custkey::VARCHAR AS video_id, rpad(c_custkey::VARCHAR, 18, ' ') || ' ' || rpad(CASE WHEN c_custkey % 3 = 0 THEN 'ready' ELSE 'processing' END, 11, ' ') || ' ' || c_mktsegment || '  ' || coalesce(t, '-') || '  ' || c_name AS line FROM customer LEFT JOIN l ON c_custkey = video_id""")
def video_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    c = A.read(spark, sf_dir, "customer").select(k.alias("video_id"), F.when(k % 3 == 0, "ready").otherwise("processing").alias("status"), F.col("c_mktsegment").alias("updated_at"), F.col("c_name").alias("url"))
    return report.video_lines(c.join(_segments(spark, sf_dir).drop("n"), "video_id", "left").withColumn("video_id", F.col("video_id").cast("string")))


CLOCK = lambda v: f"CASE WHEN {v} >= 3600 THEN printf('%d:%02d:%06.3f', floor({v} / 3600)::BIGINT, floor({v} / 60)::BIGINT % 60, {v} - floor({v} / 60) * 60) ELSE printf('%d:%06.3f', floor({v} / 60)::BIGINT, {v} - floor({v} / 60) * 60) END"


@query(f"""WITH {SEGMENTS_OF}, u AS (SELECT video_id, unnest(segments) AS s, generate_subscripts(segments, 1) AS i FROM sg), l AS (SELECT video_id, string_agg({CLOCK("s.start")} || '-' || {CLOCK("s.end")}, ', ' ORDER BY i) AS t FROM u GROUP BY video_id)
SELECT video_id::VARCHAR AS video_id, 'imported ' || video_id || ': ' || n || ' rows, ' || len(segments) || ' segment(s)' AS imported, 'ok: ' || video_id || ' ' || n || ' rows, segments ' || t AS valid, 'ok: ' || n || ' rows' AS merged FROM sg JOIN l USING (video_id)""")
def track_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.track_lines(_segments(spark, sf_dir).select(F.col("video_id").cast("string").alias("video_id"), "segments", F.col("n").alias("n_rows")))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 900 + o_orderkey % 4 / 4.0::DOUBLE AS bw, (o_orderkey * 7 % 700)::DOUBLE AS bh, (o_orderkey % 5 * 640)::DOUBLE AS vw, (o_orderkey % 7 * 180)::DOUBLE AS vh, ['contain', 'cover', 'fill'][(o_orderkey % 3 + 1)::INT] AS fit, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 4) * 0.75::DOUBLE END AS dpr FROM orders),
s AS (SELECT *, CASE WHEN fit = 'cover' THEN greatest(bw / vw, bh / vh) ELSE least(bw / vw, bh / vh) END AS k FROM o WHERE bw > 0 AND bh > 0 AND vw > 0 AND vh > 0),
r AS (SELECT *, CASE WHEN fit = 'fill' THEN bw ELSE vw * k END AS w, CASE WHEN fit = 'fill' THEN bh ELSE vh * k END AS h FROM s)
SELECT o.o_orderkey, round(10 + (r.bw - w) / 2 - 3 - 1, 6) AS "left", round(20 + (r.bh - h) / 2 - 4 - 2, 6) AS top, round(w, 6) AS w, round(h, 6) AS h, CASE WHEN w >= 2 THEN greatest(1, floor(w * coalesce(r.dpr, 1) + 0.5)) END::INT AS px_w, CASE WHEN w >= 2 THEN greatest(1, floor(h * coalesce(r.dpr, 1) + 0.5)) END::INT AS px_h FROM o LEFT JOIN r ON o.o_orderkey = r.o_orderkey AND w >= 2 AND h >= 2""")
def overlay_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = A.read(spark, sf_dir, "orders").select(k, (k % 900 + k % 4 / 4.0).alias("bw"), (k * 7 % 700).cast("double").alias("bh"), (k % 5 * 640).cast("double").alias("vw"), (k % 7 * 180).cast("double").alias("vh"), F.element_at(F.array(*map(F.lit, ("contain", "cover", "fill"))), (k % 3 + 1).cast("int")).alias("fit"), F.when(k % 4 > 0, k % 4 * 0.75).alias("dpr"))
    box = F.struct(F.lit(10.0).alias("left"), F.lit(20.0).alias("top"), F.col("bw").alias("width"), F.col("bh").alias("height"))
    parent = F.struct(F.lit(3.0).alias("left"), F.lit(4.0).alias("top"), F.lit(1.0).alias("border_left"), F.lit(2.0).alias("border_top"))
    got = o.select("o_orderkey", layout.overlay_layout(box, parent, F.col("vw"), F.col("vh"), F.col("fit"), F.col("dpr")).alias("l")).select("o_orderkey", "l.*")
    return _round(got, 6, "left", "top", "w", "h")


@query(f"""WITH {A.ROWS}, d AS (SELECT *, r * 1920 AS rr, sl * 1920 AS ss, 1.5::DOUBLE * (1 + event_id % 3) AS least_ FROM rows_)
SELECT event_id, round(x * 1920, 6) AS x, round(y * 1080, 6) AS y, round(rr, 6) AS "inner", round(rr + greatest(0.2::DOUBLE * rr, least_), 6) AS "outer", round(CASE WHEN event_id % 5 > 0 AND ss > 0 AND ss >= 0.5 * rr THEN ss ELSE 0 END, 6) AS half, round(sa, 6) AS angle,
  ('0x' || substr(ring, 2, 2))::INT AS red, ('0x' || substr(ring, 4, 2))::INT AS green, ('0x' || substr(ring, 6, 2))::INT AS blue, greatest(0, least(1920 - 60, round_even(x * 1920, 0) - 30))::INT AS x0, greatest(0, least(1080 - 60, round_even(y * 1080, 0) - 30))::INT AS y0 FROM d""")
def drawn_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's ring in pixels, and the window around it that is shown zoomed."""
    r = A.track_rows(spark, sf_dir)
    sample = F.struct("x", "y", "r", "sl", "sa", "ring")
    ring = layout.drawn_ring(sample, F.lit(1920.0), F.lit(1080.0), (1 + F.col("event_id") % 3).cast("double"), F.col("event_id") % 5 == 0)
    z = layout.zoom_window(F.col("x") * 1920, F.col("y") * 1080, F.lit(1920), F.lit(1080))
    d = r.select("event_id", ring.alias("d"), z.alias("z")).select("event_id", "d.x", "d.y", "d.inner", "d.outer", "d.half", "d.angle", F.col("d.colour.r").alias("red"), F.col("d.colour.g").alias("green"), F.col("d.colour.b").alias("blue"), "z.x0", "z.y0")
    return _round(d, 6, "x", "y", "inner", "outer", "half", "angle")


PROBES_OF = """pb AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_orderkey % 61 END AS an, 1 + o_orderkey % 2 AS ad, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 100 + 0.5::DOUBLE ELSE 0 END AS sd, (o_orderkey % 77)::DOUBLE AS fd, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 * 100 ELSE 0 END AS nb,
  ['tt', 'bb', 'progressive', 'bt', 'unknown'][(o_orderkey % 5 + 1)::INT] AS fo, o_orderkey % 50 AS tff, o_orderkey * 7 % 40 AS bff, o_orderkey * 3 % 60 AS prog, o_orderkey % 30 AS und FROM orders)"""


@query(f"""WITH {PROBES_OF}, f AS (SELECT *, CASE WHEN an > 0 THEN an / ad::DOUBLE ELSE 25.0::DOUBLE END AS fps, CASE WHEN sd <> 0 THEN sd WHEN fd <> 0 THEN fd ELSE 0 END AS duration FROM pb)
SELECT o_orderkey, 'h264' AS codec, 1920 AS width, 1080 AS height, fps, duration, CASE WHEN nb <> 0 THEN nb ELSE round_even(duration * fps, 0) END::INT AS n_frames, fo AS field_order FROM f""")
def probe_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probe documents with missing and zero rates, lengths and counts."""
    k = F.col("o_orderkey")
    s = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    order = F.element_at(F.array(*map(F.lit, ("tt", "bb", "progressive", "bt", "unknown"))), (k % 5 + 1).cast("int"))
    doc = s('{"streams": [{"codec_name": "h264", "width": 1920, "height": 1080, "avg_frame_rate": "', F.when(k % 4 == 0, 0).otherwise(k % 61), "/", 1 + k % 2, '", "r_frame_rate": "25/1", "duration": "', F.when(k % 3 > 0, k % 100 + 0.5).otherwise(0.0), '", "nb_frames": "', F.when(k % 5 > 0, k % 5 * 100).otherwise(0), '", "field_order": "', order, '"}], "format": {"duration": "', (k % 77).cast("double"), '"}}')
    return probe.probes(A.read(spark, sf_dir, "orders").select("o_orderkey", doc.alias("doc")), ["o_orderkey"])


@query(f"""WITH {PROBES_OF}, v AS (SELECT *, und > 0 AS known, fo IN ('tt', 'bb', 'bt') AS stated FROM pb), i AS (SELECT *, known AND (tff + bff > greatest(10, 2 * prog) OR stated AND prog < 0.5 * (tff + bff + und)) AS il FROM v)
SELECT o_orderkey, il AS interlaced, CASE WHEN il THEN CASE WHEN fo = 'tt' THEN 'tff' WHEN stated THEN 'bff' WHEN tff >= bff THEN 'tff' ELSE 'bff' END END AS parity FROM i""")
def interlacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field counters from the last report of a log, against the order that the stream states."""
    k = F.col("o_orderkey")
    line = lambda t, b, p, u: F.concat(F.lit("Multi frame detection: TFF: "), t.cast("string"), F.lit(" BFF:"), b.cast("string"), F.lit(" Progressive:  "), p.cast("string"), F.lit(" Undetermined: "), u.cast("string"))
    log = F.when(k % 30 > 0, F.concat(line(F.lit(9), F.lit(9), F.lit(9), F.lit(9)), F.lit("\nother\n"), line(k % 50, k * 7 % 40, k * 3 % 60, k % 30))).otherwise("nothing")
    order = F.element_at(F.array(*map(F.lit, ("tt", "bb", "progressive", "bt", "unknown"))), (k % 5 + 1).cast("int"))
    o = A.read(spark, sf_dir, "orders").select("o_orderkey", order.alias("field_order"), log.alias("log"))
    return probe.interlacing(probe.field_counts(o, ["o_orderkey", "field_order"]), ["o_orderkey"])


JOB_ROW = "job_id string, video_id string, url string, start_s double, end_s double, status string, stage string, progress double, message string, error string, created_at string, updated_at string"
FLOW = f"""{A.JOBS}, old AS (SELECT *, 'old' AS stage, 0.25::DOUBLE AS progress, '' AS message, NULL AS error, created_at AS updated_at FROM jobs),
act AS (SELECT DISTINCT video_id, start_s, end_s FROM old WHERE status IN ('queued', 'processing')),
req AS (SELECT DISTINCT video_id, start_s, end_s FROM (SELECT video_id, start_s, end_s + 1 AS end_s FROM jobs UNION ALL SELECT video_id, start_s, end_s FROM jobs)),
new AS (SELECT video_id || '/' || coalesce(start_s::INT::VARCHAR, '-') || '/' || coalesce(end_s::INT::VARCHAR, '-') AS job_id, r.*, 'queued' AS status, 'queued' AS stage, 0::DOUBLE AS progress, '' AS message, NULL AS error, 't1' AS created_at, 't1' AS updated_at FROM req r WHERE NOT EXISTS (SELECT 1 FROM act a WHERE a.video_id = r.video_id AND a.start_s IS NOT DISTINCT FROM r.start_s AND a.end_s IS NOT DISTINCT FROM r.end_s)),
every AS (SELECT job_id, video_id, start_s, end_s, status, stage, progress, message, error, updated_at FROM old UNION ALL SELECT job_id, video_id, start_s, end_s, status, stage, progress, message, error, updated_at FROM new),
h AS (SELECT *, length(job_id) % 2 = 0 AS e1, (video_id::BIGINT) % 3 = 0 AS e2, (video_id::BIGINT) % 4 = 1 AS e3, (video_id::BIGINT) % 5 = 2 AS e4, ((video_id::BIGINT) % 7 - 2) / 3.0::DOUBLE AS pr FROM every),
s1 AS (SELECT * REPLACE (CASE WHEN e1 AND status = 'queued' THEN 'processing' ELSE status END AS status, CASE WHEN e1 AND status = 'queued' THEN 't2' ELSE updated_at END AS updated_at) FROM h),
s2 AS (SELECT * REPLACE (CASE WHEN e2 AND status = 'processing' THEN 'track' ELSE stage END AS stage, CASE WHEN e2 AND status = 'processing' THEN greatest(0, least(1, pr)) ELSE progress END AS progress, CASE WHEN e2 AND status = 'processing' THEN 'at work' ELSE message END AS message, CASE WHEN e2 AND status = 'processing' THEN 't3' ELSE updated_at END AS updated_at) FROM s1),
s3 AS (SELECT * REPLACE (CASE WHEN e3 AND status = 'processing' THEN 'done' ELSE stage END AS stage, CASE WHEN e3 AND status = 'processing' THEN 1 ELSE progress END AS progress, CASE WHEN e3 AND status = 'processing' THEN '' ELSE message END AS message, CASE WHEN e3 AND status = 'processing' THEN 't4' ELSE updated_at END AS updated_at, CASE WHEN e3 AND status = 'processing' THEN 'ready' ELSE status END AS status) FROM s2),
s4 AS (SELECT * REPLACE (CASE WHEN e4 AND status IN ('queued', 'processing') THEN 'lost' ELSE error END AS error, CASE WHEN e4 AND status IN ('queued', 'processing') THEN 't5' ELSE updated_at END AS updated_at, CASE WHEN e4 AND status IN ('queued', 'processing') THEN 'failed' ELSE status END AS status) FROM s3)"""


@query(f"WITH {FLOW} SELECT job_id, video_id, start_s, end_s, status, stage, round(progress, 6) AS progress, message, error, updated_at FROM s4")
def job_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with and without an active twin are queued, then jobs start, tell of their progress, end and fail, each only from the state it may."""
    j = A.jobs(spark, sf_dir)
    old = j.withColumns({"url": F.lit(None).cast("string"), "stage": F.lit("old"), "progress": F.lit(0.25), "message": F.lit(""), "error": F.lit(None).cast("string"), "updated_at": F.col("created_at")})
    wanted = j.select("video_id", "start_s", (F.col("end_s") + 1).alias("end_s")).unionAll(j.select("video_id", "start_s", "end_s")).distinct()
    tag = lambda c: F.coalesce(F.col(c).cast("int").cast("string"), F.lit("-"))
    t = jobs.submit(old, wanted.withColumns({"job_id": F.concat_ws("/", "video_id", tag("start_s"), tag("end_s")), "url": F.lit(None).cast("string")}), "t1")
    v = F.col("video_id").cast("bigint")
    some = lambda when, at, **more: t.where(when).select("job_id", F.lit(at).alias("e_at"), *(c.alias(f"e_{n}") for n, c in more.items()))
    begun = jobs.start(t, some(F.length("job_id") % 2 == 0, "t2"))
    told = jobs.progress(begun, some(v % 3 == 0, "t3", stage=F.lit("track"), progress=(v % 7 - 2) / 3.0, message=F.lit("at work")))
    ended = jobs.finish(told, some(v % 4 == 1, "t4"))
    got = jobs.fail(ended, some(v % 5 == 2, "t5", error=F.lit("lost")))
    return _round(got.select("job_id", "video_id", "start_s", "end_s", "status", "stage", "progress", "message", "error", "updated_at"), 6, "progress")


@query(f"""WITH {A.ROWS}, q AS (SELECT *, x * 20 AS px, y * 20 AS py, sl * 300 AS half, r * 500 AS rad FROM rows_), s AS (SELECT *, unnest(range(16)) AS k FROM q), m AS (SELECT *, floor(px) + (k % 4 + 0.5) / 4 - 10 AS dx, floor(py) + (k // 4 + 0.5) / 4 - 10 AS dy FROM s),
d AS (SELECT *, dx * cos(sa) + dy * sin(sa) AS al FROM m), e AS (SELECT *, CASE WHEN half <= 0 THEN sqrt(dx * dx + dy * dy) ELSE sqrt(power(dx - greatest(-half, least(half, al)) * cos(sa), 2) + power(dy - greatest(-half, least(half, al)) * sin(sa), 2)) END AS dist FROM d)
SELECT event_id, avg((dist >= rad AND dist <= rad + 3)::INT) AS coverage, round(any_value(sa * 3 - 2 * pi() * floor((sa * 3 + pi()) / (2 * pi()))), 6) AS turned FROM e GROUP BY event_id""")
def ring_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of one pixel each row's ring around (10, 10) covers, and an angle brought into one turn."""
    r = A.track_rows(spark, sf_dir)
    cover = geometry.ring_coverage(F.floor(F.col("x") * 20), F.floor(F.col("y") * 20), F.lit(10.0), F.lit(10.0), F.col("r") * 500, F.col("r") * 500 + 3, F.col("sl") * 300, F.col("sa"))
    return r.select("event_id", cover.alias("coverage"), F.round(geometry.wrap_angle(F.col("sa") * 3), 6).alias("turned"))


@query("""WITH u AS (SELECT page_id, url, substr(md5(url), 1, 11) AS id, CASE page_id % 6 WHEN 0 THEN substr(md5(url), 1, 11) WHEN 1 THEN 'https://www.youtube.com/watch?t=3&v=' || substr(md5(url), 1, 11) WHEN 2 THEN 'https://m.youtube.com/shorts/' || substr(md5(url), 1, 11) || '?x=1' WHEN 3 THEN '/data/clips/' || substr(md5(url), 1, 11) || '.mp4' WHEN 4 THEN 'https://youtu.be/' || substr(md5(url), 1, 9) ELSE url END AS s FROM pages)
SELECT page_id, page_id % 6 = 0 AS is_id, 'local-' || substr(sha1(s), 1, 11) AS local_id, CASE WHEN page_id % 6 < 4 THEN id END AS extracted, CASE WHEN page_id % 6 = 1 THEN id END AS overlay, CASE WHEN page_id % 6 IN (1, 2) THEN id WHEN page_id % 6 = 4 THEN substr(id, 1, 9) WHEN page_id % 6 = 5 THEN nullif(regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '([^/]+)/*$', 1), '') END AS tail,
  coalesce(CASE WHEN page_id % 3 > 0 THEN page_id::VARCHAR END, '0') || '-' || coalesce(CASE WHEN page_id % 4 > 0 THEN (page_id + 5)::VARCHAR END, 'end') AS tag FROM u""")
def id_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers by the pipeline's, the page's and the file's rules."""
    k, h = F.col("page_id"), F.substring(F.md5("url"), 1, 11)
    s = F.when(k % 6 == 0, h).when(k % 6 == 1, F.concat(F.lit("https://www.youtube.com/watch?t=3&v="), h)).when(k % 6 == 2, F.concat(F.lit("https://m.youtube.com/shorts/"), h, F.lit("?x=1"))).when(k % 6 == 3, F.concat(F.lit("/data/clips/"), h, F.lit(".mp4"))).when(k % 6 == 4, F.concat(F.lit("https://youtu.be/"), F.substring(h, 1, 9))).otherwise(F.col("url"))
    u = A.read(spark, sf_dir, "pages").select("page_id", s.alias("s"))
    c = F.col("s")
    far = k % 6
    return u.select("page_id", ids.is_video_id(c).alias("is_id"), ids.local_id(c).alias("local_id"), ids.extract_id(c).alias("extracted"), ids.overlay_id(c).alias("overlay"), F.when(far.isin(1, 2, 4, 5), ids.tail_id(c)).alias("tail"), ids.range_tag(F.when(k % 3 > 0, k), F.when(k % 4 > 0, k + 5)).alias("tag"))


@query("""WITH w AS (SELECT p_size AS pos, count(*)::DOUBLE AS weight FROM part GROUP BY p_size), c AS (SELECT pos, 'stage ' || pos AS stage, sum(weight) OVER (ORDER BY pos) / sum(weight) OVER () AS upto, coalesce(lag(pos) OVER (ORDER BY pos), -1) AS before FROM w),
d AS (SELECT stage, upto, coalesce(lag(upto) OVER (ORDER BY pos), -1) AS lo FROM c), f AS (SELECT o_orderkey, (o_orderkey * 7919 % 10007) / 10000.0::DOUBLE AS fraction FROM orders)
SELECT stage, count(*) AS n, round(sum(fraction), 6) AS total FROM f LEFT JOIN d ON fraction > lo AND fraction <= upto GROUP BY stage""")
def stage_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions of progress among the stages that the sizes of parts make."""
    w = A.read(spark, sf_dir, "part").groupBy(F.col("p_size").alias("pos")).agg(F.count("*").cast("double").alias("weight")).withColumn("stage", F.concat(F.lit("stage "), F.col("pos").cast("string")))
    f = A.read(spark, sf_dir, "orders").select((F.col("o_orderkey") * 7919 % 10007 / 10000.0).alias("fraction"))
    return intervals.stages(w, f).groupBy("stage").agg(F.count("*").alias("n"), F.round(F.sum("fraction"), 6).alias("total"))


@query(f"""WITH {A.ROWS}, one AS (SELECT t, min(event_id) AS event_id FROM rows_ GROUP BY t), p AS (SELECT event_id, t + 600 AS t FROM one)
SELECT p.event_id, p.t, r.t AS floor_t, r.event_id AS floor_event FROM p ASOF LEFT JOIN one r ON p.t >= r.t""")
def one_long_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one video: what was last seen ten minutes after each."""
    rows = A.track_rows(spark, sf_dir).groupBy("t").agg(F.min("event_id").alias("event_id")).withColumn("video_id", F.lit("v"))
    d = asof.neighbours(rows, rows.select("video_id", (F.col("t") + 600).alias("t"), F.col("event_id").alias("e")), "video_id", "t", extra=["e"])
    return d.select(F.col("e").alias("event_id"), "t", F.col("lo.t").alias("floor_t"), F.col("lo.event_id").alias("floor_event"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((epoch_us(ts) // 1000 % 1000)::VARCHAR, 3, '0') || 'Z' AS to_millis, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS to_seconds FROM events""")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.read(spark, sf_dir, "events").select("event_id", clock.iso(F.col("ts")).alias("to_millis"), clock.iso(F.col("ts"), millis=False).alias("to_seconds"))


@query(f"""WITH {A.JOBS}, asked AS (SELECT (o_orderkey * 2)::VARCHAR AS job_id, o_custkey AS asker FROM orders) SELECT job_id, asker, EXISTS (SELECT 1 FROM jobs j WHERE j.job_id = a.job_id AND status = 'processing') AS processing FROM asked a""")
def job_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether jobs that are asked for, some of which never were, are at work."""
    asked = A.read(spark, sf_dir, "orders").select((F.col("o_orderkey") * 2).cast("string").alias("job_id"), F.col("o_custkey").alias("asker"))
    return jobs.is_processing(A.jobs(spark, sf_dir), asked)
