"""Every operator as a query over the driver's tables, and its twin in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clock, geometry, ids, settings
from ..operators import asof, fit, gapfill, intervals, jobs, lifecycle, merge, near, pixels, recover, ring, search, series, stats, validate
from ..sources import expand
from . import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _round(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


ASOF = f"""WITH {A.ROWS}, {A.SEGMENTS}, {A.PROBES},
lo AS (SELECT p.video_id, p.t, r.t AS lt, r.x AS lx, r.y AS ly, r.r AS lr, r.sl AS lsl, r.conf AS lc, r.sa AS lsa, r.ring AS lring, r.flags AS lf FROM (SELECT *, t + 1e-6 AS te FROM probes) p ASOF LEFT JOIN rows_ r ON p.video_id = r.video_id AND p.te >= r.t),
pair_ AS (SELECT l.*, r.t AS ht, r.x AS hx, r.y AS hy, r.r AS hr, r.sl AS hsl, r.conf AS hc, r.sa AS hsa, r.ring AS hring, r.flags AS hf FROM (SELECT *, t + 1e-6 AS te FROM lo) l ASOF LEFT JOIN rows_ r ON l.video_id = r.video_id AND l.te < r.t),
m AS (SELECT b.*, s."start" - 1e-6 <= b.t AND b.t <= s."end" + 1e-6 AS inside, coalesce(ht - lt <= 36000.000001::DOUBLE, false) AS ip,
  CASE WHEN ht - lt > 0 THEN greatest(0, least(1, (b.t - lt) / (ht - lt))) ELSE 0 END AS w, coalesce(b.t - lt, 'inf'::DOUBLE) AS dl, coalesce(ht - b.t, 'inf'::DOUBLE) AS dh FROM pair_ b LEFT JOIN segs s ON b.video_id = s.video_id),
n AS (SELECT *, CASE WHEN ip THEN w <= 0.5 ELSE dl <= dh END AS ul, ip OR least(dl, dh) <= 7200.000001::DOUBLE AS hit FROM m),
o AS (SELECT *, CASE WHEN ip THEN lc * (1 - w) + hc * w WHEN ul THEN lc ELSE hc END AS conf FROM n),
q AS (SELECT *, CASE WHEN NOT coalesce(inside, false) THEN 'outside' WHEN NOT hit THEN 'none' WHEN conf < 0.5 THEN 'lowconf' WHEN ip THEN 'interp' ELSE 'nearest' END AS mode FROM o)
"""
MIX = lambda c: f"CASE WHEN mode = 'interp' THEN round(l{c} * (1 - w) + h{c} * w, 6) WHEN mode = 'nearest' THEN round(CASE WHEN ul THEN l{c} ELSE h{c} END, 6) END"
PICK = lambda c: f"CASE WHEN mode IN ('interp', 'nearest') THEN CASE WHEN ul THEN l{c} ELSE h{c} END END"


@query(ASOF + f"SELECT video_id, t, mode, {MIX('x')} AS x, {MIX('y')} AS y, {MIX('r')} AS r, {MIX('sl')} AS sl, {MIX('c')} AS conf, round({PICK('sa')}, 6) AS sa, {PICK('ring')} AS ring, {PICK('f')} AS flags FROM q")
def sample_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.track_rows(spark, sf_dir).drop("event_id")
    got = asof.sample_overlay(rows, A.whole_segments(rows), A.probes(rows), A.FPS)
    return _round(got, 6, "x", "y", "r", "sl", "conf", "sa")


@query(ASOF + "SELECT video_id, t, lt AS floor_t, round(lx, 6) AS x FROM q")
def floor_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.track_rows(spark, sf_dir)
    d = asof.neighbours(rows.select("video_id", "t", "x"), A.probes(rows), "video_id", "t", 1e-6)
    return d.select("video_id", "t", F.col("lo.t").alias("floor_t"), F.round("lo.x", 6).alias("x"))


@query(f"""WITH {A.ROWS}, {A.PROBES}, c AS (SELECT * FROM rows_ WHERE conf >= 0.5),
b AS (SELECT p.video_id, p.t, r.t AS lt, r.x AS lx, r.conf AS lc FROM probes p ASOF LEFT JOIN c r ON p.video_id = r.video_id AND p.t > r.t),
d AS (SELECT b.*, r.t AS ht, r.x AS hx, r.conf AS hc FROM b ASOF LEFT JOIN c r ON b.video_id = r.video_id AND b.t <= r.t),
e AS (SELECT *, coalesce(ht - lt <= 36000.000000001::DOUBLE, false) AS ip, coalesce(abs(t - lt), 'inf'::DOUBLE) AS dl, coalesce(abs(ht - t), 'inf'::DOUBLE) AS dh FROM d)
SELECT video_id, t, round(CASE WHEN ip THEN lx * (1 - (t - lt) / (ht - lt)) + hx * ((t - lt) / (ht - lt)) WHEN dl <= dh THEN lx ELSE hx END, 6) AS x, round(CASE WHEN dl <= dh THEN lc ELSE hc END, 6) AS conf
FROM e WHERE ip OR least(dl, dh) <= 7200.000001::DOUBLE""")
def sample_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.track_rows(spark, sf_dir).drop("event_id")
    return _round(asof.sample_preview(rows, A.probes(rows), A.FPS).select("video_id", "t", "x", "conf"), 6, "x", "conf")


@query(f"""WITH {A.ROWS}, {A.PROBES}, l AS (SELECT p.*, r.t AS lt, r.r AS lr FROM probes p ASOF LEFT JOIN rows_ r ON p.video_id = r.video_id AND p.t >= r.t),
b AS (SELECT l.*, r.t AS ht, r.r AS hr FROM l ASOF LEFT JOIN rows_ r ON l.video_id = r.video_id AND l.t < r.t)
SELECT video_id, t, round(CASE WHEN lt IS NULL THEN hr WHEN ht IS NULL THEN lr ELSE lr * (1 - (t - lt) / (ht - lt)) + hr * ((t - lt) / (ht - lt)) END, 6) AS r FROM b""")
def radius_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.track_rows(spark, sf_dir)
    return _round(asof.linear_at(rows, A.probes(rows), "r"), 6, "r")


UNION = f"""WITH {A.ORDER_SEGMENTS}, a AS (SELECT *, max("end") OVER (PARTITION BY video_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM osegs),
b AS (SELECT *, sum(CASE WHEN "start" > reach + 1e-6 OR reach IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM a),
u AS (SELECT video_id, min("start") AS "start", max("end") AS "end" FROM b GROUP BY video_id, island)"""


@query(UNION + ' SELECT video_id, "start", "end" FROM u')
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.union(A.order_segments(spark, sf_dir))


@query(UNION + ' SELECT video_id, sum("end" - "start") AS seconds, count(*) AS n_segments FROM u GROUP BY video_id')
def covered_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.covered(intervals.union(A.order_segments(spark, sf_dir)))


@query(f"""WITH {A.ORDER_SEGMENTS} SELECT video_id, o_orderkey, greatest("start", 9000.0::DOUBLE) AS "start", least("end", 9500.0::DOUBLE) AS "end" FROM osegs WHERE least("end", 9500) > greatest("start", 9000)""")
def interval_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.clip(A.order_segments(spark, sf_dir), 9000.0, 9500.0)


POINTS = f"""WITH {A.ORDER_SEGMENTS}, pts AS (SELECT video_id, o_orderkey, "start" - 7 AS t FROM osegs)"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.order_segments(spark, sf_dir).select("video_id", "o_orderkey", (F.col("start") - 7).alias("t"))


@query(POINTS + """ SELECT video_id, o_orderkey, t, EXISTS (SELECT 1 FROM osegs s WHERE s.video_id = p.video_id AND p.t BETWEEN s."start" - 1e-6 AND s."end" + 1e-6) AS inside FROM pts p""")
def point_in_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.membership(_points(spark, sf_dir), A.order_segments(spark, sf_dir))


@query(POINTS + """ SELECT video_id, o_orderkey, t FROM pts p WHERE NOT EXISTS (SELECT 1 FROM osegs s WHERE s.video_id = p.video_id AND p.t BETWEEN s."start" - 1e-6 AND s."end" + 1e-6)""")
def interval_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.outside(_points(spark, sf_dir), A.order_segments(spark, sf_dir))


@query(f"""WITH {A.ROWS}, ns AS (SELECT video_id, quantile_cont(t, 0.25) AS a, quantile_cont(t, 0.5) AS b FROM rows_ GROUP BY video_id)
SELECT r.video_id, r.t, r.x, r.conf, CAST(0.0 AS DOUBLE) AS sl FROM rows_ r JOIN ns USING (video_id) WHERE event_id % 2 = 0 AND NOT r.t BETWEEN a - 1e-6 AND b + 1e-6
UNION ALL SELECT r.video_id, r.t, r.x, r.conf, r.sl FROM rows_ r JOIN ns USING (video_id) WHERE event_id % 2 = 1 AND r.t BETWEEN a AND b""")
def merge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.track_rows(spark, sf_dir)
    seg = rows.groupBy("video_id").agg(F.percentile("t", 0.25).alias("start"), F.percentile("t", 0.5).alias("end"))
    old = rows.where("event_id % 2 = 0").select("video_id", "t", "x", "conf", "ring")
    new = rows.where("event_id % 2 = 1").join(seg, "video_id").where(F.col("t").between(F.col("start"), F.col("end"))).select("video_id", "t", "x", "conf", "sl")
    return merge.merge_rows(old, new, seg)


@query(f"WITH {A.FRAMES}, i AS (SELECT *, frame - row_number() OVER (PARTITION BY video_id ORDER BY frame) AS g FROM frames) SELECT video_id, min(frame) AS first, max(frame) AS last, count(*) AS n FROM i GROUP BY video_id, g")
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.runs(A.frames(spark, sf_dir), ["video_id"])


BREAKS = f"""WITH {A.FRAMES}, b AS (SELECT *, coalesce(shot_id <> lag(shot_id) OVER w OR frame - lag(frame) OVER w > 9, true) AS is_break FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY frame)),
s AS (SELECT *, (sum(is_break::INT) OVER (PARTITION BY video_id ORDER BY frame))::BIGINT AS span FROM b)"""


@query(BREAKS + " SELECT video_id, frame, shot_id, is_break, span FROM s")
def breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.breaks(A.frames(spark, sf_dir), ["video_id"], "shot_id").select("video_id", "frame", "shot_id", "is_break", "span")


@query(f"WITH {A.FRAMES}, v AS (SELECT *, (frame - lag(frame) OVER (PARTITION BY video_id ORDER BY frame) > 2)::INT AS b FROM frames) SELECT video_id, count(*) AS frames, max(frame) - min(frame) AS span, (1 + coalesce(sum(b), 0))::BIGINT AS visits FROM v GROUP BY video_id")
def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.visits(A.frames(spark, sf_dir), ["video_id"])


VEL = lambda c: f"CASE WHEN hp AND hn THEN (lead({c}) OVER w - lag({c}) OVER w) / 2 WHEN hn THEN lead({c}) OVER w - {c} WHEN hp THEN {c} - lag({c}) OVER w ELSE 0 END"
VELOCITY = f"""WITH {A.FRAMES}, h AS (SELECT *, coalesce(lag(frame) OVER w = frame - 1, false) AS hp, coalesce(lead(frame) OVER w = frame + 1, false) AS hn FROM frames WINDOW w AS (PARTITION BY video_id, shot_id ORDER BY frame)),
vel AS (SELECT *, {VEL('x')} AS vx, {VEL('y')} AS vy FROM h WINDOW w AS (PARTITION BY video_id, shot_id ORDER BY frame))"""


def _velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.velocity(A.frames(spark, sf_dir), ["video_id", "shot_id"])


@query(VELOCITY + " SELECT video_id, frame, vx::DOUBLE AS vx, vy::DOUBLE AS vy FROM vel")
def velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _velocity(spark, sf_dir).select("video_id", "frame", "vx", "vy")


_S = lambda k: f"sum(b.w * power((b.frame - a.frame)::DOUBLE, {k})) AS s{k}"
_M = lambda k: f"sum(b.w * b.x * power((b.frame - a.frame)::DOUBLE, {k})) AS m{k}"


@query(f"""WITH {A.FRAMES}, p AS (SELECT a.video_id, a.frame, any_value(a.x) AS x, count(*) AS n, {_S(0)}, {_S(1)}, {_S(2)}, {_S(3)}, {_S(4)}, {_M(0)}, {_M(1)}, {_M(2)}
  FROM frames a JOIN frames b ON a.video_id = b.video_id AND a.shot_id = b.shot_id AND b.frame BETWEEN a.frame - 2 AND a.frame + 2 GROUP BY a.video_id, a.frame)
SELECT video_id, frame, round(CASE WHEN n >= 4 THEN (m0 * (s2 * s4 - s3 * s3) - s1 * (m1 * s4 - m2 * s3) + s2 * (m1 * s3 - m2 * s2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)) ELSE x END, 4) AS x_smooth FROM p""")
def local_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = series.local_quadratic(A.frames(spark, sf_dir), ["video_id", "shot_id"], "x", "w", "x_smooth")
    return _round(got.select("video_id", "frame", "x_smooth"), 4, "x_smooth")


STREAK = VELOCITY + """, m AS (SELECT *, sqrt(vx * vx + vy * vy) AS speed, CASE WHEN event_id % 3 > 0 THEN (event_id % 40) / 2.0::DOUBLE END AS sl_meas, 4.0::DOUBLE AS r FROM vel)"""


def _streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _velocity(spark, sf_dir).withColumns({"speed": F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")), "r": F.lit(4.0), "sl_w": F.col("w"), "sl_meas": F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 40 / 2.0)})
    return v.withColumns({"ang_meas": F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 314 / 100.0), "ang_w": F.col("w")})


@query(STREAK + """, j AS (SELECT a.video_id, a.frame, any_value(a.speed) AS speed, any_value(a.r) AS r,
  sum(CASE WHEN b.sl_meas IS NOT NULL THEN b.w * CASE WHEN b.frame = a.frame THEN 1 ELSE 0.5::DOUBLE END END) AS den, sum(CASE WHEN b.sl_meas IS NOT NULL THEN b.w * CASE WHEN b.frame = a.frame THEN 1 ELSE 0.5::DOUBLE END * b.sl_meas * CASE WHEN a.speed > 2 AND b.speed > 2 THEN a.speed / b.speed ELSE 1 END END) AS num
  FROM m a JOIN m b ON a.video_id = b.video_id AND a.shot_id = b.shot_id AND b.frame BETWEEN a.frame - 2 AND a.frame + 2 GROUP BY a.video_id, a.frame)
SELECT video_id, frame, round(greatest(0, least(CASE WHEN den IS NULL THEN 0.3 * speed ELSE (0.3::DOUBLE * 0.3 * speed + num) / (0.3 + den) END, least(0.75 * speed + 0.5 * r, 76.8))), 4)::DOUBLE AS sl FROM j""")
def streak_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(series.streak_length(_streaks(spark, sf_dir), ["video_id", "shot_id"], 0.3, 1920.0).select("video_id", "frame", "sl"), 4, "sl")


@query(STREAK + """, g AS (SELECT *, CASE WHEN event_id % 4 > 0 THEN (event_id % 314) / 100.0::DOUBLE END AS am FROM m),
j AS (SELECT a.video_id, a.frame, any_value(a.vx) AS vx, any_value(a.vy) AS vy, any_value(a.speed) AS speed, coalesce(sum(b.w * CASE WHEN b.frame = a.frame THEN 1 ELSE 0.5::DOUBLE END * cos(2 * b.am)), 0) AS c, coalesce(sum(b.w * CASE WHEN b.frame = a.frame THEN 1 ELSE 0.5::DOUBLE END * sin(2 * b.am)), 0) AS s
  FROM g a JOIN g b ON a.video_id = b.video_id AND a.shot_id = b.shot_id AND b.frame BETWEEN a.frame - 2 AND a.frame + 2 GROUP BY a.video_id, a.frame),
k AS (SELECT *, atan2(vy, vx) AS va, CASE WHEN speed > 1 THEN 0.3::DOUBLE * least(1, speed / 8) ELSE 0 END AS wv FROM j),
l AS (SELECT *, c + wv * cos(2 * va) AS c2, s + wv * sin(2 * va) AS s2 FROM k), n AS (SELECT *, CASE WHEN c2 <> 0 OR s2 <> 0 THEN 0.5 * atan2(s2, c2) ELSE va END AS a FROM l)
SELECT video_id, frame, round(cos(CASE WHEN speed > 1 AND cos(a - va) < 0 THEN a + pi() ELSE a END), 4) AS ux, round(sin(CASE WHEN speed > 1 AND cos(a - va) < 0 THEN a + pi() ELSE a END), 4) AS uy FROM n""")
def circular_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = series.streak_angle(_streaks(spark, sf_dir), ["video_id", "shot_id"])
    return got.select("video_id", "frame", F.round(F.cos("sa"), 4).alias("ux"), F.round(F.sin("sa"), 4).alias("uy"))


@query(f"""WITH {A.FRAMES}, f AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY video_id) AS c, first_value(score) OVER w AS a, last_value(score) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z, sum(score) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM frames WINDOW w AS (PARTITION BY video_id ORDER BY frame))
SELECT video_id, frame, round((s + greatest(0, 3 - rn) * a + greatest(0, 2 - (c - rn)) * z) / 5, 6) AS score5 FROM f""")
def box5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(series.box_filter(A.frames(spark, sf_dir), ["video_id"], "score", "score5").select("video_id", "frame", "score5"), 6, "score5")


GRID = f"""WITH {A.FRAMES}, span AS (SELECT video_id, min(frame) AS a, max(frame) AS b FROM frames GROUP BY video_id), g AS (SELECT video_id, unnest(range(a, b + 1))::INT AS frame FROM span),
d AS (SELECT g.*, f.x, f.w FROM g LEFT JOIN frames f USING (video_id, frame)),
k AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) OVER l AS lf, last_value(x IGNORE NULLS) OVER l AS lx, first_value(CASE WHEN x IS NOT NULL THEN frame END IGNORE NULLS) OVER r AS hf, first_value(x IGNORE NULLS) OVER r AS hx FROM d
  WINDOW l AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), r AS (PARTITION BY video_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT video_id, frame, a, b, coalesce(w, 0) AS w, CASE WHEN x IS NOT NULL THEN x ELSE lx + (hx - lx) * (frame - lf) / (hf - lf) END AS q FROM k JOIN span USING (video_id))"""


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = series.dense(A.frames(spark, sf_dir), ["video_id"], ["x", "w"])
    return series.fill_linear(grid, ["video_id"], "x", "q").withColumn("w", F.coalesce("w", F.lit(0.0)))


@query(GRID + " SELECT video_id, frame, round(q, 6) AS q FROM filled")
def nan_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_filled(spark, sf_dir).select("video_id", "frame", "q"), 6, "q")


@query(GRID + """ SELECT f.video_id, f.frame, round(list_sort(list_transform(range(-6, 7), lambda k: v.vs[greatest(0, least(f.b - f.a, f.frame - f.a + k)) + 1]))[7], 6) AS med
FROM filled f JOIN (SELECT video_id, list(q ORDER BY frame) AS vs FROM filled GROUP BY video_id) v USING (video_id)""")
def median13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(series.median_filter(_filled(spark, sf_dir), ["video_id"], "q", "med").select("video_id", "frame", "med"), 6, "med")


@query(GRID + """ SELECT f.video_id, f.frame, round(list_sum(list_transform(range(-24, 25), lambda k: exp(-0.5 * k * k / 36.0::DOUBLE) * v.ps[greatest(0, least(f.b - f.a, f.frame - f.a + k)) + 1])) / list_sum(list_transform(range(-24, 25), lambda k: exp(-0.5 * k * k / 36.0::DOUBLE) * v.ws[greatest(0, least(f.b - f.a, f.frame - f.a + k)) + 1])), 4) AS smooth
FROM filled f JOIN (SELECT video_id, list((w + 0.05::DOUBLE) * q ORDER BY frame) AS ps, list(w + 0.05::DOUBLE ORDER BY frame) AS ws FROM filled GROUP BY video_id) v USING (video_id)""")
def gauss_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _filled(spark, sf_dir).withColumn("w", F.col("w") + 0.05)
    return _round(series.gauss_filter(f, ["video_id"], "q", "w", "smooth").select("video_id", "frame", "smooth"), 4, "smooth")


@query(f"""WITH {A.FRAMES} SELECT f.video_id, f.frame, (SELECT count(*) FROM frames c WHERE c.video_id = f.video_id AND c.event_id % 7 = 0 AND c.frame <= f.frame)::BIGINT AS shot_id FROM frames f""")
def shot_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = A.frames(spark, sf_dir)
    return series.shots(f.select("video_id", "frame"), f.where("event_id % 7 = 0").select("video_id", "frame"))


@query(f"""WITH {A.FRAMES}, p AS (SELECT *, frame - last_value(CASE WHEN event_id % 3 = 0 THEN frame END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS prev_dist,
  first_value(CASE WHEN event_id % 3 = 0 THEN frame END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - frame AS next_dist FROM frames)
SELECT video_id, frame, prev_dist, next_dist, round(power(CASE WHEN prev_dist + next_dist - 1 <= 4 THEN 0.93::DOUBLE ELSE 0.85::DOUBLE END, CASE WHEN prev_dist IS NULL THEN next_dist WHEN next_dist IS NULL THEN prev_dist ELSE least(prev_dist, next_dist) END), 6) AS decay FROM p""")
def detected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = A.frames(spark, sf_dir).withColumn("hit", F.col("event_id") % 3 == 0)
    return _round(series.detected_neighbours(f, ["video_id"], "hit").select("video_id", "frame", "prev_dist", "next_dist", "decay"), 6, "decay")


@query(f"""WITH {A.FRAMES}, s AS (SELECT *, lag(x) OVER w AS b1, lag(x, 2) OVER w AS b2, lead(x) OVER w AS a1, lead(x, 2) OVER w AS a2 FROM frames WINDOW w AS (PARTITION BY video_id, shot_id ORDER BY frame))
SELECT video_id, frame, x AS s0, CASE WHEN b2 IS NOT NULL THEN b1 WHEN a2 IS NOT NULL THEN a1 ELSE coalesce(b1, a1, x) END AS s1, CASE WHEN b2 IS NOT NULL THEN b2 WHEN a2 IS NOT NULL THEN a2 WHEN b1 IS NOT NULL AND a1 IS NOT NULL THEN a1 ELSE coalesce(b1, a1, x) END AS s2 FROM s""")
def temporal_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = series.temporal_stack(A.frames(spark, sf_dir), ["video_id", "shot_id"], "x")
    return got.select("video_id", "frame", *(F.col("stack")[k].alias(f"s{k}") for k in range(3)))


@query(f"""WITH {A.FRAMES}, n AS (SELECT f.*, b1.x AS b1, b2.x AS b2, a1.x AS a1, a2.x AS a2 FROM frames f
  LEFT JOIN frames b1 ON (b1.video_id, b1.shot_id, b1.frame) = (f.video_id, f.shot_id, f.frame - 1) LEFT JOIN frames b2 ON (b2.video_id, b2.shot_id, b2.frame) = (f.video_id, f.shot_id, f.frame - 2)
  LEFT JOIN frames a1 ON (a1.video_id, a1.shot_id, a1.frame) = (f.video_id, f.shot_id, f.frame + 1) LEFT JOIN frames a2 ON (a2.video_id, a2.shot_id, a2.frame) = (f.video_id, f.shot_id, f.frame + 2))
SELECT video_id, frame, x, coalesce(b1, a2, a1, x) AS before, coalesce(a1, b2, b1, x) AS after FROM n""")
def frame_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.frame_triples(A.frames(spark, sf_dir), ["video_id", "shot_id"], value="x").select("video_id", "frame", "x", "before", "after")


@query(f"WITH {A.ROWS}, p AS (SELECT video_id, event_id, conf, lag(conf) OVER (PARTITION BY video_id ORDER BY event_id) AS c FROM rows_) SELECT video_id, event_id FROM p WHERE conf < c")
def unsorted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.unsorted(A.track_rows(spark, sf_dir), ["video_id"], "event_id", "conf").select("video_id", "event_id")


@query("WITH p AS (SELECT user_id AS video_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) SELECT video_id, event_id, value FROM p WHERE k <= 4")
def top4(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.read(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), "event_id", "value")
    return series.top_k(e, ["video_id"], "value", "event_id")


@query("""WITH n AS (SELECT user_id AS video_id, count(*) AS n FROM events GROUP BY 1) SELECT video_id, array_to_string(list_distinct(list_transform(range(12), lambda k: round_even(k * (n - 1) / 11.0::DOUBLE, 0)::INT)).list_sort(), ',') AS picks FROM n""")
def linspace_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("video_id")).agg(F.count("*").alias("n"))
    return n.select("video_id", F.array_join(F.array_sort(series.spaced(F.col("n"), 12)).cast("array<string>"), ",").alias("picks"))


STATIC = """WITH pts AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), n AS (SELECT DISTINCT a.vec_id, b.vec_id AS f FROM pts a JOIN pts b ON power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 0.02::DOUBLE * 0.02::DOUBLE),
v AS (SELECT *, (f - lag(f) OVER (PARTITION BY vec_id ORDER BY f) > 2)::INT AS b FROM n)"""


def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.read(spark, sf_dir, "embeddings")
    return e.select(F.lit(0).alias("k"), "vec_id", F.col("vec_id").alias("frame"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))


@query(STATIC + " SELECT vec_id, count(*) AS frames, max(f) - min(f) AS span, (1 + coalesce(sum(b), 0))::BIGINT AS visits FROM v GROUP BY vec_id HAVING count(*) >= 4 AND max(f) - min(f) >= 12 AND 1 + coalesce(sum(b), 0) >= 3")
def static_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = near.static_points(_embedded(spark, sf_dir), 0.02, ["k"], "vec_id")
    return s.select("vec_id", F.col("frames").cast("bigint").alias("frames"), "span", F.col("visits").cast("bigint").alias("visits"))


@query("""WITH c AS (SELECT user_id, event_type, event_id, event_id * 7919 % 1009 AS x, event_id * 104729 % 1013 AS y FROM events), j AS (SELECT a.event_id, b.event_id AS other, sqrt((power(a.x - b.x, 2) + power(a.y - b.y, 2))::DOUBLE) AS d, row_number() OVER (PARTITION BY a.event_id ORDER BY sqrt((power(a.x - b.x, 2) + power(a.y - b.y, 2))::DOUBLE), b.event_id) AS k
  FROM c a JOIN c b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type <> 'click' WHERE power(a.x - b.x, 2) + power(a.y - b.y, 2) <= 22500)
SELECT a.event_id, j.other, round(j.d, 4) AS dist FROM c a LEFT JOIN j ON a.event_id = j.event_id AND k = 1 WHERE a.event_type = 'click'""")
def nearest_in_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    c = A.read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", (e * 7919 % 1009).alias("x"), (e * 104729 % 1013).alias("y"))
    a, b = c.where("event_type = 'click'").drop("event_type"), c.where("event_type <> 'click'").drop("event_type")
    got = near.nearest_within(a, b, 150.0, ["user_id"], "event_id", "event_id")
    return got.select("event_id", F.col("near_event_id").alias("other"), F.round("near_dist", 4).alias("dist"))


@query(f"""WITH {A.FRAMES}, f AS (SELECT *, (frame - min(frame) OVER (PARTITION BY video_id, shot_id))::DOUBLE AS t FROM frames), g AS (SELECT video_id, shot_id, count(*) AS n, count(DISTINCT t) AS d, sum(1.0::DOUBLE) AS s0, sum(t) AS s1, sum(t * t) AS s2, sum(t * t * t) AS s3, sum(t * t * t * t) AS s4, sum(x) AS m0, sum(x * t) AS m1, sum(x * t * t) AS m2 FROM f GROUP BY ALL),
h AS (SELECT *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM g)
SELECT video_id, shot_id, n, round(CASE WHEN d >= 3 THEN (m0 * (s2 * s4 - s3 * s3) - s1 * (m1 * s4 - m2 * s3) + s2 * (m1 * s3 - m2 * s2)) / det END, 2) AS c0, round(CASE WHEN d >= 3 THEN (s0 * (s2 * m2 - s3 * m1) - s1 * (s1 * m2 - s2 * m1) + m0 * (s1 * s3 - s2 * s2)) / det END, 2) AS c2 FROM h""")
def quad_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.quad_fit(A.frames(spark, sf_dir), ["video_id", "shot_id"], "x").select("video_id", "shot_id", "n", "c0", "c2"), 2, "c0", "c2")


@query(f"""WITH {A.ROWS} SELECT video_id, count(*) AS rows, count(*) FILTER (conf >= 0.5) AS rows_conf_ge_0_5, count(*) FILTER (sl >= 0.5 * r) AS stadium_rows, count(*) FILTER (flags & 1 <> 0) AS interpolated_rows, count(*) FILTER (flags & 2 <> 0) AS bounces, count(*) FILTER (flags & 4 <> 0) AS hits,
round(100.0::DOUBLE * count(*) / 500, 1) AS rows_pct, round(quantile_cont(sl * 1920, 0.5), 2) AS streak_median FROM rows_ GROUP BY video_id""")
def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.run_stats(A.track_rows(spark, sf_dir), ["video_id"], F.lit(500), 1920.0)
    return got.select("video_id", "rows", "rows_conf_ge_0_5", "stadium_rows", "interpolated_rows", "bounces", "hits", "rows_pct", "streak_median")


@query("""WITH m AS (SELECT l_suppkey, quantile_cont(l_quantity, 0.5) AS median FROM lineitem GROUP BY 1) SELECT l_suppkey, any_value(median) AS median, round(1.4826::DOUBLE * quantile_cont(abs(l_quantity - median), 0.5) + 1, 6) AS noise FROM lineitem JOIN m USING (l_suppkey) GROUP BY 1""")
def mad_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.mad_noise(A.read(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity"), ["l_suppkey"], "l_quantity"), 6, "noise")


@query(STREAK + """ SELECT video_id, round(CASE WHEN count(CASE WHEN sl_meas IS NOT NULL AND w >= 0.5 AND speed >= 4 THEN 1 END) >= 8 THEN least(0.6::DOUBLE, greatest(0, quantile_cont(CASE WHEN sl_meas IS NOT NULL AND w >= 0.5 AND speed >= 4 THEN sl_meas / speed END, 0.5))) ELSE 0.25 END, 6) AS exposure FROM m GROUP BY video_id""")
def exposure_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.exposure(_streaks(spark, sf_dir), ["video_id"]), 6, "exposure")


@query(VELOCITY + """, k AS (SELECT *, x + event_id % 9 - 4 AS mx, y + event_id % 11 - 5 AS my, vx * vx + vy * vy AS v2 FROM vel), e AS (SELECT video_id, CASE WHEN w >= 0.5 AND v2 >= 9 THEN -((mx - x) * vx + (my - y) * vy) / v2 END AS lk FROM k)
SELECT video_id, round(CASE WHEN count(lk) >= 8 THEN least(1.0::DOUBLE, greatest(0, quantile_cont(lk, 0.5))) ELSE 0.45 END, 6) AS lead FROM e GROUP BY video_id""")
def lead_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _velocity(spark, sf_dir).withColumns({"mx": F.col("x") + F.col("event_id") % 9 - 4, "my": F.col("y") + F.col("event_id") % 11 - 5, "weight": F.col("w")})
    return _round(stats.lead(v, ["video_id"]), 6, "lead")


@query(f"""WITH {A.FRAMES}, g AS (SELECT video_id, shot_id, sum(w) AS sw, sum(w * x) / sum(w) AS cx, sum(w * y) / sum(w) AS cy, sum(w * x * x) / sum(w) AS xx, sum(w * y * y) / sum(w) AS yy, sum(w * x * y) / sum(w) AS xy FROM frames GROUP BY ALL),
h AS (SELECT *, xx - cx * cx AS a, yy - cy * cy AS b, xy - cx * cy AS c FROM g) SELECT video_id, shot_id, round(cx, 3) AS cx, round(cy, 3) AS cy, round(2 * sqrt(greatest(0, (a + b) / 2 + sqrt(power((a - b) / 2, 2) + c * c))), 1) AS major FROM h""")
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stats.moments(A.frames(spark, sf_dir), ["video_id", "shot_id"], ["frame"])
    # exact ties are common here: the shift by powers of ten is rounded as in SQL, not the shortest decimal
    places = lambda c, k: (F.round(F.col(c) * k, 0) / k).alias(c)
    return got.select("video_id", "shot_id", places("cx", 1000.0), places("cy", 1000.0), places("major", 10.0))


@query(f"WITH {A.FRAMES} SELECT video_id, shot_id, round(sum(score), 4) AS score, count(*) AS points, max(x) - min(x) + max(y) - min(y) AS extent FROM frames GROUP BY ALL")
def tracklet_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(stats.tracklet_score(A.frames(spark, sf_dir), ["video_id", "shot_id"]), 4, "score")


HIST = """WITH b AS (SELECT event_type, greatest(0, least(15, floor(value / 200 * 16)))::INT AS bin, user_id % 2 AS half FROM events), h AS (SELECT event_type, half, bin, count(*) / (sum(count(*)) OVER (PARTITION BY event_type, half))::DOUBLE AS share FROM b GROUP BY event_type, half, bin)"""


def _histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.read(spark, sf_dir, "events").withColumn("half", F.col("user_id") % 2)
    return stats.histogram(e, ["event_type", "half"], "value", 0.0, 200.0, 16)


@query(HIST + " SELECT event_type, half, bin, round(share, 6) AS share FROM h")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_histograms(spark, sf_dir), 6, "share")


@query(HIST + " SELECT coalesce(p.event_type, q.event_type) AS event_type, round(sqrt(greatest(0, 1 - sum(sqrt(coalesce(p.share, 0) * coalesce(q.share, 0))))), 5) AS distance FROM (FROM h WHERE half = 0) p FULL JOIN (FROM h WHERE half = 1) q ON p.event_type = q.event_type AND p.bin = q.bin GROUP BY 1")
def bhattacharyya(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _histograms(spark, sf_dir)
    return _round(stats.bhattacharyya(h.where("half = 0").drop("half"), h.where("half = 1").drop("half"), ["event_type"]), 5, "distance")


@query("WITH p AS (SELECT l_suppkey, l_quantity, l_orderkey * 10 + l_linenumber AS place, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_orderkey * 10 + l_linenumber) AS k FROM lineitem) SELECT l_suppkey, max(place) FILTER (k = 1) AS place, min(l_quantity) AS l_quantity, min(l_quantity) < 0.5 * coalesce(max(l_quantity) FILTER (k = 2), 'inf'::DOUBLE) AND min(l_quantity) < 30 AS verified FROM p GROUP BY l_suppkey")
def best_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = A.read(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return stats.best_two(li, ["l_suppkey"], "l_quantity", "place")


LUM = "least(1.0::DOUBLE, value / 120.0::DOUBLE)"
C = geometry.LUMINANCE
CON = lambda a, l: f"((greatest({a}::DOUBLE, {l}) + 0.05::DOUBLE) / (least({a}::DOUBLE, {l}) + 0.05::DOUBLE))"  # noqa: E731, E741
BEST = lambda l: f"(CASE WHEN {CON(C['#ff00ff'], l)} >= 1.2::DOUBLE * greatest({CON(C['#101010'], l)}, {CON(C['#f5f5f5'], l)}) THEN '#ff00ff' WHEN {CON(C['#101010'], l)} >= {CON(C['#f5f5f5'], l)} THEN '#101010' ELSE '#f5f5f5' END)"  # noqa: E731, E741


def _lums(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.read(spark, sf_dir, "events")
    return e.select("user_id", "event_type", "event_id", F.when(F.col("event_id") % 13 > 0, F.least(F.lit(1.0), F.col("value") / 120.0)).alias("lum"))


@query(f"SELECT event_id, {BEST(LUM)} AS colour, round({CON(C['#101010'], LUM)}, 6) AS black FROM events WHERE event_id % 13 > 0")
def ring_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _lums(spark, sf_dir).where("lum IS NOT NULL")
    return e.select("event_id", geometry.best_candidate(F.col("lum"))["colour"].alias("colour"), F.round(geometry.contrast_with("#101010", F.col("lum")), 6).alias("black"))


HELD = "CASE a.cur WHEN '#101010' THEN " + CON(C["#101010"], "x.lum") + " WHEN '#ff00ff' THEN " + CON(C["#ff00ff"], "x.lum") + " ELSE " + CON(C["#f5f5f5"], "x.lum") + " END"
_BETTER = f"(x.cand <> a.cur AND x.con >= 1.15::DOUBLE * ({HELD}))"
_COUNT = f"(CASE WHEN {_BETTER} THEN CASE WHEN x.cand = a.pend THEN a.cnt + 1 ELSE 1 END ELSE 0 END)"
_BESTCON = f"greatest({CON(C['#101010'], LUM)}, {CON(C['#f5f5f5'], LUM)})"


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, CASE WHEN event_id % 13 > 0 THEN {LUM} END AS lum, CASE WHEN event_id % 13 > 0 THEN {BEST(LUM)} END AS cand, CASE WHEN event_id % 13 > 0 THEN {_BESTCON} END AS con, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
a AS (SELECT user_id, k, event_id, cand AS cur, NULL::VARCHAR AS pend, 0 AS cnt FROM e WHERE k = 1 UNION ALL
SELECT x.user_id, x.k, x.event_id, CASE WHEN x.lum IS NULL THEN a.cur WHEN a.cur IS NULL OR {_COUNT} >= 3 THEN x.cand ELSE a.cur END, CASE WHEN x.lum IS NULL THEN a.pend WHEN a.cur IS NOT NULL AND {_BETTER} AND {_COUNT} < 3 THEN x.cand END, CASE WHEN x.lum IS NULL THEN a.cnt WHEN a.cur IS NULL OR {_COUNT} >= 3 THEN 0 ELSE {_COUNT} END
FROM a JOIN e x ON x.user_id = a.user_id AND x.k = a.k + 1) SELECT user_id, event_id, coalesce(cur, '#f5f5f5') AS ring FROM a""")
def hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.choose(_lums(spark, sf_dir), ["user_id"], "event_id")


@query(f"""WITH {A.FRAMES}, cut AS (SELECT video_id, frame FROM frames WHERE event_id % 17 = 0), size_ AS (SELECT video_id, max(frame) + 2 AS n FROM frames GROUP BY video_id),
d AS (SELECT *, lag(frame) OVER w AS pf, lag(x) OVER w AS px, lag(y) OVER w AS py, lead(frame) OVER w AS nf, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(s) OVER w AS ns
  FROM (SELECT video_id, frame, x, y, (SELECT count(*) FROM cut c WHERE c.video_id = f.video_id AND c.frame <= f.frame) AS s FROM frames f) WINDOW w AS (PARTITION BY video_id ORDER BY frame)),
a AS (SELECT video_id, f AS frame, x + (f - frame) / (nf - frame)::DOUBLE * (nx - x) AS x, y + (f - frame) / (nf - frame)::DOUBLE * (ny - y) AS y, 23.04::DOUBLE + 0.8::DOUBLE * sqrt(power(nx - x, 2) + power(ny - y, 2)) / (nf - frame) * least(f - frame, nf - f) AS radius, -1 AS rank
  FROM (SELECT *, unnest(range(frame + 1, nf)) AS f FROM d WHERE nf - frame BETWEEN 2 AND 13 AND s = ns)),
b AS (SELECT video_id, frame + k AS frame, s, x + (x - px) * k AS x, y + (y - py) * k AS y, 23.04::DOUBLE + 0.5::DOUBLE * sqrt(power(x - px, 2) + power(y - py, 2)) * k AS radius, 2 * frame AS rank FROM d, range(1, 4) r(k) WHERE pf = frame - 1 AND coalesce(nf > frame + k, true) AND coalesce(nf <> frame + 1, true)
  UNION ALL SELECT video_id, frame - k, s, x + (x - nx) * k, y + (y - ny) * k, 23.04::DOUBLE + 0.5::DOUBLE * sqrt(power(x - nx, 2) + power(y - ny, 2)) * k, 2 * frame + 1 FROM d, range(1, 4) r(k) WHERE nf = frame + 1 AND coalesce(pf < frame - k, true) AND coalesce(pf <> frame - 1, true)),
c AS (SELECT * FROM a UNION ALL SELECT b.video_id, b.frame, b.x, b.y, b.radius, b.rank FROM b JOIN size_ z ON b.video_id = z.video_id WHERE b.frame >= 0 AND b.frame < z.n AND b.s = (SELECT count(*) FROM cut c WHERE c.video_id = b.video_id AND c.frame <= b.frame))
SELECT video_id, frame::INT AS frame, round(x, 6) AS x, round(y, 6) AS y, round(radius, 6) AS radius FROM c QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY rank) = 1""")
def plan_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = A.frames(spark, sf_dir)
    cuts = f.where("event_id % 17 = 0").select("video_id", "frame")
    d = series.shots(f.select("video_id", "frame", "x", "y"), cuts)
    got = search.planned(d, cuts, f.groupBy("video_id").agg((F.max("frame") + 2).alias("n_frames")), 1920.0)
    return _round(got.select("video_id", "frame", "x", "y", "radius"), 6, "x", "y", "radius")


KV = "event_id * 7919 % 61 - 30"


@query("""WITH v AS (SELECT event_id, (event_id * 7919 % 61 - 30)::DOUBLE AS a, (event_id * 104729 % 67 - 33)::DOUBLE AS b, (event_id * 31 % 71 - 35)::DOUBLE AS c, (event_id * 17 % 73 - 36)::DOUBLE AS d FROM events), g AS (SELECT *, degrees(abs(atan2(a * d - b * c, a * c + b * d))) AS ang FROM v)
SELECT event_id, CASE WHEN ang < 45 THEN 0 WHEN b > 3 AND d < -3 THEN CASE WHEN sqrt(c * c + d * d) > 1.3::DOUBLE * sqrt(a * a + b * b) AND sqrt(c * c + d * d) > 30 THEN 4 ELSE 2 END WHEN ang >= 150 AND b < 0 THEN 4 ELSE 0 END AS kind FROM g""")
def kink_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = [(F.expr(f"event_id * {k} % {m} - {h}")).cast("double") for k, m, h in ((7919, 61, 30), (104729, 67, 33), (31, 71, 35), (17, 73, 36))]
    return A.read(spark, sf_dir, "events").select("event_id", geometry.kink_class(*v, 25.0, 1080.0).alias("kind"))


@query()
def track_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole tracker over points that move with their user's time, with noise and gaps."""
    f = A.frames(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("frame"))
    c = f.select("video_id", (n + F.floor(n / 25) * 3).cast("int").alias("frame"), F.lit(0).alias("cand_idx"), (200.0 + n % 90 * 15 + F.col("x") % 3).alias("x"), (600.0 - n % 90 * 5 + F.col("y") % 3).alias("y"), (0.5 + F.col("score") / 2).alias("score"))
    cuts = c.where("frame % 90 = 0").select("video_id", "frame")
    got = gapfill.track(c, cuts, 1920.0, 1080.0, 25.0)
    return _round(got.select("video_id", "shot_id", "frame", "x", "y", "conf", "flags", "detected"), 4, "x", "y", "conf")


# ---------------------------------------------------------------- jobs


@query(f"""WITH {A.JOBS}, {A.VIDEOS}, b AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY status IN ('queued', 'processing') DESC, created_at DESC, job_id DESC) AS k FROM jobs)
SELECT v.video_id, CASE WHEN b.status IN ('queued', 'processing') THEN b.status WHEN track_path IS NOT NULL THEN 'ready' ELSE v.status END AS status, CASE WHEN track_path IS NOT NULL THEN '/v1/tracks/' || v.video_id END AS track_url,
CASE WHEN b.status IN ('queued', 'processing') OR track_path IS NULL THEN b.job_id END AS job_id FROM videos v LEFT JOIN b ON v.video_id = b.video_id AND k = 1""")
def latest_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.public_videos(A.videos(spark, sf_dir), A.jobs(spark, sf_dir))


@query(f"""WITH {A.JOBS}, a AS (SELECT *, row_number() OVER (PARTITION BY video_id, start_s, end_s ORDER BY created_at, job_id) AS k FROM jobs WHERE status IN ('queued', 'processing'))
SELECT j.job_id AS request, a.job_id AS existing_job FROM jobs j LEFT JOIN a ON j.video_id = a.video_id AND j.start_s IS NOT DISTINCT FROM a.start_s AND j.end_s IS NOT DISTINCT FROM a.end_s AND k = 1 WHERE j.status = 'failed'""")
def dedupe_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = A.jobs(spark, sf_dir)
    r = j.where("status = 'failed'").select(F.col("job_id").alias("request"), "video_id", "start_s", "end_s")
    return jobs.dedupe(r, j).select("request", "existing_job")


@query(f"WITH {A.JOBS} SELECT job_id, CASE WHEN status = 'processing' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'processing' THEN 'interrupted' END AS error FROM jobs")
def job_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = A.jobs(spark, sf_dir).withColumns({"error": F.lit(None).cast("string"), "updated_at": F.col("created_at")})
    return jobs.recover(j, "2030-01-01").select("job_id", "status", "error")


@query(f"""WITH {A.JOBS}, s AS (SELECT video_id, max(created_at) AS at FROM jobs WHERE status = 'ready' GROUP BY 1), {A.VIDEOS} SELECT coalesce(v.video_id, s.video_id) AS video_id, CASE WHEN s.at IS NOT NULL THEN 'ready' ELSE v.status END AS status, CASE WHEN s.at IS NOT NULL THEN 'new/' || s.video_id ELSE track_path END AS track_path FROM videos v FULL JOIN s ON v.video_id = s.video_id""")
def upsert_video(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = A.jobs(spark, sf_dir).where("status = 'ready'").groupBy("video_id").agg(F.max("created_at").alias("at"))
    saved = saved.withColumns({"url": F.lit("u"), "segments": F.lit("[]"), "track_path": F.concat(F.lit("new/"), "video_id")})
    old = A.videos(spark, sf_dir).withColumns({"url": F.lit("v"), "segments": F.lit("[]"), "created_at": F.lit("2020"), "updated_at": F.lit("2020")})
    return jobs.upsert_tracks(old, saved).select("video_id", "status", "track_path")


# ---------------------------------------------------------------- scalars


@query("""WITH s AS (SELECT DISTINCT text, regexp_extract(text, '\\d+') AS d FROM conversations), c AS (SELECT text, CASE WHEN length(text) % 4 = 0 THEN (length(text) % 90)::VARCHAR ELSE (length(text) % 7)::VARCHAR || ':' || lpad((length(text) % 75)::VARCHAR, 2, '0') END AS s FROM s)
SELECT text, CASE WHEN s NOT LIKE '%:%' THEN s::DOUBLE WHEN split_part(s, ':', 2)::INT < 60 THEN split_part(s, ':', 1)::DOUBLE * 60 + split_part(s, ':', 2)::DOUBLE END AS seconds, CASE WHEN s LIKE '%:%' AND split_part(s, ':', 2)::INT >= 60 THEN 'range' END AS error FROM c""")
def parse_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.char_length("text")
    s = F.when(n % 4 == 0, (n % 90).cast("string")).otherwise(F.concat((n % 7).cast("string"), F.lit(":"), F.lpad((n % 75).cast("string"), 2, "0")))
    c = A.read(spark, sf_dir, "conversations").select("text").distinct()
    return c.select("text", clock.parse_time(s).alias("p")).select("text", "p.seconds", "p.error")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice >= 3600 THEN printf('%d:%02d:%06.3f', floor(o_totalprice / 3600)::BIGINT, floor(o_totalprice / 60)::BIGINT % 60, o_totalprice - floor(o_totalprice / 60) * 60) ELSE printf('%d:%06.3f', floor(o_totalprice / 60)::BIGINT, o_totalprice - floor(o_totalprice / 60) * 60) END AS s FROM orders""")
def format_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.read(spark, sf_dir, "orders").select("o_orderkey", clock.format_time(F.col("o_totalprice")).alias("s"))


@query("""SELECT o_orderkey, CASE WHEN floor(o_totalprice + 0.5)::BIGINT >= 3600 THEN printf('%d:%02d:%02d', floor(o_totalprice + 0.5)::BIGINT // 3600, floor(o_totalprice + 0.5)::BIGINT % 3600 // 60, floor(o_totalprice + 0.5)::BIGINT % 60) ELSE printf('%d:%02d', floor(o_totalprice + 0.5)::BIGINT // 60, floor(o_totalprice + 0.5)::BIGINT % 60) END AS s,
floor(greatest(0, o_totalprice - 30))::BIGINT AS start_s, ceil(least(o_totalprice + 12, o_totalprice + 30))::BIGINT AS end_s FROM orders""")
def format_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    o = A.read(spark, sf_dir, "orders").select("o_orderkey", clock.format_clock(p).alias("s"), clock.default_range(p, p + 12).alias("d"))
    return o.select("o_orderkey", "s", F.col("d.start").alias("start_s"), F.col("d.end").alias("end_s"))


@query("""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://youtu.be/' || substr(md5(url), 1, 11) WHEN 1 THEN 'www.youtube.com/watch?t=3&v=' || substr(md5(url), 1, 11) WHEN 2 THEN 'https://m.youtube.com/shorts/' || substr(md5(url), 1, 11) || '?x=1' WHEN 3 THEN 'https://www.youtube.com/watch?v=' || substr(md5(url), 1, 9) ELSE url END AS u, substr(md5(url), 1, 11) AS id FROM pages)
SELECT page_id, CASE WHEN page_id % 5 < 3 THEN id END AS video_id, CASE WHEN page_id % 5 < 3 THEN 'https://www.youtube.com/watch?v=' || id END AS url, CASE page_id % 5 WHEN 3 THEN 'no video id in the URL' WHEN 4 THEN 'not a video URL' END AS error FROM u""")
def normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = lambda n: F.substring(F.md5("url"), 1, n)
    k = F.col("page_id") % 5
    u = F.when(k == 0, F.concat(F.lit("https://youtu.be/"), h(11))).when(k == 1, F.concat(F.lit("www.youtube.com/watch?t=3&v="), h(11))).when(k == 2, F.concat(F.lit("https://m.youtube.com/shorts/"), h(11), F.lit("?x=1"))).when(k == 3, F.concat(F.lit("https://www.youtube.com/watch?v="), h(9))).otherwise(F.col("url"))
    return A.read(spark, sf_dir, "pages").select("page_id", ids.normalize_url(u).alias("n")).select("page_id", "n.video_id", "n.url", "n.error")


@query("SELECT page_id, substr(regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g'), 1, 64) AS safe FROM pages")
def safe_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.read(spark, sf_dir, "pages").select("page_id", ids.safe_id(F.col("url")).alias("safe"))


@query("SELECT event_id, CASE event_id % 8 WHEN 0 THEN '-' ELSE array_to_string(list_filter([CASE WHEN event_id % 8 & 1 <> 0 THEN 'interp' END, CASE WHEN event_id % 8 & 2 <> 0 THEN 'bounce' END, CASE WHEN event_id % 8 & 4 <> 0 THEN 'hit' END], lambda x: x IS NOT NULL), '+') END AS names FROM events")
def flag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.read(spark, sf_dir, "events").select("event_id", ids.flag_names((F.col("event_id") % 8).cast("int")).alias("names"))


@query("SELECT event_id, round(greatest(1.1::DOUBLE, least(1.5::DOUBLE, value / 50)), 6) AS ratio, round(greatest(0.5::DOUBLE, least(4.0::DOUBLE, value / 20)), 6) AS min_stroke, CASE WHEN event_type IN ('stadium', 'circle') THEN event_type ELSE 'stadium' END AS shape FROM events")
def settings_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = A.read(spark, sf_dir, "events"), F.col("value")
    return _round(e.select("event_id", settings.setting(v / 50, "ratio").alias("ratio"), settings.setting(v / 20, "min_stroke").alias("min_stroke"), settings.shape_setting(F.col("event_type")).alias("shape")), 6, "ratio", "min_stroke")


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity * 30 AS bw, 720.0::DOUBLE AS bh, CASE WHEN l_linenumber % 3 = 0 THEN greatest(l_quantity * 30 / 1920, 720.0::DOUBLE / 1080) ELSE least(l_quantity * 30 / 1920, 720.0::DOUBLE / 1080) END AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, round((bw - 1920 * s) / 2, 4) AS x, round((bh - 1080 * s) / 2, 4) AS y, round(1920 * s, 4) AS w, round(1080 * s, 4) AS h FROM b""")
def content_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = F.when(F.col("l_linenumber") % 3 == 0, "cover").otherwise("contain")
    r = geometry.content_rect(F.col("l_quantity") * 30, F.lit(720.0), F.lit(1920.0), F.lit(1080.0), fit)
    return _round(A.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r.alias("r")).select("l_orderkey", "l_linenumber", "r.x", "r.y", "r.w", "r.h"), 4, "x", "y", "w", "h")


@query(f"""WITH {A.ROWS} SELECT event_id, CASE WHEN sl > 0 AND sl >= 0.5 * r THEN 'stadium' ELSE 'circle' END AS kind, round(r * 1920 + greatest(0.2::DOUBLE * r * 1920, 1.5) / 2, 4) AS radius, round(greatest(0.2::DOUBLE * r * 1920, 1.5), 4) AS width FROM rows_""")
def ring_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("r") * 1920
    g = A.track_rows(spark, sf_dir).select("event_id", geometry.ring_shape(F.col("r"), F.col("sl"), F.col("sa"), F.lit("stadium"))["kind"].alias("kind"), geometry.ring_geometry(r, F.lit(1.2), F.lit(1.5)).alias("g"))
    return g.select("event_id", "kind", F.round("g.radius", 4).alias("radius"), F.round("g.width", 4).alias("width"))


@query(f"""WITH {A.ROWS}, p AS (SELECT *, lag(conf) OVER (PARTITION BY video_id ORDER BY event_id) AS pc FROM rows_), v AS (SELECT video_id, event_id AS pos, CASE WHEN conf < pc THEN 'rows must be sorted by t' WHEN NOT (x * 1.2 BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1) THEN 'x/y out of 0..1' WHEN event_id % 11 = 0 THEN 'ring must be #rrggbb' END AS rule FROM p)
SELECT video_id, min(pos) AS pos, arg_min(rule, pos) AS rule FROM v WHERE rule IS NOT NULL GROUP BY video_id""")
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = A.track_rows(spark, sf_dir).withColumns({"pos": F.col("event_id"), "t": F.col("conf"), "x": F.col("x") * 1.2, "ring": F.when(F.col("event_id") % 11 == 0, "red").otherwise(F.col("ring"))})
    return validate.first_violation(r)


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, event_type AS stage, value / 150 AS fraction, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events), a AS (SELECT user_id, k, t, stage, t AS lt, stage AS ls, true AS told FROM e WHERE k = 1 UNION ALL
SELECT e.user_id, e.k, e.t, e.stage, CASE WHEN e.stage <> ls OR e.t - lt >= 40000 OR e.fraction >= 1 THEN e.t ELSE lt END, CASE WHEN e.stage <> ls OR e.t - lt >= 40000 OR e.fraction >= 1 THEN e.stage ELSE ls END, e.stage <> ls OR e.t - lt >= 40000 OR e.fraction >= 1 FROM a JOIN e ON e.user_id = a.user_id AND e.k = a.k + 1) SELECT user_id, t, stage FROM a WHERE told""")
def throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.read(spark, sf_dir, "events").select("user_id", (A.micros("ts") / 1e6).alias("t"), F.col("event_type").alias("stage"), (F.col("value") / 150).alias("fraction"))
    return jobs.throttle(e, ["user_id"], 40000.0).select("user_id", "t", "stage")


# ---------------------------------------------------------------- recovery


@query(f"""WITH {A.ROWS}, f AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) AS frame FROM rows_), g AS (SELECT video_id, frame, frame // 30 AS shot_id, x * 100 AS x, y * 100 AS y, conf * 50 AS tone FROM f),
w AS (SELECT *, unnest([-4, 4, -8, 8, -12, 12]) AS "offset" FROM g WHERE frame % 3 = 0),
j AS (SELECT w.video_id, w.frame, w.frame + "offset" AS other, "offset", abs(w.tone - o.tone) AS mismatch FROM w JOIN g o ON w.video_id = o.video_id AND o.frame = w.frame + "offset" AND o.shot_id = w.shot_id WHERE sqrt((w.x - o.x) * (w.x - o.x) + (w.y - o.y) * (w.y - o.y)) > 20),
k AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY mismatch > 12, abs("offset"), mismatch, "offset") AS rank, sum((mismatch <= 12)::INT) OVER (PARTITION BY video_id, frame) AS good FROM j)
SELECT video_id, frame, other, "offset", round(mismatch, 6) AS mismatch, rank FROM k WHERE CASE WHEN good > 0 THEN mismatch <= 12 AND rank <= 4 ELSE rank <= 3 END""")
def background_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third row of a user seen as a frame whose background is wanted."""
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("t", "event_id"))
    g = A.track_rows(spark, sf_dir).select("video_id", n.cast("bigint").alias("frame"), (F.col("x") * 100).alias("x"), (F.col("y") * 100).alias("y"), (F.col("conf") * 50).alias("tone")).withColumn("shot_id", F.floor(F.col("frame") / 30))
    got = recover.background_frames(g.where("frame % 3 = 0"), g, lambda a, b: F.abs(F.col(f"{a}.tone") - F.col(f"{b}.tone")), 20.0)
    return _round(got, 6, "mismatch")


@query(f"""WITH {A.ROWS}, d AS (SELECT video_id, t + CASE WHEN event_id % 3 = 0 THEN 4e-4::DOUBLE WHEN event_id % 3 = 1 THEN 0 ELSE 0.5::DOUBLE END AS t, x + 0.01::DOUBLE * (event_id % 5) AS x FROM rows_)
SELECT r.video_id, count(*) AS n, round(avg(abs(r.x - d.x)), 6) AS mean_error, round(max(abs(r.x - d.x)), 6) AS max_error FROM rows_ r JOIN d ON r.video_id = d.video_id AND abs(r.t - d.t) <= 1e-3 GROUP BY r.video_id""")
def frame_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows paired with drawn ones at about the same time, and how far those lie off."""
    rows, e = A.track_rows(spark, sf_dir), F.col("event_id")
    drawn = rows.select("video_id", (F.col("t") + F.when(e % 3 == 0, 4e-4).when(e % 3 == 1, 0.0).otherwise(0.5)).alias("t"), (F.col("x") + 0.01 * (e % 5)).alias("x"))
    pairs = recover.paired(rows, drawn, ["x"], 1e-3)
    return _round(recover.errors(pairs, F.abs(F.col("x") - F.col("other_x"))), 6, "mean_error", "max_error")


@query(f"""WITH {A.ROWS}, f AS (SELECT video_id, event_id, conf, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) - 1 AS frame FROM rows_)
SELECT video_id, event_id, frame + 100 AS frame, round(359.5::DOUBLE + frame * 0.04::DOUBLE, 6) AS t FROM f""")
def source_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("t", "event_id"))
    f = A.track_rows(spark, sf_dir).select("video_id", "event_id", (n - 1).cast("bigint").alias("frame"))
    packets = f.select("video_id", "frame", (F.col("frame") * 0.04).alias("pts"))
    return _round(recover.source_time(f, packets, 359.5, 100).select("video_id", "event_id", "frame", "t"), 6, "t")


@query(f"""WITH {A.ROWS}, e AS (SELECT video_id, t AS "at", event_id % 3 <> 0 AS dismissed, event_id FROM rows_), m AS (SELECT max("at") - 86400.0::DOUBLE * 3 AS since FROM e),
k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY "at" DESC, dismissed) AS n FROM e)
SELECT video_id, "at" FROM k, m WHERE n = 1 AND dismissed AND "at" > since""")
def dismissals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event dismisses its video, or takes that back; what is older than three days before the last one lapses."""
    e = A.track_rows(spark, sf_dir).select("video_id", F.col("t").alias("at"), (F.col("event_id") % 3 != 0).alias("dismissed"))
    now = e.agg(F.max("at")).first()[0]
    return recover.dismissals(e.select("video_id", "at").limit(0), e, now, 86400.0 * 3)


# ---------------------------------------------------------------- documents, fit, page states


@query(f"""WITH {A.ROWS} SELECT video_id, (row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) - 1)::INT AS pos, t, x, y, r, conf, ring, flags, sl, sa FROM rows_""")
def expand_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's rows as one document, read back by the table function in a lateral join."""
    cells = [F.concat(F.lit('"'), F.col(c), F.lit('"')) if c == "ring" else F.col(c).cast("string") for c in ("t", "x", "y", "r", "conf", "ring", "flags", "sl", "sa")]
    line = F.concat(F.lit("["), F.concat_ws(",", *cells), F.lit("]"))
    rows = A.track_rows(spark, sf_dir).select("video_id", F.struct("t", "event_id", line.alias("line")).alias("e"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["line"]), ",")
    docs = rows.groupBy("video_id").agg(F.concat(F.lit('{"fields": ["t", "x", "y", "r", "conf", "ring", "flags", "sl", "sa"], "frames": ['), lines, F.lit("]}")).alias("doc"))
    return expand.expanded(docs, ["video_id"])


@query(f"""WITH {A.ROWS}, g AS (SELECT event_id, video_id, x * 100 AS cx, y * 100 AS cy, sl * 1000 AS half, sa AS angle, r * 1000 - 0.5::DOUBLE AS inner_, event_id % 5 / 4.0::DOUBLE AS radius, event_id * 7919 % 13 AS e FROM rows_),
p AS (SELECT *, unnest([[-1.0::DOUBLE, 0], [0, 0.5::DOUBLE], [1, 0.25::DOUBLE], [0.5::DOUBLE, -0.75::DOUBLE]]) AS q FROM g),
d AS (SELECT *, q[1] * e AS dx, q[2] * e AS dy FROM p), a AS (SELECT *, dx * cos(angle) + dy * sin(angle) AS al FROM d),
f AS (SELECT *, sqrt(power(dx - greatest(-half, least(half, al)) * cos(angle), 2) + power(dy - greatest(-half, least(half, al)) * sin(angle), 2)) + radius AS far_, abs(al) + radius AS along_ FROM a)
SELECT video_id, event_id, count(*) AS n, round(max(far_) - inner_, 6) AS overshoot, round(inner_ - max(far_), 6) AS side_gap, round(half + inner_ - max(along_), 6) AS tip_gap FROM f GROUP BY video_id, event_id, inner_, half""")
def fit_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's ring against an outline of four discs around it."""
    rows = A.track_rows(spark, sf_dir)
    rings = rows.select("video_id", "event_id", (F.col("x") * 100).alias("cx"), (F.col("y") * 100).alias("cy"), (F.col("sl") * 1000).alias("half"), F.col("sa").alias("angle"), (F.col("r") * 1000).alias("radius"), F.lit(1.0).alias("line"), (F.col("event_id") % 5 / 4.0).alias("ball"))
    q = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((-1.0, 0.0), (0.0, 0.5), (1.0, 0.25), (0.5, -0.75)))))
    e = F.col("event_id") * 7919 % 13
    outline = rings.withColumn("q", q).select("video_id", "event_id", (F.col("cx") + F.col("q.a") * e).alias("x"), (F.col("cy") + F.col("q.b") * e).alias("y"))
    return _round(fit.fit_check(rings, outline, F.col("ball"), frame="event_id"), 6, "overshoot", "side_gap", "tip_gap")


PAGE_EVENTS = """ev AS (SELECT user_id AS page, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id,
  CASE WHEN event_id % 9 < 2 THEN 'navigate' WHEN event_id % 9 < 5 THEN 'video' WHEN event_id % 9 < 7 THEN 'track' ELSE 'job' END AS kind,
  CASE WHEN event_id % 9 = 1 THEN NULL ELSE event_id % 31 END AS vid, ['ok', 'ok', 'missing', 'ok', 'unreachable', 'ok', 'refused'][(event_id * 7919 % 7 + 1)::INT] AS outcome,
  ['queued', 'processing', 'ready', 'failed', 'done'][(event_id * 31 % 5 + 1)::INT] AS status, event_id * 17 % 3 > 0 AS has_track, event_id * 13 % 2 = 0 AS has_job FROM events),
asked AS (SELECT *, sum((kind = 'navigate')::INT) OVER (PARTITION BY page ORDER BY seq) - (event_id % 4 = 0)::INT AS asked FROM ev)"""


@query(f"""WITH RECURSIVE {PAGE_EVENTS}, s AS (
  SELECT page, 0::BIGINT AS seq, 0::BIGINT AS gen, NULL::BIGINT AS video_id, 'idle' AS state, false AS track, false AS rq, false AS rfail, false AS waits, false AS fresh, 0 AS failures, false AS told FROM (SELECT DISTINCT page FROM ev)
  UNION ALL
  SELECT page, seq, gen, video_id, CASE WHEN NOT told THEN state WHEN kind = 'navigate' THEN CASE WHEN video_id IS NULL THEN 'idle' ELSE 'loading' END
      WHEN kind = 'video' THEN CASE WHEN outcome = 'missing' THEN 'none' WHEN outcome <> 'ok' THEN 'error' WHEN waits THEN state WHEN rq THEN 'job' WHEN track THEN 'ready' WHEN rfail THEN 'failed' ELSE 'none' END
      WHEN kind = 'track' THEN CASE WHEN fresh THEN CASE WHEN outcome = 'ok' THEN 'ready' ELSE 'error' END WHEN rq THEN 'job' WHEN track THEN 'ready' WHEN rfail THEN 'failed' ELSE 'none' END
      WHEN outcome = 'ok' AND status = 'failed' THEN CASE WHEN track THEN 'ready' ELSE 'failed' END WHEN outcome = 'ok' AND status NOT IN ('ready', 'done') THEN 'job' WHEN failures >= 8 THEN 'failed' ELSE state END,
    track, rq, rfail, waits, fresh, failures, told
  FROM (SELECT s.page, e.seq, e.kind, e.outcome, e.status, s.state, ok_, CASE WHEN nav THEN s.gen + 1 ELSE s.gen END AS gen, CASE WHEN nav THEN e.vid ELSE s.video_id END AS video_id,
      CASE WHEN nav THEN false WHEN live AND e.kind = 'track' AND ok_ THEN true ELSE s.track END AS track, CASE WHEN nav THEN false WHEN rec THEN e.status IN ('queued', 'processing') AND e.has_job ELSE s.rq END AS rq,
      CASE WHEN nav THEN false WHEN rec THEN e.status = 'failed' ELSE s.rfail END AS rfail, CASE WHEN nav THEN false WHEN rec THEN e.has_track ELSE s.waits END AS waits,
      CASE WHEN nav OR rec THEN false WHEN live AND e.kind = 'job' AND ok_ AND e.status IN ('ready', 'done') THEN true ELSE s.fresh END AS fresh,
      CASE WHEN nav THEN 0 WHEN NOT live THEN s.failures WHEN e.kind = 'job' AND NOT ok_ THEN s.failures + 1 ELSE 0 END AS failures, nav OR live AS told
    FROM s JOIN (SELECT *, kind = 'navigate' AS nav, outcome = 'ok' AS ok_ FROM asked) e ON e.page = s.page AND e.seq = s.seq + 1, LATERAL (SELECT NOT nav AND e.asked = s.gen AS live), LATERAL (SELECT live AND e.kind = 'video' AND ok_ AS rec)))
SELECT page, seq, gen, video_id, state AS status, track FROM s WHERE told""")
def page_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a page's navigations and answers, some of them to an older navigation."""
    e = F.col("event_id")
    pick = lambda k, *names: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    w = Window.partitionBy("page").orderBy("ts", "event_id")
    ev = A.read(spark, sf_dir, "events").select(
        F.col("user_id").alias("page"), "ts", "event_id", F.when(e % 9 < 2, "navigate").when(e % 9 < 5, "video").when(e % 9 < 7, "track").otherwise("job").alias("kind"), F.when(e % 9 != 1, e % 31).alias("video_id"),
        pick(e * 7919 % 7, "ok", "ok", "missing", "ok", "unreachable", "ok", "refused").alias("outcome"), pick(e * 31 % 5, "queued", "processing", "ready", "failed", "done").alias("status"), (e * 17 % 3 > 0).alias("has_track"), (e * 13 % 2 == 0).alias("has_job"),
    ).withColumn("seq", F.row_number().over(w).cast("bigint"))
    ev = ev.withColumn("asked", F.sum(F.when(F.col("kind") == "navigate", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)) - (e % 4 == 0).cast("int"))
    return lifecycle.page_states(ev)
