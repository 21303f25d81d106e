"""Steps of the tracker after its pieces are fitted, as queries over pieces that the driver's events give, with their twins in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import TrackParams
from ..operators import gapfill
from . import adapters as A
from .queries import _round, query

P, WIDTH, HEIGHT, FPS = TrackParams(), 1920.0, 1080.0, 25.0


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six events of a user in turn make a piece (see linking.PIECE): some overlap, others lie up to seven frames apart."""
    e = F.col("event_id")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    rows = A.read(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.floor(n / 6).cast("int").alias("piece"), (n % 6).alias("i"), e, (e % 100 / 100.0).alias("score"))
    g = rows.groupBy("video_id", "piece").agg(F.min("event_id").alias("e"), F.transform(F.array_sort(F.collect_list(F.struct("i", "score"))), lambda s: s["score"]).alias("scores"))
    k, e, at = F.col("piece"), F.col("e"), F.transform("scores", lambda s, i: i + F.when(i >= 3, F.col("piece") % 3).otherwise(0))
    g = g.withColumns({"fa": (12 * k + k % 5).cast("int"), "x0": 100.0 + 30 * k + e % 40, "y0": 500.0 + 5 * k % 50 + e % 30})
    quadratic = lambda c, v, a: F.array(F.col(c), v.cast("double"), a.cast("double"))
    return g.select(
        "video_id", F.lit(0).alias("span"), "piece", "fa", (F.col("fa") + F.element_at(at, -1)).cast("int").alias("fb"), F.size("scores").alias("n"), (e % 7 / 2.0).alias("rms"), quadratic("x0", e % 9 - 0.5, (e % 5 - 2) / 20.0).alias("cx"), quadratic("y0", e % 7 - 3, (e % 3 - 1) / 20.0).alias("cy"),
        F.transform(at, lambda o: (F.col("fa") + o).cast("int")).alias("frames"), F.transform("scores", lambda s, i: F.col("x0") + i).alias("xs"), F.transform("scores", lambda s, i: F.col("y0") - i).alias("ys"), "scores",
    )


PIECES = """
rows_ AS (SELECT user_id AS video_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events),
pc0 AS (SELECT video_id, (n // 6)::INT AS piece, min(event_id) AS e, list((event_id % 100) / 100.0::DOUBLE ORDER BY n) AS scores FROM rows_ GROUP BY ALL),
pc AS (SELECT video_id, piece, 12 * piece + piece % 5 AS fa, len(scores) AS m, scores, (e % 7) / 2.0::DOUBLE AS rms, 100.0::DOUBLE + 30 * piece + e % 40 AS x0, 500.0::DOUBLE + 5 * piece % 50 + e % 30 AS y0,
  e % 9 - 0.5::DOUBLE AS vx, (e % 7 - 3)::DOUBLE AS vy, (e % 5 - 2) / 20.0::DOUBLE AS ax, (e % 3 - 1) / 20.0::DOUBLE AS ay, 12 * piece + piece % 5 + len(scores) - 1 + CASE WHEN len(scores) > 3 THEN piece % 3 ELSE 0 END AS fb FROM pc0)"""
INSIDE = PIECES + """,
sm AS (SELECT video_id, piece, i, fa + i + CASE WHEN i >= 3 THEN piece % 3 ELSE 0 END AS f, x0 + i AS xs, y0 - i AS ys,
  (scores[greatest(1, i - 1)] + scores[greatest(1, i)] + scores[i + 1] + scores[least(m, i + 2)] + scores[least(m, i + 3)]) / 5 AS s FROM (SELECT *, unnest(range(m)) AS i FROM pc)),
fr AS (SELECT *, unnest(range(fa, fb + 1)) AS frame FROM pc),
near AS (SELECT r.*, a.f AS pf, a.s AS sp, a.xs, a.ys, b.f AS nf, b.s AS sn, 0.75::DOUBLE + 0.25::DOUBLE * exp(-power(rms / 4.32::DOUBLE, 2)) AS shape FROM (SELECT fr.*, (SELECT max(i) FROM sm WHERE sm.video_id = fr.video_id AND sm.piece = fr.piece AND sm.f <= fr.frame) AS i FROM fr) r
  JOIN sm a ON a.video_id = r.video_id AND a.piece = r.piece AND a.i = r.i LEFT JOIN sm b ON b.video_id = r.video_id AND b.piece = r.piece AND b.i = r.i + 1),
val AS (SELECT video_id, frame, piece, pf = frame AS detected, x0 + vx * (frame - fa) + ax * (frame - fa) * (frame - fa) AS x, y0 + vy * (frame - fa) + ay * (frame - fa) * (frame - fa) AS y,
  CASE WHEN pf = frame THEN sp * shape ELSE least(sp, sn) * shape * power(CASE WHEN nf - pf - 1 <= 4 THEN 0.93::DOUBLE ELSE 0.85::DOUBLE END, least(frame - pf, nf - frame)) END AS conf, CASE WHEN pf = frame THEN xs END AS raw_x, CASE WHEN pf = frame THEN ys END AS raw_y FROM near WHERE pf = frame OR nf - pf - 1 <= 8),
own AS (SELECT * FROM val QUALIFY row_number() OVER (PARTITION BY video_id, frame ORDER BY detected DESC, round(conf, 12) DESC, piece) = 1)"""


@query(f"WITH {INSIDE} SELECT video_id, frame::INT AS frame, round(x, 6) AS x, round(y, 6) AS y, round(conf, 6) AS conf, CASE WHEN detected THEN 0 ELSE 1 END AS flags, detected, raw_x, raw_y, piece FROM own")
def piece_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best piece's point at every frame that pieces span."""
    return _round(gapfill.inside(pieces(spark, sf_dir), ["video_id", "span"], P, WIDTH).drop("span"), 6, "x", "y", "conf")


KINK = lambda a, b, c, d: f"""CASE WHEN degrees(abs(atan2({a} * {d} - {b} * {c}, {a} * {c} + {b} * {d}))) < 45 THEN 0 WHEN {b} > 3 AND {d} < -3 THEN CASE WHEN sqrt({c} * {c} + {d} * {d}) > 1.3::DOUBLE * sqrt({a} * {a} + {b} * {b}) AND sqrt({c} * {c} + {d} * {d}) > 30 THEN 4 ELSE 2 END
  WHEN degrees(abs(atan2({a} * {d} - {b} * {c}, {a} * {c} + {b} * {d}))) >= 150 AND {b} < 0 THEN 4 ELSE 0 END"""  # noqa: E731
PAIRS = """
pr AS (SELECT a.video_id, a.piece, a.fa AS afa, a.fb AS a1, a.m AS am, a.x0 AS acx, a.vx AS avx, a.ax AS aax, a.y0 AS acy, a.vy AS avy, a.ay AS aay, b.fa AS b0, b.fb AS bfb, b.m AS bm, b.x0 AS bcx, b.vx AS bvx, b.ax AS bax, b.y0 AS bcy, b.vy AS bvy, b.ay AS bay,
  a.vx + 2 * a.ax * (a.fb - a.fa) AS vax, a.vy + 2 * a.ay * (a.fb - a.fa) AS vay, b.vx AS vbx, b.vy AS vby, b.fa - a.fb - 1 AS gap
  FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY fa, fb, piece) AS o FROM pc) a JOIN (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY fa, fb, piece) AS o FROM pc) b ON a.video_id = b.video_id AND b.o = a.o + 1)"""


@query(f"""WITH {PIECES}, {PAIRS}, e AS (SELECT video_id, CASE WHEN b0 <= a1 THEN a1 ELSE (a1 + b0) // 2 END AS frame, {KINK("vax", "vay", "vbx", "vby")} AS event FROM pr WHERE b0 - a1 <= 2 AND a1 - afa >= 2 AND bfb - b0 >= 2)
SELECT video_id, frame::INT AS frame, bit_or(event)::INT AS event FROM e GROUP BY video_id, frame""")
def piece_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounces and hits where pieces meet."""
    return gapfill.events(pieces(spark, sf_dir), ["video_id", "span"], HEIGHT, FPS).drop("span")


def _models() -> str:
    ends = """g0 AS (SELECT p.*, pa.x AS pax, pa.y AS pay, pa.conf AS pac, pb.x AS pbx, pb.y AS pby, pb.conf AS pbc FROM pr p JOIN own pa ON pa.video_id = p.video_id AND pa.frame = p.a1 JOIN own pb ON pb.video_id = p.video_id AND pb.frame = p.b0
  WHERE gap > 0 AND gap <= 8 AND sqrt(power(pb.x - pa.x, 2) + power(pb.y - pa.y, 2)) <= 0.07::DOUBLE * 1920 * (gap + 1)),
g1 AS (SELECT *, 0.5::DOUBLE * (sqrt(vax * vax + vay * vay) + sqrt(vbx * vbx + vby * vby)) AS pace, pax - pbx - vax * a1 + vbx * b0 AS ddx, pay - pby - vay * a1 + vby * b0 AS ddy, power(vax - vbx, 2) + power(vay - vby, 2) AS e2 FROM g0),
g2 AS (SELECT *, 0.008::DOUBLE * 1920 + 0.25::DOUBLE * pace * gap AS tol, CASE WHEN e2 > 1e-9 THEN -(ddx * (vax - vbx) + ddy * (vay - vby)) / e2 ELSE (a1 + b0) / 2.0::DOUBLE END AS tk FROM g1)"""
    on = lambda s, c, t: f"(p{s}{c} + v{s}{c} * ({t} - {'a1' if s == 'a' else 'b0'}))"
    follow = lambda s, c, t: f"(CASE WHEN {s}m >= 6 AND {'a1 - afa' if s == 'a' else 'bfb - b0'} >= 8 THEN {s}c{c} + {s}v{c} * ({t} - {'afa' if s == 'a' else 'b0'}) + {s}a{c} * power({t} - {'afa' if s == 'a' else 'b0'}, 2) ELSE {on(s, c, t)} END)"
    apart = lambda t: f"sqrt(power({on('a', 'x', t)} - {on('b', 'x', t)}, 2) + power({on('a', 'y', t)} - {on('b', 'y', t)}, 2))"
    mode = f"""g3 AS (SELECT *, CASE WHEN gap <= 2 THEN 'linear' WHEN (vax * vbx + vay * vby) / greatest(1e-9, sqrt(vax * vax + vay * vay) * sqrt(vbx * vbx + vby * vby)) > cos(radians(20)) AND {apart('((a1 + b0) / 2.0::DOUBLE)')} <= tol THEN 'hermite'
  WHEN gap <= 6 AND tk > a1 AND tk < b0 AND {apart('tk')} <= 0.008::DOUBLE * 1920 + 0.1::DOUBLE * pace * gap THEN 'kink' WHEN sqrt(power({follow('b', 'x', 'a1')} - pax, 2) + power({follow('b', 'y', 'a1')} - pay, 2)) <= tol THEN 'right'
  WHEN sqrt(power({follow('a', 'x', 'b0')} - pbx, 2) + power({follow('a', 'y', 'b0')} - pby, 2)) <= tol THEN 'left' END AS mode FROM g2),
g4 AS (SELECT *, (f - a1) / (b0 - a1)::DOUBLE AS u FROM (SELECT *, unnest(range(a1 + 1, b0)) AS f FROM g3 WHERE mode IS NOT NULL))"""

    def value(c: str) -> str:
        a, b, mid = f"pa{c}", f"pb{c}", f"(0.5::DOUBLE * ({on('a', c, 'tk')} + {on('b', c, 'tk')}))"
        cubic = f"(2 * u * u * u - 3 * u * u + 1) * {a} + (u * u * u - 2 * u * u + u) * (b0 - a1) * va{c} + (3 * u * u - 2 * u * u * u) * {b} + (u * u * u - u * u) * (b0 - a1) * vb{c}"
        return f"""CASE mode WHEN 'hermite' THEN {cubic} WHEN 'kink' THEN CASE WHEN f <= tk THEN {a} + ({mid} - {a}) * (f - a1) / (tk - a1) ELSE {mid} + ({b} - {mid}) * (f - tk) / (b0 - tk) END
  WHEN 'right' THEN {follow('b', c, 'f')} + ({a} - {follow('b', c, 'a1')}) * (1 - u) WHEN 'left' THEN {follow('a', c, 'f')} + ({b} - {follow('a', c, 'b0')}) * u ELSE {a} + u * ({b} - {a}) END"""

    return f"""WITH {INSIDE}, {PAIRS}, {ends}, {mode}
SELECT video_id, f::INT AS frame, round({value('x')}, 6) AS x, round({value('y')}, 6) AS y, round(least(pac, pbc) * power(CASE WHEN gap <= 4 THEN 0.93::DOUBLE ELSE 0.88::DOUBLE END, least(f - a1, b0 - f)) * CASE WHEN mode IN ('right', 'left', 'kink') THEN 0.8::DOUBLE ELSE 1 END, 6) AS conf,
  (CASE WHEN mode = 'kink' AND f = round_even(tk, 0) THEN {KINK("vax", "vay", "vbx", "vby")} ELSE 0 END + 1)::INT AS flags, mode FROM g4"""


@query(_models())
def gap_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points between neighbouring pieces, by the first model that agrees with both."""
    p = pieces(spark, sf_dir)
    got = gapfill.gaps(p, gapfill.inside(p, ["video_id", "span"], P, WIDTH), ["video_id", "span"], P, WIDTH, HEIGHT, FPS)
    return _round(got.select("video_id", "frame", "x", "y", "conf", "flags", "mode"), 6, "x", "y", "conf")
