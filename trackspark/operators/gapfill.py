"""From fitted pieces to track points, with native expressions: evaluation, gaps, events, snapping."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import FLAG_INTERPOLATED, TrackParams
from ..functions.geometry import hermite, kink_class, kink_time, quality
from ..tables import table


def _at(c: str, t: Column) -> Column:
    return F.col(c)[0] + F.col(c)[1] * t + F.col(c)[2] * t * t


def _speed(c: Column, t: Column) -> Column:
    return c[1] + 2 * c[2] * t


def inside(pieces: DataFrame, keys: list[str], p: TrackParams, width: float) -> DataFrame:
    """keys, frame, x, y, conf, flags, detected, raw_x, raw_y, piece: the best piece's value at every frame that a piece spans."""
    tol = p.fit_tol * width
    n = F.size("scores")
    pad = F.concat(F.array_repeat(F.col("scores")[0], F.lit(2)), F.col("scores"), F.array_repeat(F.element_at("scores", -1), F.lit(2)))
    q = pieces.withColumn("_pad", pad)
    q = q.withColumn("_sm", F.transform(F.sequence(F.lit(1), n), lambda k: F.aggregate(F.slice("_pad", k, 5), F.lit(0.0), lambda a, v: a + v) / 5))
    q = q.withColumn("frame", F.explode(F.sequence("fa", "fb")))
    q = q.withColumn("_k", F.size(F.filter("frames", lambda f: f <= F.col("frame"))))
    sm, fr = lambda k: F.col("_sm")[k], lambda k: F.col("frames")[k]
    k = F.col("_k") - 1
    detected = fr(k) == F.col("frame")
    q = q.withColumns({"detected": detected, "_prev": fr(k), "_next": F.get(F.col("frames"), k + 1), "_sp": sm(k), "_sn": F.get(F.col("_sm"), k + 1)})
    gap = F.col("_next") - F.col("_prev") - 1
    shape = 0.75 + 0.25 * quality(F.col("rms"), tol)
    far = F.least(F.col("frame") - F.col("_prev"), F.col("_next") - F.col("frame")).cast("double")
    conf = F.when(F.col("detected"), F.col("_sp") * shape).otherwise(F.least("_sp", "_sn") * shape * F.pow(F.when(gap <= 4, 0.93).otherwise(0.85), far))
    q = q.where(F.col("detected") | (gap <= p.max_gap))
    t = (F.col("frame") - F.col("fa")).cast("double")
    raw = lambda c: F.when(F.col("detected"), F.col(c)[k])
    q = q.select(*keys, "frame", _at("cx", t).alias("x"), _at("cy", t).alias("y"), conf.alias("conf"), F.when(F.col("detected"), 0).otherwise(FLAG_INTERPOLATED).alias("flags"), "detected", raw("xs").alias("raw_x"), raw("ys").alias("raw_y"), "piece")
    # at a frame that two pieces share, a detected point first, then the surer one, then the earlier piece
    w = Window.partitionBy(*keys, "frame").orderBy(F.desc("detected"), F.desc("conf"), "piece")
    return q.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def gaps(pieces: DataFrame, points: DataFrame, keys: list[str], p: TrackParams, width: float, height: float, fps: float) -> DataFrame:
    """Points (as of inside()) for short gaps between neighbouring pieces, by the first model that agrees with both.

    Up to two frames a line; else a cubic through both ends if the pieces meet smoothly; else two lines if they meet within a
    gap of at most six; else the later piece followed back, or the earlier one on; else nothing.
    """
    w = Window.partitionBy(*keys).orderBy("fa", "fb", "piece")
    side = F.struct("fa", "fb", "n", "cx", "cy")
    g = pieces.select(*keys, "fa", "fb", "piece", side.alias("a"), F.lead(side).over(w).alias("b")).where("b IS NOT NULL")
    a1, b0 = F.col("a.fb"), F.col("b.fa")
    g = g.withColumn("gap", b0 - a1 - 1).where((F.col("gap") > 0) & (F.col("gap") <= p.max_gap))
    ends = points.select(*keys, F.col("frame").alias("_f"), F.struct("x", "y", "conf").alias("_p"))
    g = g.select(*keys, "a", "b", "gap", a1.alias("a1"), b0.alias("b0"))
    g = g.join(ends.withColumnsRenamed({"_f": "a1", "_p": "pa"}), [*keys, "a1"]).join(ends.withColumnsRenamed({"_f": "b0", "_p": "pb"}), [*keys, "b0"])
    g = g.where(F.hypot(F.col("pb.x") - F.col("pa.x"), F.col("pb.y") - F.col("pa.y")) <= p.max_speed * width * 25.0 / fps * (F.col("gap") + 1))
    ta, tb = (F.col("a1") - F.col("a.fa")).cast("double"), F.lit(0.0)
    g = g.withColumns({"vax": _speed(F.col("a.cx"), ta), "vay": _speed(F.col("a.cy"), ta), "vbx": _speed(F.col("b.cx"), tb), "vby": _speed(F.col("b.cy"), tb)})
    va, vb = F.hypot("vax", "vay"), F.hypot("vbx", "vby")
    g = g.withColumn("pace", 0.5 * (va + vb)).withColumn("tol", 0.008 * width + 0.25 * F.col("pace") * F.col("gap"))
    mid = (F.col("a1") + F.col("b0")) / 2
    line = lambda P, v, f0: (F.col(f0), F.col(f"{P}.x"), F.col(f"{P}.y"), F.col(f"{v}x"), F.col(f"{v}y"))
    g = g.withColumn("tk", kink_time(line("pa", "va", "a1"), line("pb", "vb", "b0"), mid))
    g = table(g, "gaps")  # what is decided so far is written, so that no expression below repeats it
    on = lambda P, v, f0, t, c: F.col(f"{P}.{c}") + F.col(f"{v}{c}") * (t - F.col(f0))
    apart = lambda t: F.hypot(on("pa", "va", "a1", t, "x") - on("pb", "vb", "b0", t, "x"), on("pa", "va", "a1", t, "y") - on("pb", "vb", "b0", t, "y"))
    cos = (F.col("vax") * F.col("vbx") + F.col("vay") * F.col("vby")) / F.greatest(F.lit(1e-9), va * vb)
    strong = lambda s: (F.col(f"{s}.n") >= 6) & (F.col(f"{s}.fb") - F.col(f"{s}.fa") >= 8)

    def follow(s: str, P: str, v: str, f0: str, t: Column, c: str) -> Column:
        """A well supported piece goes on by its own quadratic, another by its last velocity."""
        u = (t - F.col(f"{s}.fa")).cast("double")
        k = F.col(f"{s}.c{c}")
        return F.when(strong(s), k[0] + k[1] * u + k[2] * u * u).otherwise(on(P, v, f0, t, c))

    back = F.hypot(follow("b", "pb", "vb", "b0", F.col("a1"), "x") - F.col("pa.x"), follow("b", "pb", "vb", "b0", F.col("a1"), "y") - F.col("pa.y"))
    ahead = F.hypot(follow("a", "pa", "va", "a1", F.col("b0"), "x") - F.col("pb.x"), follow("a", "pa", "va", "a1", F.col("b0"), "y") - F.col("pb.y"))
    meets = (F.col("gap") <= 6) & (F.col("tk") > F.col("a1")) & (F.col("tk") < F.col("b0")) & (apart(F.col("tk")) <= 0.008 * width + 0.1 * F.col("pace") * F.col("gap"))
    mode = F.when(F.col("gap") <= 2, "linear").when((cos > math.cos(math.radians(20))) & (apart(mid) <= F.col("tol")), "hermite").when(meets, "kink").when(back <= F.col("tol"), "right").when(ahead <= F.col("tol"), "left")
    g = table(g.withColumn("mode", mode).where("mode IS NOT NULL"), "gaps")
    g = g.withColumn("kinds", kink_class(F.col("vax"), F.col("vay"), F.col("vbx"), F.col("vby"), fps, height))
    g = g.withColumn("frame", F.explode(F.sequence(F.col("a1") + 1, F.col("b0") - 1)))
    f, u = F.col("frame"), (F.col("frame") - F.col("a1")) / (F.col("b0") - F.col("a1"))

    def value(c: str) -> Column:
        A, B, tk = F.col(f"pa.{c}"), F.col(f"pb.{c}"), F.col("tk")
        K = 0.5 * (on("pa", "va", "a1", tk, c) + on("pb", "vb", "b0", tk, c))
        kink = F.when(f <= tk, A + (K - A) * (f - F.col("a1")) / (tk - F.col("a1"))).otherwise(K + (B - K) * (f - tk) / (F.col("b0") - tk))
        right = follow("b", "pb", "vb", "b0", f, c) + (A - follow("b", "pb", "vb", "b0", F.col("a1"), c)) * (1 - u)
        left = follow("a", "pa", "va", "a1", f, c) + (B - follow("a", "pa", "va", "a1", F.col("b0"), c)) * u
        m = F.col("mode")
        return F.when(m == "hermite", hermite(u, F.col("b0") - F.col("a1"), A, F.col(f"va{c}"), B, F.col(f"vb{c}"))).when(m == "kink", kink).when(m == "right", right).when(m == "left", left).otherwise(A + u * (B - A))

    decay = F.pow(F.when(F.col("gap") <= 4, 0.93).otherwise(0.88), F.least(f - F.col("a1"), F.col("b0") - f).cast("double"))
    conf = F.least("pa.conf", "pb.conf") * decay * F.when(F.col("mode").isin("right", "left", "kink"), 0.8).otherwise(1.0)
    flags = F.when((F.col("mode") == "kink") & (f == F.bround("tk", 0)), F.col("kinds") + FLAG_INTERPOLATED).otherwise(FLAG_INTERPOLATED)
    none = F.lit(None).cast("double")
    return g.select(*keys, "frame", value("x").alias("x"), value("y").alias("y"), conf.alias("conf"), flags.cast("int").alias("flags"), F.lit(False).alias("detected"), none.alias("raw_x"), none.alias("raw_y"), F.lit(-1).alias("piece"), "mode")


def events(pieces: DataFrame, keys: list[str], height: float, fps: float) -> DataFrame:
    """keys, frame, event at the bounds of pieces at most two frames apart that both span two frames."""
    w = Window.partitionBy(*keys).orderBy("fa", "fb", "piece")
    nxt = {f"n_{c}": F.lead(c).over(w) for c in ("fa", "fb", "cx", "cy")}
    e = pieces.withColumns(nxt).where((F.col("n_fa") - F.col("fb") <= 2) & (F.col("fb") - F.col("fa") >= 2) & (F.col("n_fb") - F.col("n_fa") >= 2))
    t = (F.col("fb") - F.col("fa")).cast("double")
    kind = kink_class(_speed(F.col("cx"), t), _speed(F.col("cy"), t), _speed(F.col("n_cx"), F.lit(0.0)), _speed(F.col("n_cy"), F.lit(0.0)), fps, height)
    at = F.when(F.col("n_fa") <= F.col("fb"), F.col("fb")).otherwise(F.floor((F.col("fb") + F.col("n_fa")) / 2))
    return e.select(*keys, at.cast("int").alias("frame"), kind.alias("event")).groupBy(*keys, "frame").agg(F.bit_or("event").alias("event"))


def track(candidates: DataFrame, cuts: DataFrame, width: float, height: float, fps: float, p: TrackParams = TrackParams(), key: str = "video_id") -> DataFrame:
    """key, frame, x, y, conf, flags, detected, raw_x, raw_y, piece, shot_id of the whole tracker; candidates have key, frame, cand_idx, x, y, score.

    Static points go first, shots are linked and cut into pieces, pieces are evaluated and gaps between them filled, bounces and
    hits are labelled, and interpolated points move to a weak candidate close by.
    """
    from .linking import fit_pieces
    from .near import static_points
    from .series import shots

    ident = candidates.withColumn("_id", F.struct("frame", "cand_idx"))
    bad = static_points(ident, p.static_radius * width, [key], "_id", "frame", p.static_min_frames, p.static_min_span, p.static_min_visits)
    moving = ident.join(bad.select(key, "_id"), [key, "_id"], "left_anti").drop("_id")
    keys = [key, "shot_id"]
    in_shots = shots(moving, cuts, key)
    # a span is a part of a shot that no step sees across; what several steps read is written once
    pieces = table(fit_pieces(in_shots, keys, width, fps, p), "pieces")
    return points(pieces, moving, [*keys, "span"], width, height, fps, p, key)


def points(pieces: DataFrame, candidates: DataFrame, keys: list[str], width: float, height: float, fps: float, p: TrackParams = TrackParams(), key: str = "video_id") -> DataFrame:
    """The track of fitted pieces (see linking.PIECE; keys name a span and include key and shot_id); candidates are what interpolated points may move to."""
    own = table(inside(pieces, keys, p, width), "points")
    filled = own.unionByName(gaps(pieces, own, keys, p, width, height, fps).drop("mode"))
    ev = events(pieces, keys, height, fps)
    pts = filled.join(ev, [*keys, "frame"], "left").withColumn("flags", F.col("flags").bitwiseOR(F.coalesce("event", F.lit(0)))).drop("event", "span")
    pts = table(pts.where(F.col("conf") >= p.min_conf), "track")
    weak = candidates.where(F.col("score") >= 0.5 * p.min_score).select(key, "frame", "cand_idx", "x", "y")
    snap = pts.where(~F.col("detected")).select(key, "frame", F.col("x").alias("_px"), F.col("y").alias("_py")).join(weak, [key, "frame"])
    snap = snap.withColumn("_d", F.hypot(F.col("x") - F.col("_px"), F.col("y") - F.col("_py"))).where(F.col("_d") <= 0.015 * width)
    snap = snap.groupBy(key, "frame").agg(F.min(F.struct("_d", "cand_idx", "x", "y")).alias("_s"))
    out = pts.join(snap, [key, "frame"], "left")
    hit = F.col("_s").isNotNull() & ~F.col("detected")
    pick = lambda a, b: F.when(hit, a).otherwise(F.col(b)).alias(b)
    return out.select(key, "shot_id", "frame", pick(F.col("_s.x"), "x"), pick(F.col("_s.y"), "y"), "conf", pick(F.col("flags").bitwiseAND(~FLAG_INTERPOLATED), "flags"), pick(F.lit(True), "detected"), pick(F.col("_s.x"), "raw_x"), pick(F.col("_s.y"), "raw_y"), "piece")
