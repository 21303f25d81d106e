import math

import pytest

from trackspark.config import TrackParams
from trackspark.operators.gapfill import track

W, H = 1920.0, 1080.0


def flight(n, x0=300.0, y0=700.0, vx=14.0, vy=-16.0, g=0.5):
    return {f: (x0 + vx * f, y0 + vy * f + 0.5 * g * f * f) for f in range(n)}


def run(spark, points, cuts=(), fps=25.0, extra=(), score=0.95):
    rows = [("v", f, 0, float(x), float(y), score) for f, (x, y) in points.items()] + [("v", f, k + 1, float(x), float(y), float(s)) for k, (f, x, y, s) in enumerate(extra)]
    c = spark.createDataFrame(rows, "video_id string, frame int, cand_idx int, x double, y double, score double")
    k = spark.createDataFrame([("v", f) for f in cuts], "video_id string, frame int")
    return {r.frame: r for r in track(c, k, W, H, fps).collect()}


def off(got, want):
    return math.hypot(got.x - want[0], got.y - want[1])


def test_smooth_flight(spark):
    p = flight(40)
    got = run(spark, p)
    assert set(got) == set(p) and all(off(got[f], p[f]) < 1 for f in p)


@pytest.mark.parametrize(("gap", "filled"), [(1, True), (3, True), (5, True), (8, True), (12, False)])
def test_gaps(spark, gap, filled):
    p = flight(50)
    seen = {f: v for f, v in p.items() if not 20 <= f < 20 + gap}
    got = run(spark, seen)
    assert all((f in got) == filled for f in range(20, 20 + gap))
    assert all(off(got[f], p[f]) < 4 for f in got)
    if filled:
        assert all(got[f].flags & 1 and got[f].conf < got[19].conf for f in range(20, 20 + gap))


def test_bounce_and_outlier_and_distractor(spark):
    p = {f: (400.0 + 10 * f, 300.0 + 18 * f if f <= 20 else 660.0 - 14 * (f - 20)) for f in range(41)}
    got = run(spark, p, extra=[(f, 1500.0 - 9 * f, 200.0 + 5 * f, 0.5) for f in range(0, 41, 3)])
    assert all(off(got[f], p[f]) < 4 for f in got) and len(got) >= 39
    assert any(got[f].flags & 2 for f in (19, 20, 21))
    q = flight(40)
    bad = dict(q) | {18: (1700.0, 100.0)}
    got = run(spark, bad)
    assert off(got[18], q[18]) < 4 and not got[18].detected


def test_static_and_cut_and_single(spark):
    p = flight(60)
    got = run(spark, p, extra=[(f, 1000.0, 900.0, 0.99) for f in (3, 4, 20, 21, 22, 40, 55)])
    assert all(off(got[f], p[f]) < 2 for f in got) and len(got) == 60
    seen = {f: v for f, v in flight(40).items() if f not in (19, 20)}
    got = run(spark, seen, cuts=[20])
    assert 19 not in got and 20 not in got
    assert run(spark, {5: (100.0, 100.0)}) == {}


def test_weak_candidate_replaces_interpolation(spark):
    p = flight(40)
    seen = {f: v for f, v in p.items() if f != 20}
    got = run(spark, seen, extra=[(20, p[20][0] + 5, p[20][1], 0.1)])
    assert got[20].detected and abs(got[20].x - p[20][0] - 5) < 1e-9 and not got[20].flags & 1
    assert TrackParams().min_score > 0.1
