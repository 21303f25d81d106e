import math
import random
import time

import pytest
from pyspark.sql import functions as F

from trackspark.operators.near import run_stats, static_points

RADIUS = 6.72


def brute(points, radius=RADIUS, min_frames=4, min_span=12, min_visits=3, gap=2):
    out = []
    for v, ident, _, x, y in points:
        fs = sorted({f for w, _, f, a, b in points if w == v and math.hypot(x - a, y - b) <= radius})
        visits = 1 + sum(b - a > gap for a, b in zip(fs, fs[1:], strict=False))
        if len(fs) >= min_frames and fs[-1] - fs[0] >= min_span and visits >= min_visits:
            out.append((v, ident, len(fs), fs[-1] - fs[0], visits))
    return sorted(out)


def run(spark, points, **kw):
    df = spark.createDataFrame(points, "video_id string, id int, frame int, x double, y double")
    return sorted(map(tuple, static_points(df, RADIUS, ["video_id"], "id", **kw).collect()))


@pytest.mark.parametrize("spread", [0.0, 0.4, 2.0, 4.0, 9.0])
def test_equals_brute_force(spark, spread):
    r, pts = random.Random(int(spread * 10)), []
    for v in ("a", "b"):
        for _ in range(5):
            cx, cy = r.uniform(-50, 80), r.uniform(-50, 80)
            start = r.randrange(40)
            pts += [(v, len(pts) + k, start + r.choice([0, 1, 4, 9, 30]) + k // 3, cx + r.gauss(0, spread), cy + r.gauss(0, spread)) for k in range(30)]
        pts += [(v, len(pts) + k, k, 10.0 + 9 * k, 20.0) for k in range(40)]
    assert run(spark, pts) == brute(pts)


def test_points_on_the_radius_and_repeated_places(spark):
    pts = [("a", k, 7 * k, (k % 2) * RADIUS, 0.0) for k in range(8)] + [("a", 100 + k, 5 * k, 50.0, 50.0) for k in range(6)] + [("a", 100, 0, 50.0, 50.0)]
    got = {x[1]: x[2:] for x in run(spark, pts)}
    assert got[3] == (8, 49, 8) and got[105] == (6, 25, 6)


def test_frames_between_visits_join_them(spark):
    """More neighbours may mean fewer visits, so no cell decides a point by itself alone."""
    own = [("a", k, f, 0.0, 0.0) for k, f in enumerate((0, 1, 10, 11, 20, 21))]
    fill = [("a", 50 + f, f, 4.0, 0.0) for f in range(22)]
    assert {x[1] for x in run(spark, own)} == set(range(6)) and run(spark, own + fill) == brute(own + fill) == []


def test_stats_of_runs(spark):
    r = random.Random(3)
    sets = [[(a, a + r.randrange(4)) for a in (r.randrange(60) for _ in range(r.randrange(1, 9)))] for _ in range(200)]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sets)], "k int, runs array<struct<a: bigint, b: bigint>>")
    for k, s in df.select("k", run_stats(F.col("runs"), 2).alias("s")).collect():
        fs = sorted({f for a, b in sets[k] for f in range(a, b + 1)})
        assert tuple(s) == (len(fs), fs[-1] - fs[0], 1 + sum(y - x > 2 for x, y in zip(fs, fs[1:], strict=False)))


def test_a_wobbling_mark_takes_no_pairs(spark):
    n = 100_000
    wobble = lambda k: 500 + (F.randn(k) * 0.5)
    df = spark.range(n).select(F.lit("a").alias("video_id"), F.col("id"), (F.col("id") * 5).cast("int").alias("frame"), wobble(1).alias("x"), wobble(2).alias("y"))
    now = time.time()
    got = static_points(df, RADIUS, ["video_id"], "id").groupBy("frames", "visits").count().collect()
    assert sum(r["count"] for r in got) >= 0.99 * n and max(r.frames for r in got) == n and time.time() - now < 60
