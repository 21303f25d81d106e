import math
import random

import numpy as np
from test_static import RADIUS, brute, run

from trackspark.operators import near


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def dense(spark, n):
    """n points around six radii wide, each in a frame of its own, and what SQL counts for them."""
    r = np.random.default_rng(n)
    x, y, f = r.uniform(0, 6 * RADIUS, n), r.uniform(0, 6 * RADIUS, n), r.permutation(9 * n)[:n]
    want = []
    for k in range(n):
        fs = np.sort(f[(x - x[k]) ** 2 + (y - y[k]) ** 2 <= RADIUS * RADIUS])
        if len(fs) >= 4 and fs[-1] - fs[0] >= 12 and (v := 1 + int((np.diff(fs) > 2).sum())) >= 3:
            want.append((k, len(fs), int(fs[-1] - fs[0]), v))
    points = spark.createDataFrame([("a", k, int(f[k]), float(x[k]), float(y[k])) for k in range(n)], "video_id string, id int, frame int, x double, y double")
    before = shuffled(spark)
    got = near.static_points(points, RADIUS, ["video_id"], "id").drop("video_id").collect()
    assert sorted(map(tuple, got)) == want
    return shuffled(spark) - before


def test_what_is_moved_grows_with_the_points_and_not_with_the_pairs(spark):
    few, many = dense(spark, 2000), dense(spark, 6000)
    assert many < 4 * few


def test_a_block_in_parts(spark, monkeypatch):
    monkeypatch.setattr(near, "PART", 7)
    monkeypatch.setattr(near, "PAIRS", 50)
    r = random.Random(8)
    pts = [(v, k, r.randrange(200), r.gauss(20, 9), r.gauss(-5, 9)) for v in ("a", "b") for k in range(150)]
    want = brute(pts)
    assert len(want) > 100 and run(spark, pts) == want


def test_points_without_a_place_or_frame_take_no_others_along(spark):
    pts = [("a", k, 7 * k, 1.0 + k % 2 * 6.0, 1.0) for k in range(8)]
    odd = [("a", 90, 3, math.nan, 1.0), ("a", 91, 3, math.inf, 1.0), ("a", 92, 3, None, 1.0), ("a", 93, None, 1.0, 1.0)]
    assert len(brute(pts)) == 8 and run(spark, pts + odd) == brute(pts)
