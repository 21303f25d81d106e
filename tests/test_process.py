import math

import numpy as np
import pytest

from trackspark.operators import crops, recover
from trackspark.plans import process
from trackspark.sources import frames

W, H, FPS, N = 640, 360, 25.0, 70
GONE = range(30, 38)


def at(f):
    return 60.0 + 7.5 * f, 250.0 - 9.0 * f + 0.14 * f * f


def image(f, ground, rng):
    """The ball as a disc of 2 pixels, moving along its exposure, over a bright and a dark half."""
    img = ground + rng.normal(0, 1.0, ground.shape)
    yy, xx = np.mgrid[0:H, 0:W] + 0.5
    cover = np.zeros((H, W))
    for u in np.linspace(-0.15, 0.15, 7):
        x, y = at(f + u)
        cover += np.clip(2.5 - np.hypot(xx - x, yy - y), 0, 1) / 7
    img += cover[..., None] * (np.array([130, 140, 85]) - img)
    return np.clip(np.rint(img), 0, 255).astype(np.uint8).tobytes()


@pytest.fixture(scope="module")
def clip(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("clip")
    rng = np.random.default_rng(2)
    ground = np.full((H, W, 3), 35.0)
    ground[:, 300:] = (60.0, 70.0, 50.0)
    (folder / "v.frames").write_bytes(frames.packed("v", W, H, FPS, [image(f, ground, rng) for f in range(N)]))
    seen = [("v", f, 0, *at(f), 0.9) for f in range(N) if f not in GONE]
    c = spark.createDataFrame(seen, "video_id string, frame int, cand_idx int, x double, y double, score double")
    cuts = spark.createDataFrame([], "video_id string, frame int")
    return c, cuts, frames.frame_files(spark, str(folder))


def off(r, f):
    return math.hypot(r.x - at(f)[0], r.y - at(f)[1])


def test_windows_are_what_the_frame_shows(spark, clip, tmp_path):
    _, cuts, files = clip
    w = spark.createDataFrame([("v", 5, 100.4, 200.5, 12), ("v", 40, 636.0, 10.0, 12), ("v", 69, 700.0, 10.0, 12), ("v", 20, 50.0, 50.0, 12)], "video_id string, frame int, cx double, cy double, half int")
    from pyspark.sql import functions as F

    wanted = w.withColumn("box", crops.square(F.col("cx"), F.col("cy"), F.col("half"), W, H)).where("box IS NOT NULL")
    known = spark.createDataFrame([("v", 16, 50.0, 50.0), ("v", 24, 90.0, 50.0)], "video_id string, frame int, x double, y double")
    near = F.hypot(F.col("qx") - F.col("cx"), F.col("qy") - F.col("cy")) < 20
    cut_ = spark.createDataFrame([("v", 45)], "video_id string, frame int")
    got = {(r.frame, r.offset): r for r in crops.cut(crops.with_background(wanted, known, near, cut_, files), files).collect()}
    assert {k for k in got} == {(5, o) for o in (0, -4, 4, 8, 12)} | {(40, o) for o in (0, -4, -8, -12, 4)} | {(20, o) for o in (0, 4, -8, 8, -12, 12)}
    raw = {x.frame: np.frombuffer(x.rgb, np.uint8).reshape(H, W, 3) for x in frames.read_frames(spark, files.first().path).collect()}
    for (f, o), r in got.items():
        x0 = {5: 88, 40: 624, 20: 38}[f]
        y0 = {5: 188, 40: 0, 20: 38}[f]
        assert (r.box["x0"], r.box["y0"]) == (x0, y0)
        assert r.rgb == raw[f + o][y0 : r.box["y1"], x0 : r.box["x1"]].tobytes()


def test_differences_equal_a_plain_reference(spark):
    rng = np.random.default_rng(3)
    box = {"x0": 4, "y0": 6, "x1": 24, "y1": 21}
    images = {o: rng.integers(0, 40 if o != 8 else 255, (15, 20, 3)).astype(np.uint8) for o in (0, *crops.OFFSETS)}
    rows = [("v", 9, o, box, bytearray(i.tobytes())) for o, i in images.items()] + [("v", 3, 0, box, bytearray(900)), ("v", 3, 4, box, bytearray(900))]
    df = spark.createDataFrame(rows, "video_id string, frame int, offset int, box struct<x0: int, y0: int, x1: int, y1: int>, rgb binary")
    got = crops.differences(df).collect()
    assert [r.frame for r in got] == [9]  # one window is no background
    score = {o: np.percentile(np.abs(images[o].astype(int) - images[0].astype(int)).max(axis=2), 75) for o in crops.OFFSETS}
    ground = np.median([images[o] for o in sorted(crops.OFFSETS, key=lambda o: score[o])[:4]], axis=0).astype(np.uint8)
    apart = images[0].astype(float) - ground
    assert np.allclose(got[0]["values"], np.sqrt((apart**2).sum(2)).ravel()) and np.allclose(got[0].light, (apart * [0.299, 0.587, 0.114]).sum(2).ravel())
    around = spark.createDataFrame([("v", 9, 14.0, 13.0, 5.0)], "video_id string, frame int, cx double, cy double, away double")
    yy, xx = np.mgrid[0:15, 0:20]
    far = np.hypot(xx + 4 - 14.0, yy + 6 - 13.0) > 5
    score = {o: np.percentile(np.abs(images[o].astype(int) - images[0].astype(int)).max(axis=2)[far], 90) for o in crops.OFFSETS}
    assert min(score.values()) > crops.UNLIKE
    ground = np.median([images[o] for o in sorted(crops.OFFSETS, key=lambda o: score[o])[:3]], axis=0).astype(np.uint8)
    assert np.allclose(crops.differences(df, around).first()["values"], np.sqrt(((images[0].astype(float) - ground) ** 2).sum(2)).ravel())


def test_search_finds_the_lost_balls(spark, clip):
    c, cuts, files = clip
    from pyspark.sql import functions as F

    plan = spark.createDataFrame([("v", f, at(f)[0] + 5, at(f)[1] - 4, 500.0 if f == 33 else 20.0) for f in GONE], "video_id string, frame int, x double, y double, radius double")
    radii = spark.createDataFrame([("v", 0, 2.2), ("v", 69, 2.2)], "video_id string, frame int, r double")
    got = {r.frame: r for r in recover.search_frames(plan, c, radii, cuts, files, W, H).collect()}
    assert set(got) == set(GONE) and all(off(got[f], f) < 0.6 and got[f].score > 0.3 for f in got)
    elsewhere = plan.withColumn("x", F.lit(500.0)).withColumn("y", F.lit(300.0))
    assert recover.search_frames(elsewhere, c, radii, cuts, files, W, H).collect() == []


def test_whole_chain(spark, clip):
    c, cuts, files = clip
    got = {r.frame: r for r in process.processed(c, cuts, files, W, H, FPS).collect()}
    print([(f, got[f].detected, round(off(got[f], f), 2), round(got[f].r, 2)) for f in sorted(got)])
    assert set(got) == set(range(N)) and all(got[f].measured for f in GONE) and sum(got[f].detected for f in GONE) >= 6
    assert max(off(got[f], f) for f in range(2, N - 2)) < 0.8
    assert all(1.2 < r.r < 3.5 for r in got.values())
    assert {got[f].ring for f in range(5, 25)} == {"#f5f5f5"} and {r.ring for f, r in got.items() if f > 45} <= {"#f5f5f5", "#101010", "#ff00ff"}
    plain = {r.frame: r for r in process.processed(c, cuts, files, W, H, FPS, recovery=False).collect()}
    assert not any(plain[f].detected for f in GONE if f in plain)
