"""Scenarios with known answers for what the driver's tables cannot show."""

import colorsys
import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackspark.functions import clock, geometry, ids
from trackspark.operators import asof, intervals, jobs, merge, pixels, ring, search, stats, validate
from trackspark.plans import finalize, save
from trackspark.sources import synthetic, tracks


def rows(spark, *cells, names="video_id string, t double, x double, y double, r double, sl double, sa double, conf double, ring string, flags int"):
    return spark.createDataFrame(list(cells), names)


def row(t, x=0.5, conf=0.9, sa=0.0, ring_="#f5f5f5", flags=0):
    return ("v", t, x, 0.5, 0.01, 0.0, sa, conf, ring_, flags)


def test_overlay_modes(spark):
    r = rows(spark, row(10.0, 0.1), row(10.04, 0.2), row(10.30, 0.4), row(11.0, 0.9, 0.2), row(11.04, 0.9, 0.2))
    seg = spark.createDataFrame([("v", 10.0, 20.0)], "video_id string, start double, end double")
    want = {9.0: "outside", 10.0: "interp", 10.02: "interp", 10.07: "none", 10.31: "nearest", 10.325: "none", 11.02: "lowconf", 10.055: "nearest", 20.5: "outside"}
    got = {x.t: x for x in asof.sample_overlay(r, seg, spark.createDataFrame([("v", t) for t in want], "video_id string, t double"), 25.0).collect()}
    assert {t: got[t].mode for t in want} == want
    assert math.isclose(got[10.02].x, 0.15) and got[10.07].x is None


def test_asof_equals_brute_force(spark):
    r = random.Random(1)
    a = sorted({round(r.uniform(0, 100), 2) for _ in range(200)})
    p = [r.uniform(-5, 105) for _ in range(50)] + a[:5]
    rs = spark.createDataFrame([("k", v) for v in a], "k string, t double")
    got = {x.t: (x.lo and x.lo.t, x.hi and x.hi.t) for x in asof.neighbours(rs, spark.createDataFrame([("k", v) for v in p], "k string, t double"), "k", "t").collect()}
    for v in p:
        assert got[v] == (max((x for x in a if x <= v), default=None), min((x for x in a if x > v), default=None))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 15)), min_size=1, max_size=25))
def test_interval_union_properties(spark, pairs):
    s = spark.createDataFrame([("v", float(a), float(a + n)) for a, n in pairs], "video_id string, start double, end double")
    u = intervals.union(s)
    got = sorted((x.start, x.end) for x in u.collect())
    assert all(b0 > a1 for (_, a1), (b0, _) in zip(got, got[1:], strict=False))
    assert sorted((x.start, x.end) for x in intervals.union(u).collect()) == got
    assert {x for a, n in pairs for x in range(a, a + n + 1)} == {x for a, b in got for x in range(int(a), int(b) + 1)}


def test_merge(spark):
    old = rows(spark, row(10.0), row(11.0), row(14.0)).drop("sl", "sa")
    new = rows(spark, row(12.0, 0.7))
    seg = spark.createDataFrame([("v", 11.0, 13.5)], "video_id string, start double, end double")
    got = merge.merge_rows(old, new, seg).orderBy("t").collect()
    assert [x.t for x in got] == [10.0, 12.0, 14.0] and got[0].sl == 0.0
    with pytest.raises(ValueError, match="conf"):
        merge.union_by_name(old.drop("conf"), new, ["conf"])


def test_times(spark):
    said = {"359": 359.0, "359.5": 359.5, "5:59": 359.0, "1:05:59": 3959.0, "0:05:59.25": 359.25, "90:00": 5400.0, "1e3": 1000.0, "": None, " 7 ": 7.0}
    bad = {"-1": "negative", "5:60": "range", "1:60:00": "range", "x": "form", "1:2:3:4": "form"}
    df = spark.createDataFrame([(s,) for s in [*said, *bad]], "s string").select("s", clock.parse_time(F.col("s")).alias("p"), clock.parse_clock(F.col("s")).alias("c"))
    got = {r.s: r for r in df.collect()}
    assert {s: got[s].p.seconds for s in said} == said and {s: got[s].p.error for s in bad} == bad
    assert got["1e3"].c is None and got["5:59"].c == 359.0


def test_urls(spark):
    i = "dQw4w9WgXcQ"
    good = [f"https://www.youtube.com/watch?v={i}", f"youtu.be/{i}?t=3", f"https://m.youtube.com/watch?list=a&v={i}#x", f"http://youtube.com/shorts/{i}", f"https://www.youtube-nocookie.com/embed/{i}/", f" https://music.youtube.com/watch?v={i} "]
    bad = {"": "empty url", "https://notyoutube.com/watch?v=" + i: "not a video URL", "ftp://youtube.com/watch?v=" + i: "not a video URL", "https://youtube.com/watch?v=short": "no video id in the URL", "https://youtube.com/playlist?list=x": "no video id in the URL"}
    df = spark.createDataFrame([(u,) for u in [*good, *bad]], "u string").select("u", ids.normalize_url(F.col("u")).alias("n"), ids.extract_id(F.col("u")).alias("e"))
    got = {r.u: r for r in df.collect()}
    assert all(got[u].n.video_id == i for u in good) and {u: got[u].n.error for u in bad} == bad
    names = spark.createDataFrame([(f"/a/b/{i}_359-372.mp4",), (i,), ("clip.mp4",), (f"https://my-youtube.x/v/{i}",)], "u string").select(ids.extract_id(F.col("u"))).collect()
    assert [r[0] for r in names] == [i, i, None, i]


def test_hysteresis(spark):
    lums = [0.9, 0.9, 0.02, 0.02, 0.9, 0.02, 0.02, 0.02, None, 0.02]
    got = ring.choose(spark.createDataFrame([("v", k, x) for k, x in enumerate(lums)], "video_id string, frame int, lum double"), ["video_id"]).orderBy("frame").collect()
    assert [r.ring for r in got] == ["#101010"] * 7 + ["#f5f5f5"] * 3


def test_search_plan(spark):
    d = spark.createDataFrame([("v", f, 0, float(10 * f), 5.0) for f in (4, 5, 9, 10)], "video_id string, frame int, shot_id int, x double, y double")
    got = {r.frame: r for r in search.planned(d, spark.createDataFrame([], "video_id string, frame int"), spark.createDataFrame([("v", 12)], "video_id string, n_frames int"), 1000.0).collect()}
    assert sorted(got) == [1, 2, 3, 6, 7, 8, 11] and math.isclose(got[7].x, 70.0) and math.isclose(got[11].x, 110.0)
    assert math.isclose(got[7].radius, 12 + 0.8 * 10 * 2) and math.isclose(got[2].radius, 12 + 0.5 * 10 * 2)


def test_jobs(spark):
    names = "job_id string, video_id string, url string, start_s double, end_s double, status string, stage string, progress double, message string, error string, created_at string, updated_at string"
    j = spark.createDataFrame([("a", "v", "u", None, 5.0, "queued", "queued", 0.0, "", None, "1", "1"), ("b", "v", "u", 1.0, 5.0, "ready", "done", 1.0, "", None, "2", "2")], names)
    ask = spark.createDataFrame([("c", "v", "u", None, 5.0), ("d", "v", "u", 1.0, 5.0)], "job_id string, video_id string, url string, start_s double, end_s double")
    j = jobs.submit(j, ask, "3")
    assert sorted(r.job_id for r in j.collect()) == ["a", "b", "d"]
    ev = spark.createDataFrame([("a", "4"), ("b", "4")], "job_id string, e_at string")
    j = jobs.start(j, ev)
    assert {r.job_id: r.status for r in j.collect()} == {"a": "processing", "b": "ready", "d": "queued"}
    p = spark.createDataFrame([("a", "5", "track", 1.7, "m")], "job_id string, e_at string, e_stage string, e_progress double, e_message string")
    assert {r.job_id: r.progress for r in jobs.progress(j, p).collect()}["a"] == 1.0
    assert {r.job_id: r.status for r in jobs.recover(j, "6").collect()} == {"a": "failed", "b": "ready", "d": "queued"}
    assert [r.job_id for r in jobs.queue(j).collect()] == ["d"]


def test_validation(spark):
    ok = ("v", 0, 1.0, 0.5, 0.5, 0.01, 0.9, "#ffffff", 0, 0.0, 0.0)
    bad = [("v", 1, 0.5, *ok[3:]), ("v", 2, 2.0, 1.5, *ok[4:]), ("v", 3, 3.0, 0.5, 0.5, 0.01, float("nan"), "#fff", 9, 0.6, 8.0)]
    df = spark.createDataFrame([ok, *bad], "video_id string, pos int, t double, x double, y double, r double, conf double, ring string, flags int, sl double, sa double")
    got = sorted((r.pos, r.rule) for r in validate.violations(df).collect())
    assert got[0] == (1, "rows must be sorted by t") and (2, "x/y out of 0..1") in got and sum(p == 3 for p, _ in got) == 5
    assert validate.first_violation(df).first().pos == 1


DOC = {"schema_version": 1, "video_id": "v", "video": {"width": 10, "height": 5, "fps": 25}, "segments": [{"start": 0, "end": 5}, {"start": 7, "end": 7}], "fields": ["x", "t", "y", "r", "conf", "ring", "flags", "extra"], "frames": [[0.5, 1.25, 0.5, 0.01, 0.9, "#ABCDEF", 3, "?"], [0.6, 1.0, 0.5, 0.01, 0.9, "red", "2", None]]}


def test_documents(spark):
    docs = spark.createDataFrame([(json.dumps(DOC),)], "doc string")
    got = tracks.rows(docs).orderBy("pos").collect()
    assert (got[0].t, got[0].x, got[0].ring, got[0].flags, got[0].sl) == (1.25, 0.5, "#abcdef", 3, 0.0) and got[1].ring == "#f5f5f5"
    assert tracks.segments(docs).count() == 1 and tracks.header(docs).first().fps == 25.0
    heads = tracks.header(docs).select("video_id", "source_url", "created_at", "width", "height", "fps", "segments")
    back = tracks.documents(tracks.rows(docs), heads).first().doc
    again = json.loads(back)
    assert again["fields"][0] == "t" and [r[0] for r in again["frames"]] == [1.0, 1.25] and again["frames"][1][5] == "#abcdef"


@pytest.mark.parametrize(("change", "error"), [({"schema_version": 2}, "schema_version must be 1"), ({"video_id": 5}, "video_id must be a string"), ({"video": {"fps": "25"}}, "video.fps must be a positive number"), ({"segments": [{"start": 3, "end": 1}]}, "bad segment"), ({"fields": ["t"]}, "fields missing: x, y, r, conf, ring, flags"), ({}, None)])
def test_structural_errors(spark, change, error):
    docs = spark.createDataFrame([(json.dumps(DOC | change),)], "doc string")
    assert validate.document_errors(docs).first().error == error


def test_candidate_cache(spark):
    c = spark.createDataFrame([("p", 3, 0, 1.234, 2.0, 0.5), ("p", 3, 1, 4.0, 5.0, 0.25)], "path string, frame int, cand_idx int, x double, y double, score double")
    got = tracks.candidates(tracks.cache(c)).orderBy("cand_idx").collect()
    assert [(r.frame, r.x, r.score) for r in got] == [(3, 1.23, 0.5), (3, 4.0, 0.25)]


def test_pixels(spark):
    yy, xx = np.mgrid[0:40, 0:60]
    heat = np.exp(-((xx - 20.3) ** 2 + (yy - 11.7) ** 2) / 8) + 0.5 * np.exp(-((xx - 45) ** 2 + (yy - 30) ** 2) / 8)
    df = spark.createDataFrame([("v", 0, 40, 60, heat.ravel().tolist())], "video_id string, frame int, h int, w int, values array<double>")
    got = pixels.detect_peaks(df, ["video_id", "frame"]).collect()
    assert len(got) == 2 and abs(got[0].x - 20.3) < 0.2 and abs(got[0].y - 11.7) < 0.2
    disc = 60.0 * (np.hypot(xx - 30, yy - 20) <= 5)
    m = pixels.measure(spark.createDataFrame([("v", 40, 60, disc.ravel().tolist(), 30.0, 20.0)], "video_id string, h int, w int, values array<double>, cx double, cy double"), ["video_id"], 1920.0).first()
    assert abs(m.r - 5) < 1.2 and abs(m.x - 30.5) < 0.6 and m.sl < 1
    u = np.clip((xx - 30) * np.cos(0.6) + (yy - 20) * np.sin(0.6), -8, 8)
    pill = 60.0 * (np.hypot(xx - 30 - u * np.cos(0.6), yy - 20 - u * np.sin(0.6)) <= 3)
    crop = "video_id string, h int, w int, values array<double>, cx double, cy double"
    rows = [(name, 40, 60, image.ravel().tolist(), 30.5, 20.5) for name, image in (("pill", pill), ("none", np.zeros((40, 60))), ("far", np.roll(disc, 20, 1)), ("border", 60.0 * (np.hypot(xx - 30, yy + 1) <= 5)))]
    got = {r.video_id: r for r in pixels.measure(spark.createDataFrame(rows, crop), ["video_id"], 1920.0).collect()}
    assert set(got) == {"pill"}
    got = got["pill"]
    assert abs(got.angle - 0.6) < 0.1 and abs(got.sl - 8) < 2 and abs(got.r - 3) < 1.2 and got.elong > 2 and 0 < got.weight <= 1
    crop = "video_id string, h int, w int, values array<double>, light array<double>, px double, py double, radius double, expected double, speed double"
    flat = lambda a: a.ravel().tolist()
    pair = disc + 60.0 * (np.hypot(xx - 45, yy - 20) <= 5)
    rows = [("disc", 40, 60, flat(disc), flat(disc), 33.0, 22.0, 12.0, 5.0, 4.0), ("dark", 40, 60, flat(disc), flat(-disc), 33.0, 22.0, 12.0, 5.0, 4.0), ("pair", 40, 60, flat(pair), flat(pair), 33.0, 22.0, 12.0, 5.0, 4.0), ("far", 40, 60, flat(disc), flat(disc), 50.0, 22.0, 12.0, 5.0, 4.0)]
    found = {r.video_id: r for r in pixels.lost_balls(spark.createDataFrame(rows, crop), ["video_id"]).collect()}
    assert set(found) == {"disc"}  # darker, not alone, or too far are none
    assert np.hypot(found["disc"].x - 30.5, found["disc"].y - 20.5) < 1 and 0 < found["disc"].score <= 1


def test_retrack_fills_what_a_search_finds(spark):
    from trackspark.operators import recover

    frames = [f for f in range(40) if not 15 <= f < 25]
    at = lambda f: (200.0 + 12 * f, 500.0 - 3 * f)
    c = spark.createDataFrame([("v", f, 0, *at(f), 0.95) for f in frames], "video_id string, frame int, cand_idx int, x double, y double, score double")
    cuts, n = spark.createDataFrame([], "video_id string, frame int"), spark.createDataFrame([("v", 40)], "video_id string, n_frames int")
    seen = []

    def search_(plan):
        seen.extend(r.frame for r in plan.collect())
        x, y = 200.0 + 12 * F.col("frame"), 500.0 - 3 * F.col("frame")
        return plan.select("video_id", "frame", x.alias("x"), y.alias("y"), F.when(F.col("frame") == 20, 0.1).otherwise(0.8).alias("score"))

    before = {r.frame for r in recover.track(c, cuts, 1920.0, 1080.0, 25.0).where("detected").collect()}
    got = {r.frame: r for r in recover.retrack(c, cuts, n, search_, 1920.0, 1080.0, 25.0).collect()}
    assert set(range(15, 25)) <= set(seen) and not before & set(range(15, 25))
    assert set(got) == set(range(40)) and {f for f in got if got[f].detected} == set(range(40)) - {20}
    assert max(np.hypot(got[f].x - at(f)[0], got[f].y - at(f)[1]) for f in got) < 2


def test_one_long_key_is_linear(spark):
    import time

    n = 100_000
    rows = spark.range(n).select(F.lit("k").alias("video_id"), (F.col("id") * 1.0).alias("t"), F.when(F.col("id") % 3 == 0, F.col("id") * 2.0).alias("x"), F.col("id").cast("int").alias("frame"), (F.col("id") % 7 / 7.0).alias("lum"))
    from trackspark.operators import series

    now = time.time()
    d = asof.neighbours(rows.select("video_id", "t", "x"), rows.select("video_id", (F.col("t") + 0.5).alias("t")), "video_id", "t")
    assert d.where("lo.t = t - 0.5 AND (hi.t = t + 0.5 OR hi IS NULL)").count() == n
    assert series.fill_linear(rows, ["video_id"], "x", "y").where("abs(y - id2) < 1e-6 OR frame > 99998".replace("id2", "frame * 2.0")).count() == n
    assert ring.choose(rows, ["video_id"]).count() == n
    assert time.time() - now < 60


def test_depth_model_and_radii(spark):
    r = np.random.default_rng(0)
    y = np.linspace(300, 900, 120)
    true = 3 + 4 * y / 1080
    meas = true * (1 + 0.15 * r.normal(size=120))
    meas[50] = 30
    data = [("v", 0, k, float(y[k]), None if k % 7 == 0 else float(meas[k]), 0.0 if k % 7 == 0 else 1.0) for k in range(120)]
    got = finalize.radii(spark.createDataFrame(data, "video_id string, shot_id int, frame int, y double, meas_r double, meas_w double"), 1920.0, 1080.0).orderBy("frame").collect()
    out = np.array([g.radius for g in got])
    assert np.median(np.abs(out / true - 1)) < 0.1 and np.abs(np.diff(out)).max() < 0.15


def test_synthetic(spark):
    t = synthetic.circular_track(spark, "v", 0.0, 20.0)
    assert t.count() == 477 or 470 < t.count() < 480
    assert synthetic.in_range(t, 1.0, 2.0).count() == 25
    assert stats.tracklet_score(t.withColumn("score", F.lit(1.0)), ["video_id"]).first().points == t.count()


def test_outline_and_coverage(spark):
    lit = [F.lit(v) for v in (5.0, 6.0, 2.0, 3.0, 0.5)]
    got = spark.range(1).select(geometry.stadium_outline(*lit).alias("o"), geometry.ring_coverage(F.lit(7.0), F.lit(5.0), F.lit(5.5), F.lit(5.5), F.lit(1.0), F.lit(2.0), F.lit(0.0), F.lit(0.0)).alias("c"), geometry.truncated(F.sequence(F.lit(1), F.lit(20)))["more"].alias("m")).first()
    for p in got.o:
        u = max(-3.0, min(3.0, (p.x - 5) * math.cos(0.5) + (p.y - 6) * math.sin(0.5)))
        assert math.isclose(math.hypot(p.x - 5 - u * math.cos(0.5), p.y - 6 - u * math.sin(0.5)), 2.0, rel_tol=1e-9)
    assert 0 < got.c < 1 and got.m == 8


def test_stages_are_all_looked_up(spark):
    n = 1500
    weights = spark.range(n).selectExpr("id AS pos", "concat('s', id) AS stage", "1.0D AS weight")
    fractions = spark.range(n).selectExpr(f"(id + 0.5D) / {n} AS fraction")
    got = intervals.stages(weights, fractions).orderBy("fraction").collect()
    assert [r.stage for r in got] == [f"s{k}" for k in range(n)]


def _balls(frames, width, height):
    """moving_balls() of one shot, pixel by pixel."""
    out = []
    for k, image in enumerate(frames):
        pick = lambda *ks: next((frames[j] for j in ks if 0 <= j < len(frames)), image)  # noqa: E731, B023
        before, after = pick(k - 1, k + 2, k + 1), pick(k + 1, k - 2, k - 1)
        h, w, _ = image.shape
        own, moved = set(), {}
        for y in range(h):
            for x in range(w):
                p, a, b = ([int(c) for c in i[y, x]] for i in (image, before, after))
                moved[y, x] = min(max(abs(c - d) for c, d in zip(p, o, strict=True)) for o in (a, b))
                hue, sat, val = colorsys.rgb_to_hsv(*(c / 255 for c in p))
                yellow = 18 <= round(hue * 180) <= 45 and round(sat * 255) >= 70 and round(val * 255) >= 110
                if moved[y, x] > 18 and (yellow or (round(sat * 255) <= 60 and round(val * 255) >= 170)):
                    own.add((y, x))
        around = lambda y, x: [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if 0 <= y + i < h and 0 <= x + j < w]  # noqa: E731, B023
        grown = {q for p in own for q in around(*p)}
        shrunk = {p for p in grown if all(q in grown for q in around(*p))}
        found = []
        while shrunk:
            blob, todo = set(), [min(shrunk)]
            while todo:
                p = todo.pop()
                if p in shrunk:
                    shrunk.discard(p)
                    blob.add(p)
                    todo += around(*p)
            ys, xs = [p[0] for p in blob], [p[1] for p in blob]
            big, small = sorted((max(ys) - min(ys) + 1, max(xs) - min(xs) + 1), reverse=True)
            full = len(blob) / (big * small)
            if len(blob) >= max(2, 0.5 * (0.0025 * w) ** 2) and small <= 0.03 * w and big <= 0.12 * w and big / small <= 4.5 and full >= 0.3:
                score = min(1.0, 0.35 + 0.5 * min(1.0, sum(moved[p] for p in blob) / len(blob) / 80) + 0.15 * full)
                found.append((-score, min(blob), (sum(xs) / len(xs) + 0.5) * width / w, (sum(ys) / len(ys) + 0.5) * height / h))
        out += [(k, n, round(x, 6), round(y, 6), round(-s, 6)) for n, (s, _, x, y) in enumerate(sorted(found)[:4])]
    return out


def test_moving_balls_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    shots = []
    for _ in range(2):
        ground = rng.integers(60, 90, (72, 128, 3))
        ground[5:8, 5:8] = (240, 220, 40)  # a yellow mark that stands still
        images = []
        for k in range(5):
            image = ground + rng.integers(0, 6, ground.shape)
            image[30 + k : 33 + k, 20 + 9 * k : 23 + 9 * k] = (230, 210, 60)
            image[50:52, 100 - 7 * k : 103 - 7 * k] = (245, 245, 240)
            image[10:60, 60 + 6 * k : 66 + 6 * k] = (200, 30, 30)  # moves, but is red
            for y, x in rng.integers(0, 60, (25, 2)):
                image[y, x : x + 2] = (250, 250, 250)
            images.append(image.astype(np.uint8))
        shots.append(images)
    cells = [("v", s, k, 72, 128, bytearray(i.tobytes())) for s, images in enumerate(shots) for k, i in enumerate(images)]
    schema = "video_id string, shot_id int, frame int, h int, w int, rgb binary"
    df = spark.createDataFrame([*cells, ("null", 0, 0, 72, 128, None), ("short", 0, 0, 72, 128, bytearray(5)), ("alone", 0, 0, 72, 128, cells[0][5])], schema)
    got = [(r.video_id, r.shot_id, r.frame, r.cand_idx, round(r.x, 6), round(r.y, 6), round(r.score, 6)) for r in pixels.moving_balls(df, ["video_id", "shot_id"], 1280.0, 720.0).collect()]
    want = [("v", s, *c) for s, images in enumerate(shots) for c in _balls(images, 1280.0, 720.0)]
    assert len(want) > 15 and sorted(got) == sorted(want)
    some = pixels.moving_balls(df, ["video_id", "shot_id"], 1280.0, 720.0, roi=(0.0, 0.6, 1.0, 1.0)).collect()
    assert some and all(r.y >= 0.6 * 720 - 10 for r in some)
    assert pixels.moving_balls(df.limit(0), ["video_id", "shot_id"], 1280.0, 720.0).isEmpty()


def test_long_shots_are_dealt_in_parts(spark):
    n = 3 * pixels.PART
    df = spark.range(n).select(F.lit("v").alias("video_id"), F.col("id").cast("int").alias("frame"), F.col("id").alias("v"))
    got = {r.frame: (r.before, r.after) for r in pixels.frame_triples(df, ["video_id"], 2, "v").collect()}
    assert len(got) == n and all(got[k] == (k - 2, k + 2) for k in range(2, n - 2))
    assert got[0] == (2, 2) and got[1] == (0, 3) and got[n - 1] == (n - 3, n - 3)


def test_save_tracks(spark, tmp_path):
    path, pos = str(tmp_path / "store"), F.col("t").cast("int") - 10
    names = "video_id string, start double, end double"
    none = spark.createDataFrame([], "video_id string, url string, status string, segments array<struct<start double, end double>>, track_path string, created_at string, updated_at string")
    head = lambda at: spark.createDataFrame([("v", "u", at)], "video_id string, url string, at string")
    seg = lambda a, b: spark.createDataFrame([("v", a, b)], names)
    times = lambda: [r.t for r in spark.read.parquet(path).where("video_id = 'v'").orderBy("t").collect()]
    made = save.save_tracks(rows(spark, row(10.0), row(11.0), row(14.0)).withColumn("pos", pos), seg(10.0, 14.0), none, head("1"), path)
    videos = spark.createDataFrame(made.collect(), none.schema)
    assert times() == [10.0, 11.0, 14.0] and [(r.status, r.created_at) for r in videos.collect()] == [("ready", "1")]
    made = save.save_tracks(rows(spark, row(12.0, 0.7)).withColumn("pos", pos), seg(11.0, 15.5), videos, head("2"), path)
    videos = spark.createDataFrame(made.collect(), none.schema)
    one = videos.first()
    assert times() == [10.0, 12.0] and [tuple(s) for s in one.segments] == [(10.0, 15.5)] and (one.created_at, one.updated_at) == ("1", "2")
    for bad, span, said in ((rows(spark, row(13.0, 7.0)), seg(13.0, 14.0), "x/y out of"), (rows(spark, row(13.0)), seg(14.0, 13.0), "bad segment"), (rows(spark, row(13.0)).limit(0), seg(0.0, 99.0), "no rows")):
        with pytest.raises(save.InvalidTrackError, match=said):
            save.save_tracks(bad.withColumn("pos", pos), span, videos, head("3"), path)
    assert times() == [10.0, 12.0]
    save.save_tracks(rows(spark, row(20.0)).withColumn("pos", pos), seg(20.0, 21.0), videos, head("4"), path, replace=True)
    assert times() == [20.0]


def test_missing_keys_are_one_series(spark):
    from trackspark.operators.folds import fold_sorted

    df = spark.createDataFrame([(None, k, float("nan")) for k in range(5)] + [("a", k, 1.0) for k in range(3)], "k string, at int, f double")
    got = fold_sorted(df, ["k", "f"], ["at"], lambda: 0, lambda n, row: (n + 1, (row[0], n)), ["at"], "at int, n int").collect()
    assert sorted((r.k or "", r.at, r.n) for r in got) == [("", k, k) for k in range(5)] + [("a", k, k) for k in range(3)]


def test_kink_to_rest_is_a_reversal_as_in_sql(spark):
    # the scalar product is -0.0, whose angle is half a turn by IEEE rules (and in SQL); from +0.0 it is none
    v = spark.createDataFrame([(1, -22.0, -12.0, 0.0, 0.0), (2, 22.0, 12.0, 0.0, 0.0), (3, -22.0, 12.0, 0.0, 0.0)], "k int, a double, b double, c double, d double")
    got = {r.k: r.kind for r in v.select("k", geometry.kink_class(F.col("a"), F.col("b"), F.col("c"), F.col("d"), 25.0, 1080.0).alias("kind")).collect()}
    assert got == {1: 4, 2: 0, 3: 0}
