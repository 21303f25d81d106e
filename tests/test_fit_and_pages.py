import math
import random

from trackspark.operators import fit, lifecycle


def test_fit_equals_brute_force(spark):
    from pyspark.sql import functions as F

    r = random.Random(1)
    rings = [("v", k, r.uniform(-5, 5), r.uniform(-5, 5), r.choice([0.0, r.uniform(0, 9)]), r.uniform(-4, 4), r.uniform(3, 9), 1.0) for k in range(40)]
    points = [("v", k, r.uniform(-9, 9), r.uniform(-9, 9)) for k in range(38) for _ in range(r.randrange(1, 12))]
    got = fit.fit_check(spark.createDataFrame(rings, "video_id string, frame int, cx double, cy double, half double, angle double, radius double, line double"), spark.createDataFrame(points, "video_id string, frame int, x double, y double"), F.lit(1.5))
    by = {x.frame: x for x in got.collect()}
    assert set(by) == set(range(38))
    for _, k, cx, cy, half, angle, radius, line in rings[:38]:
        far = tip = 0.0
        own = [p for p in points if p[1] == k]
        for _, _, x, y in own:
            dx, dy = x - cx, y - cy
            a = dx * math.cos(angle) + dy * math.sin(angle)
            t = max(-half, min(half, a))
            far, tip = max(far, math.hypot(dx - t * math.cos(angle), dy - t * math.sin(angle)) + 1.5), max(tip, abs(a) + 1.5)
        inner = radius - line / 2
        assert all(abs(p - q) < 1e-9 for p, q in zip((by[k].overshoot, by[k].side_gap, by[k].tip_gap), (far - inner, inner - far, half + inner - tip), strict=True)) and by[k].n == len(own)
    assert fit.worst(got).first().n == 38


SCHEMA = "page string, seq int, kind string, asked int, video_id string, outcome string, status string, has_track boolean, has_job boolean"


def states(spark, *events):
    df = spark.createDataFrame([("p", k, *e, *(None,) * (7 - len(e))) for k, e in enumerate(events)], SCHEMA)
    return [(r.seq, r.gen, r.video_id, r.status, r.track) for r in lifecycle.page_states(df).orderBy("seq").collect()]


def test_answers_to_an_older_navigation_are_dropped(spark):
    got = states(spark, ("navigate", None, "a"), ("navigate", None, "b"), ("video", 1, None, "ok", "ready", True, False), ("track", 1, None, "ok"), ("video", 2, None, "missing"), ("track", 1, None, "ok"), ("navigate", None, None))
    assert got == [(0, 1, "a", "loading", False), (1, 2, "b", "loading", False), (4, 2, "b", "none", False), (6, 3, None, "idle", False)]


def test_what_a_record_and_its_track_lead_to(spark):
    ready = states(spark, ("navigate", None, "a"), ("video", 1, None, "ok", "ready", True, False), ("track", 1, None, "ok"))
    assert [x[3] for x in ready] == ["loading", "loading", "ready"]
    again = states(spark, ("navigate", None, "a"), ("video", 1, None, "ok", "processing", True, True), ("track", 1, None, "ok"), ("job", 1, None, "ok", "processing"), ("job", 1, None, "ok", "done"), ("track", 1, None, "ok"))
    assert [x[3] for x in again] == ["loading", "loading", "job", "job", "job", "ready"]
    bad = states(spark, ("navigate", None, "a"), ("video", 1, None, "ok", "ready", True, False), ("track", 1, None, "invalid"), ("video", 1, None, "refused"), ("video", 1, None, "unreachable"), ("video", 1, None, "ok", "failed", False, True))
    assert [x[3] for x in bad] == ["loading", "loading", "none", "error", "error", "failed"]
    fresh = states(spark, ("navigate", None, "a"), ("video", 1, None, "ok", "queued", False, True), ("job", 1, None, "ok", "ready"), ("track", 1, None, "refused"))
    assert [x[3] for x in fresh] == ["loading", "job", "job", "error"]


def test_a_job_that_cannot_be_asked_fails_in_the_end(spark):
    ask = ("job", 1, None, "refused")
    got = states(spark, ("navigate", None, "a"), ("video", 1, None, "ok", "queued", False, True), *[ask] * 7, ("job", 1, None, "ok", "processing"), *[ask] * 8)
    assert [x[3] for x in got[1:]] == ["job"] * 16 + ["failed"]


def test_designed_track_hugs_its_outline(spark):
    """Rings of the designed rows, drawn at the frames' times, lie on the ball's true footprint."""
    from pyspark.sql import functions as F

    from trackspark.sources import synthetic as S

    rows = S.designed_track(spark).cache()
    at = {round((r.t - 100) * 50): r for r in rows.collect()}
    assert not set(range(300, 325)) & set(at) and 350 in at and not {341, 345, 349, 351, 359} & set(at) and {340 - 1, 361} <= set(at)
    assert 151 not in at and 152 in at and 153 not in at
    assert at[410].conf == 0.3 and at[430].conf == 0.92 and at[490].sl == 0 and at[150].flags & 4 and any(r.flags & 2 for r in at.values())
    assert {at[k].ring for k in at if 0.45 < at[k].x < 0.55} == {"#101010"}
    w, h = 640.0, 360.0
    frame = F.bround((F.col("t") - 100) * 25, 0).cast("int")
    rings = rows.where(F.bround((F.col("t") - 100) * 50, 0) % 2 == 0).select("video_id", frame.alias("frame"), (F.col("x") * w).alias("cx"), (F.col("y") * h).alias("cy"), (F.col("sl") * w).alias("half"), F.col("sa").alias("angle"), (F.col("r") * w + 0.75).alias("radius"), F.lit(1.5).alias("line"), "flags")
    got = fit.fit_check(rings, S.designed_outline(spark), F.lit(5.0)).join(rings.select("video_id", "frame", "flags"), ["video_id", "frame"]).collect()
    assert len(got) > 250
    smooth = [r for r in got if r.flags & 2 == 0]
    assert max(r.overshoot for r in smooth) < 1.5 and max(abs(r.tip_gap) for r in smooth) < 1.5
    rows.unpersist()
