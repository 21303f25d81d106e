import random

import pytest

from trackspark.operators.gapfill import track
from trackspark.streaming import tracker

W, H, FPS = 1920.0, 1080.0, 25.0
SCHEMA = "video_id string, shot_id int, frame int, cand_idx int, x double, y double, score double, ts timestamp"


def rows():
    """Three videos of flights with gaps, long pauses, weak and stray candidates, and a cut."""
    r, out = random.Random(4), []
    for v in ("a", "b", "c"):
        frame = r.randrange(20)
        for _ in range(9):
            x, y, vx, vy = r.uniform(200, 900), r.uniform(300, 800), r.uniform(-15, 15), r.uniform(-12, 12)
            for k in range(r.randrange(3, 40)):
                frame += 1
                here = (x + vx * k, y + vy * k + 0.3 * k * k)
                if r.random() < 0.85:
                    out.append((v, frame, 0, *here, r.uniform(0.5, 1)))
                else:
                    out.append((v, frame, 0, here[0] + 4, here[1], 0.1))
                if r.random() < 0.2:
                    out.append((v, frame, 1, r.uniform(0, W), r.uniform(0, H), r.uniform(0.1, 0.6)))
            frame += r.choice([1, 2, 5, 9, 11, 30])
    return out


@pytest.fixture(scope="module")
def tables(spark):
    c = spark.createDataFrame(rows(), "video_id string, frame int, cand_idx int, x double, y double, score double")
    cuts = spark.createDataFrame([("a", 100), ("b", 60)], "video_id string, frame int")
    cut = {"a": 100, "b": 60}
    stream = [(v, int(v in cut and f >= cut[v]), f, k, x, y, s, 1_700_000_000 + f / FPS) for v, f, k, x, y, s in rows()]
    return c, cuts, stream


def key(r):
    return (r.video_id, r.frame, r.shot_id, round(r.x, 6), round(r.y, 6), round(r.conf, 9), r.flags, r.detected)


def feed(spark, stream, folder, parts, late):
    """Files of rows in order of time, but with each row up to `late` seconds after its turn, and shuffled within a file."""
    r = random.Random(5)
    turn = sorted(stream, key=lambda x: x[-1] + r.uniform(0, late))
    for k in range(parts):
        own = turn[k * len(turn) // parts : (k + 1) * len(turn) // parts]
        r.shuffle(own)
        df = spark.createDataFrame(own, SCHEMA.replace("ts timestamp", "ts double")).selectExpr("* EXCEPT (ts)", "timestamp_millis(cast(round(ts * 1000) as bigint)) AS ts")
        df.coalesce(1).write.mode("append").parquet(folder)
        yield k


def closing(spark, folder):
    """A row of another video far ahead, so that the watermark passes all spans."""
    spark.createDataFrame([("z", 0, 10**6, 0, 1.0, 1.0, 0.9, 0.0)], SCHEMA.replace("ts timestamp", "ts double")).selectExpr("* EXCEPT (ts)", "timestamp_seconds(1800000000L) AS ts").coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, out, checkpoint):
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    q = tracker.start(source, "ts", out, checkpoint, W, H, FPS, late="2 seconds", once=True)
    q.awaitTermination(600)
    assert q.exception() is None


def test_stream_equals_batch_on_shuffled_and_late_rows_and_over_restarts(spark, tables, tmp_path):
    c, cuts, stream = tables
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for k in feed(spark, stream, folder, 3, 1.5):
        run(spark, folder, out, checkpoint)  # stops and starts again from its checkpoint, chains open
        if k == 1:
            half = spark.read.parquet(out).count()
    closing(spark, folder)
    run(spark, folder, out, checkpoint)
    got = spark.read.parquet(out)
    want = track(c, cuts, W, H, FPS).collect()
    assert sorted(map(key, got.collect())) == sorted(map(key, want))
    assert 0 < half < len(want)  # told while the stream went on
