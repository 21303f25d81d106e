import random

from pyspark.sql import functions as F

from trackspark.operators import stats


def test_sums_in_a_given_order(spark):
    """Bit by bit what adding rows one after the other gives, however they are dealt."""
    rng = random.Random(4)
    rows = [(k, i, float(rng.randrange(1009)), float(rng.randrange(1013)), rng.randrange(10) / 10 + 0.05) for k in range(40) for i in range(30)]
    want = {}
    for k, _, x, y, w in rows:
        s = want.setdefault(k, [0.0, 0.0, 0.0])
        s[0], s[1], s[2] = s[0] + w, s[1] + w * x, s[2] + w * y
    rng.shuffle(rows)
    got = stats.moments(spark.createDataFrame(rows, "k int, i int, x double, y double, w double").repartition(7), ["k"], ["i"])
    assert {r.k: (r.cx, r.cy) for r in got.select("k", "cx", "cy").collect()} == {k: (b / a, c / a) for k, (a, b, c) in want.items()}
    assert got.where(F.col("major") < F.col("minor")).count() == 0
