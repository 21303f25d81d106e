import random

from trackspark.operators import asof


def test_stretches_of_a_long_key_answer_as_one(spark, monkeypatch):
    r = random.Random(5)
    rows = [(k, r.uniform(0, 1000), i) for k, n in (("a", 700), ("b", 5), (None, 400)) for i in range(n)]
    probes = [(k, t) for k in ("a", "b", "c", None) for t in [r.uniform(-300, 1300) for _ in range(300)]] + [("a", rows[3][1]), ("a", None)]
    # stretches without rows: many probes after the last one
    probes += [("a", 2000.0 + k) for k in range(900)]
    df, ask = spark.createDataFrame(rows, "k string, t double, i int"), spark.createDataFrame(probes, "k string, t double")
    got = lambda: sorted(map(repr, asof.neighbours(df, ask, "k", "t").collect()))
    whole = got()
    monkeypatch.setattr(asof, "LONG", 310)
    monkeypatch.setattr(asof, "PARTS", 40)
    cuts = asof.time_cuts(df, ask, "k", "t")
    assert {x["_k"] for x in cuts.collect()} == {"a", None} and got() == whole
    parts = df.join(cuts, df.k.eqNullSafe(cuts["_k"])).select("k", asof._stretch(cuts["_cuts"], df.t).alias("p")).groupBy("k", "p").count()
    assert parts.agg({"count": "max"}).first()[0] < 200  # no window holds a long key whole
