import os

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackspark.llm import importance_resample as R

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("quality", T.StringType()), T.StructField("keep", T.StringType())])
LABELS = "doc_id bigint, quality int, toxic int"


def data(n=300):
    r = np.random.default_rng(2)
    words = lambda k: " ".join("".join(r.choice(list("abcdefgh"), r.integers(2, 7))) for _ in range(k))
    bad = lambda k: [words(30).upper().replace(" ", "!! "), " ".join([words(1)] * 40), words(30).replace(" ", " | ")][k % 3]
    rows = [(k, bad(k) if k % 5 == 0 else words(int(r.integers(5, 60))), "clash", None) for k in range(n)]
    rows += [(None, words(30), None, None), (9001, None, None, None), (9002, "", None, None), (9003, words(20_000), None, None), (9004, words(25), None, None), (9004, words(25), None, None)]
    return rows, [(k, int(k % 5 != 0), 0) for k in range(0, n, 2)] + [(4, 1, None), (6, None, 0), (None, 1, 0)]


def test_separates_and_keeps_columns(spark):
    rows, labels = data()
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    got = R.importance_scores(docs, lab).collect()
    assert len(got) == len(rows)
    judged = [r.keep == (r.doc_id % 5 != 0) for r in got if r.doc_id is not None and r.doc_id < 9000]
    assert sum(judged) >= 0.95 * len(judged)
    kept = R.resample(docs, lab)
    assert kept.columns == docs.columns and kept.count() == sum(r.keep for r in got)


def test_score_equals_brute_force():
    ratio = np.random.default_rng(0).normal(size=R.BUCKETS)
    texts = ["a a b", "", "xy", "the cat the cat", "zz  zz\nzz é"]
    raw = [t.encode() for t in texts]
    offs = np.r_[0, np.cumsum([len(x) for x in raw])]
    bucket, doc = R.grams(np.frombuffer(b"".join(raw), np.uint8), offs)
    got = R.Model(ratio).score(np.frombuffer(b"".join(raw), np.uint8), offs)
    for k, x in enumerate(raw):
        own = bucket[doc == k]
        tri, pairs = own[own < R.BYTE_BUCKETS], own[own >= R.BYTE_BUCKETS]
        w = x.split()
        assert len(tri) == max(0, len(x) - 2) and len(pairs) == max(0, len(w) - 1)
        assert (pairs == R.EQUAL_PAIR).tolist() == [a == b for a, b in zip(w, w[1:], strict=False)]
        one, at = R.grams(np.frombuffer(x, np.uint8), np.array([0, len(x)]))
        assert sorted(one.tolist()) == sorted(own.tolist())
        assert np.isclose(got[k], ratio[tri].sum() / (len(tri) + R.SHRINK) + ratio[pairs].sum() / (len(pairs) + R.SHRINK), atol=1e-8)


@pytest.mark.parametrize("k", [1, 10, 499, 1000])
def test_kth_largest(spark, k):
    x = np.random.default_rng(k).normal(size=1000)
    least = R.kth_largest(spark.createDataFrame([(float(v),) for v in x], "v double"), "v", k)
    assert (x >= least).sum() == k


def test_edges(spark):
    labels = spark.createDataFrame([], LABELS)
    assert R.importance_scores(spark.createDataFrame([], DOCS), labels).collect() == []
    assert [r.keep for r in R.importance_scores(spark.createDataFrame([(1, "a b", None, None)], DOCS), labels).collect()] == [True]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver tables")
def test_accuracy_on_rows_outside_the_sample(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    seen = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0)
    got = R.importance_scores(docs, seen).join(labels.join(seen, "doc_id", "left_anti"), "doc_id")
    assert got.agg(F.avg((F.col("keep") == (F.col("quality") == 1)).cast("double"))).first()[0] > 0.97


def test_rows_that_repeat_an_identifier_with_other_texts_agree_in_any_order(spark):
    docs = [(k % 12, f"word{k % 5} " * (k % 7 + 1) + f"other{k} text", k) for k in range(80)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int")
    first = None
    for parts in (1, 3, 7):
        df = spark.createDataFrame(docs[::-1] if parts == 3 else docs, "doc_id long, text string, extra int").repartition(parts)
        got = sorted(map(str, R.importance_scores(df, labels).collect()))
        first = first or got
        assert got == first


def test_texts_of_another_type_count_as_text(spark):
    df = spark.createDataFrame([(k, k * 1001) for k in range(20)], "doc_id long, text long")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = R.resample(df, labels)
    assert got.schema == df.schema and {tuple(r) for r in got.collect()} <= {tuple(r) for r in df.collect()}
