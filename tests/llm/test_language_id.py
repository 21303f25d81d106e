import itertools
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackspark.llm.language_id import STEPS, UNIT, Mixture, grams, identify, train

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("score", T.StringType()))])
WORDS = {"aa": "abana cabada badana abaca", "oo": "molo polomo lomopo oplomo", "ii": "tirki kritti rikit tirit"}


def doc(r, *langs, n=40):
    return " ".join(r.choice(WORDS[g].split()) for g in langs for _ in range(n))


def rows():
    r = np.random.default_rng(0)
    out = [(k, doc(r, g), g, None) for k in range(120) for g in [sorted(WORDS)[k % 3]]]
    return out + [(500, doc(r, "oo", "aa", n=100), None, None), (None, doc(r, "ii"), None, None), (501, None, "aa", None), (502, "", "aa", None), (503, "12 -- $$ 3.4", "aa", None), (504, "語語", None, None), (505, doc(r, "aa", n=20_000), None, None), (7, doc(r, "aa"), "aa", "x"), (7, doc(r, "aa"), "aa", "x")]


def test_answers(spark):
    got = identify(spark.createDataFrame(rows(), SCHEMA)).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == g for k, _, g, _ in rows()[:120] if k != 7)
    assert all(r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert by[500].langs in ("aa,oo", "oo,aa") and abs(by[500].score - 0.5) < 0.1
    assert by[None].lang_pred == "ii" and by[505].langs == "aa"
    assert [by[k].lang_pred for k in (501, 502, 503)] == ["und"] * 3 and by[504].lang_pred in WORDS


def test_no_training_rows_and_empty(spark):
    assert identify(spark.createDataFrame([], SCHEMA)).collect() == []
    got = identify(spark.createDataFrame([(1, "some text", None, None)], SCHEMA)).collect()
    assert (got[0].lang_pred, got[0].score) == ("und", 0.0)


def test_sets_equal_brute_force(spark):
    """Every subset by plain expectation-maximisation; the highest penalised likelihood wins."""
    m = train(spark.createDataFrame(rows(), SCHEMA), F.col("lang"))
    r = np.random.default_rng(1)
    texts = [doc(r, *g, n=n) for g in ("aa", "oo", "ii") for g in [[g]] for n in (1, 7, 30)] + [doc(r, "aa", "ii", n=30), doc(r, "aa", "oo", "ii", n=24), doc(r, "oo", "oo", "ii", n=9)]
    raw = [t.encode() for t in texts]
    ll, at = m.units(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    shares = m.infer(ll, at)
    for k, t in enumerate(texts):
        own = ll[at[k] : at[k + 1]]
        assert len(own) == -(-len(t.split()) // UNIT)
        best = (-np.inf, None)
        for n in (1, 2, 3):
            for s in itertools.combinations(range(3), n):
                p, pi = np.exp(own[:, s] - own.max(axis=1, keepdims=True)), np.full(n, 1 / n)
                for _ in range(STEPS):
                    q = p * pi
                    pi = (q / q.sum(axis=1, keepdims=True)).mean(axis=0)
                total = np.log((p * pi).sum(axis=1)).sum() + own.max(axis=1).sum() - 0.5 * (n - 1) * np.log(max(2, len(own)))
                best = max(best, (total, s))
        assert set(np.flatnonzero(shares[k])) == set(best[1]), t[:50]


def test_trigrams_stay_in_words():
    raw = [b"Ab, c", b"", b"x"]
    code, of = grams(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    assert np.bincount(of, minlength=3).tolist() == [3, 0, 1] and len(code) == 4


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="driver tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    ids = identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert ids.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98
