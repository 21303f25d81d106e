import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import types as T

from trackspark.llm import code_compression as C

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("code", T.StringType()), T.StructField("q", T.LongType())])


def table(n, dims, seed=0):
    r = np.random.default_rng(seed)
    near = r.normal(0, 0.3, (12, dims))
    out = [(int(k) * 7 % 100_003, [float(np.float32(x)) for x in near[k % 12] + r.normal(0, 0.05, dims)], None if k % 5 == 0 else int(k % 3), "c", 1) for k in r.permutation(n)]
    bad = [(1, None), (2, [None] * dims), (3, [math.nan] + [0.0] * (dims - 1)), (4, [0.0] * (dims - 1) + [-math.inf]), (5, [0.0] * dims), (5, [0.0] * dims), (5, [0.25] * dims), (None, [0.5] * dims), (6, []), (7, [1.0])]
    return out + [(i, v, None, None, None) for i, v in bad]


def brute(data, dims):
    kept = [(i, v, lab) for i, v, lab, *_ in data if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    q = [[math.floor(1024 * x) for x in v] for _, v, _ in kept]
    w = dims // 4
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, q[k]))
    books = [[q[k][p * w : p * w + w] for k in order[:256]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(5):
        to = [[min(range(len(books[p])), key=lambda e: (far(v[p * w : p * w + w], books[p][e]), e)) for p in range(4)] for v in q]
        if step == 4:
            break
        for p in range(4):
            for e in range(len(books[p])):
                mine = [v[p * w : p * w + w] for v, t in zip(q, to, strict=True) if t[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    error = [sum(far(v[p * w : p * w + w], books[p][t[p]]) for p in range(4)) for v, t in zip(q, to, strict=True)]
    total = {}
    for (_, _, lab), e in zip(kept, error, strict=True):
        total[lab] = total.get(lab, 0) + e
    sha = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{x:02x}" for x in t), e, total[lab], sha) for (i, _, lab), t, e in zip(kept, to, error, strict=True)), key=repr)


@pytest.mark.parametrize(("n", "dims"), [(40, 4), (400, 8)])
def test_equals_brute_force(spark, monkeypatch, n, dims):
    monkeypatch.setattr(C, "BLOCK_BYTES", 512)
    data = table(n, dims)
    got = C.compressed_codes(spark.createDataFrame(data, SCHEMA).repartition(6))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(data, dims)


def test_nearest_takes_the_first_of_equals_and_is_exact_for_large_components():
    entry, error = C.nearest(np.array([[0, 2, C.MOST - 1]]), np.array([[-1], [1], [3], [1 - C.MOST]]))
    assert entry.tolist() == [0, 1, 2] and error.tolist() == [1, 1, (C.MOST - 4) ** 2]


def test_restored_vectors_are_the_codebooks_entries(spark):
    data = table(30, 8, 1)
    coded, books = C.compress(spark.createDataFrame(data, SCHEMA))
    back = {r.vec_id: r.embedding for r in C.restored(coded, books).collect()}
    for r in coded.collect():
        want = [x / 1024 for p in range(4) for x in books[p][int(r.code[2 * p : 2 * p + 2], 16)]]
        assert r.vec_id == 5 or back[r.vec_id] == pytest.approx(want)


def test_empty_tables_and_odd_lengths(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert C.compressed_codes(empty).collect() == []
    assert C.compressed_codes(spark.createDataFrame([(1, [1.0, 2.0], 1, None, None), (2, None, 1, None, None)], SCHEMA)).collect() == []
    assert [tuple(x)[:4] for x in C.compressed_codes(spark.createDataFrame([(1, [], 1, None, None)], SCHEMA)).collect()] == [(1, "00000000", 0, 0)]
    with pytest.raises(ValueError, match="no code"):
        C.compressed_codes(spark.createDataFrame([(1, [1e30, 0.0, 0.0, 0.0], 1, None, None)], SCHEMA))
