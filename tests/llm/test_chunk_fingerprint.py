import hashlib

import numpy as np
from pyspark.sql import types as T

from trackspark.llm import chunk_fingerprint as C

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("part", T.StringType()), T.StructField("follows", T.StringType())])


def text(seed, n):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("abcdeéßñ"), r.integers(1, 9))) for _ in range(n))


ROWS = [(k * 3, text(k, k * 7 % 90 + 1), "c", None) for k in range(60)]
ROWS += [(None, "null id", None, None), (5, None, None, None), (8, "", None, None), (9, text(5, 300), None, None), (9, text(6, 3), None, None), (7, text(3, 20000), None, None), (1177, ROWS[40][1], None, None), (1178, ROWS[40][1], None, None)]


def slow_chunks(raw):
    out, s = set(), 0
    while s < len(raw):
        h, n = 0, 0
        for b in raw[s : s + C.MOST]:
            h, n = (h << 1) + int(C.GEAR[b]) & 0xFFFF, n + 1
            if n >= C.LEAST and h < 1 << 16 - (C.HARD_BITS if n < C.NORMAL else C.EASY_BITS):
                break
        out.add(raw[s : s + n])
        s += n
    return out


def slow_likeness(a, b):
    weigh = lambda s: sum(map(len, s))
    least = min(weigh(a), weigh(b))
    return weigh(a & b) / least if least else float(a == b)


def test_equals_brute_force(spark):
    got = C.edited_fingerprints(spark.createDataFrame(ROWS, SCHEMA), ranges=5).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for k, (doc_id, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        m = len(t) // 3
        e = t[: len(t) - m] + nxt[:m]
        a, b = slow_chunks(t.encode()), slow_chunks(e.encode())
        want.append((doc_id, len(t), hashlib.sha256(e.encode()).hexdigest(), len(a), round(slow_likeness(a, b), 9), round(slow_likeness(a, slow_chunks(nxt.encode())), 9)))
    have = [(r.doc_id, r.n_chars, r.edited_sha256, len(r.fingerprint) // 12, round(r.near_edited, 9), round(r.near_next, 9)) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    prints = {}
    for r in got:
        prints.setdefault(r.doc_id, r.fingerprint)
    assert prints[1177] == prints[1178] == prints[120]


def test_shift_resistance_and_codec():
    t = text(1, 4000)
    a, b = C._sets([t, "moved by some words " + t])
    assert C.containment(a, b) > 0.99 and (C.decode(C.encode(a)) == a).all()
    assert C.containment(a, C._sets([text(2, 4000)])[0]) < 0.05


def test_fingerprint_small(spark):
    assert C.edited_fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
    one = C.edited_fingerprints(spark.createDataFrame([(1, "abcdef", None, None)], SCHEMA)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one[0].near_next == 1.0
    rows = C.fingerprint(spark.createDataFrame([(1, None, None, None), (None, "x", None, None)], SCHEMA)).collect()
    assert {r.doc_id: len(r.fingerprint) for r in rows} == {1: 0, None: 12}
