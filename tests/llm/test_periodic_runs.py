import hashlib
import random
import zlib

import pytest
from pyspark.sql import types as T

from trackspark.llm import periodic_runs as P

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("runs", T.StringType()), T.StructField("collapsed", T.LongType())])


def brute(s, least=P.LEAST, times=P.TIMES):
    out = {}
    for p in range(1, len(s) // times + 1):
        i = 0
        while i + p < len(s):
            b = i
            while i + p < len(s) and s[i] == s[i + p]:
                i += 1
            if i + p - b >= max(least, times * p):
                out.setdefault((b, i + p), p)
            i += 1
    return sorted((b, e - b, p) for (b, e), p in out.items())


def noisy(r):
    k = r.choice([1, 2, 2, 3, 5])
    s = [r.randrange(k) for _ in range(r.randrange(90))]
    for _ in range(r.randrange(4)):
        if s:
            a = r.randrange(len(s))
            at = r.randrange(len(s) + 1)
            s[at:at] = s[a : a + r.randrange(1, 12)] * r.randrange(1, 7)
    return s + s[:: r.choice([1, -1])] if r.random() < 0.3 else s


def test_runs_of_sequences_equal_brute_force():
    r = random.Random(5)
    for _ in range(4000):
        s, (least, times) = noisy(r), r.choice([(2, 2), (4, 2), (3, 3), (6, 3), (10, 3), (24, 3)])
        assert P.sequence_runs(s, least, times) == brute(s, least, times), (s, least, times)


@pytest.mark.parametrize("s", [[], [0], [0] * 23, [0] * 24, [0] * 5000, [0, 1] * 12, [*range(9)] * 3, [0, 1, 0, 0, 1] * 40 + [0, 1] * 30])
def test_plain_sequences(s):
    assert P.sequence_runs(s) == brute(s)


def test_factors_are_the_longest_that_start_earlier():
    r = random.Random(6)
    for _ in range(300):
        s = noisy(r)
        at = 0
        for start, n, source in P.factors(s):
            assert start == at
            at += n
            starts = [b for b in range(start) if s[b : b + n] == s[start:at]]
            if source < 0:
                assert n == 1 and not starts
            else:
                assert source == starts[0] and not any(s[b : b + n + 1] == s[start : at + 1] for b in range(start) if at < len(s))
        assert at == len(s)


def report(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    got = brute(w)
    gone = {i for b, m, p in got for i in range(b + p, b + m)}
    lines = "".join(f"{b},{m},{p}\n" for b, m, p in got)
    best = max(got, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (doc_id, len(got), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(lines.encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)))


def spell(r, s):
    return "".join(f"w{k}é" + r.choice([" ", "\n", "\t ", "\x0b", "\x0c", "  "]) for k in s)


def test_equals_brute_force(spark):
    r = random.Random(7)
    rows = [(k, spell(r, noisy(r) if k % 3 else [r.randrange(50) for _ in range(r.randrange(200))]), "x", 1) for k in range(500)]
    rows += [(None, "a " * 30, None, None), (10**12, None, None, None), (501, "", None, None), (502, " \n\t", None, None), (503, " ".join("ab" * 40), None, 1)]
    rows += [(7, "same id " * 20, None, None), (7, "same id " * 20, None, None), (504, "lone x " * 20000 + "end", "", 0), (505, "a b c " * 9 + "a b d " + "b c a " * 9, "", 0)]
    got = P.run_report(spark.createDataFrame(rows, SCHEMA).repartition(5))
    key = lambda x: tuple((v is None, v) for v in x)
    small = [x for x in rows if x[0] != 504]
    assert sorted((tuple(x) for x in got.where("doc_id is null or doc_id <> 504").collect()), key=key) == sorted((report(*x[:2]) for x in small), key=key)
    long = got.where("doc_id = 504").first()
    assert (long.n_runs, long.start, long.length, long.period) == (1, 0, 40000, 2) if zlib.crc32(b"504") % 10 else long.n_runs >= 1
    assert sum(x[1] > 0 for x in map(tuple, got.collect())) > 150


def test_collapses_texts_and_keeps_any_key(spark):
    docs = spark.createDataFrame([("x", "go " * 40 + "home"), ("y", None)], "name string, text string")
    got = {x["name"]: (x.collapsed, [tuple(y) for y in x.runs]) for x in P.collapse_runs(docs, "name").collect()}
    assert got == {"x": ("go home", [(0, 40, 1)]), "y": ("", [])}


def test_empty_table(spark):
    assert P.run_report(spark.createDataFrame([], SCHEMA)).collect() == []
