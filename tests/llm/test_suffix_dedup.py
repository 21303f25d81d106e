import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import types as T

from trackspark.llm import suffix_dedup as S

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("t", T.StringType()), T.StructField("h", T.StringType())])


def brute(rows):
    raw = [(r[1] or "").encode() for r in rows]
    count = collections.Counter(x[i : i + S.LENGTH] for x in raw for i in range(len(x) - S.LENGTH + 1))
    out = []
    for r, x in zip(rows, raw, strict=True):
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - S.LENGTH + 1):
            if count[x[i : i + S.LENGTH]] > 1:
                gone[i : i + S.LENGTH] = True
        out.append((str(r[0]), len(x), int(gone.sum()), len(S.runs_of(gone)[0]), hashlib.sha256(np.frombuffer(x, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def data(seed):
    r = np.random.default_rng(seed)
    text = lambda n: " ".join("".join(r.choice(list("abcdeé"), r.integers(1, 7))) for _ in range(n))
    passages = [text(int(r.integers(30, 120))) for _ in range(6)]
    texts = [text(int(r.integers(1, 150))) for _ in range(60)]
    for k in range(40):
        texts[k] += " " + passages[int(r.integers(6))] + " " + text(int(r.integers(0, 20)))
    texts += [texts[3], texts[3], "short", "short", "word " * 400, "x" * 199, "y" * 200, "z" * 201, "ab" * 300]
    base = text(400)
    texts += [base[:k] + "#" + base[k + 1 :] for k in (10, 300, 900)] + [passages[0] + "|" + passages[0], passages[1][:200], passages[1][1:200], text(9000) + passages[2]]
    rows = [(k, t, "clash", None) for k, t in enumerate(texts)]
    return rows + [(None, None, None, None), (7, "", None, None), (None, texts[5], None, None), (None, base, None, None), (7, passages[3], None, None)]


@pytest.mark.parametrize(("seed", "hot", "shard"), [(0, 4000, 1 << 21), (1, 1, 3000), (2, 4000, 2000)])
def test_equals_brute_force(spark, monkeypatch, seed, hot, shard):
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "SHARD", shard)
    rows = data(seed)
    got = S.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 9, 300, 3000])
def test_suffix_array(n):
    r = np.random.default_rng(n)
    x = r.integers(97, 99, n).astype(np.uint8)
    raw = x.tobytes()
    assert S.suffix_array(x, 10**6).tolist() == sorted(range(n), key=lambda k: raw[k:])


@pytest.mark.parametrize("seed", range(4))
def test_repeats(seed):
    r = np.random.default_rng(seed)
    block = r.integers(97, 101, 900).astype(np.uint8)
    x = np.concatenate([block, r.integers(97, 101, 700).astype(np.uint8), block[37 : 400 + seed], np.full(500, 120, np.uint8), block[:199]])
    raw = x.tobytes()
    count = collections.Counter(raw[k : k + S.LENGTH] for k in range(len(raw) - S.LENGTH + 1))
    shared, first = S.repeats(x)
    whole = len(raw) - S.LENGTH + 1
    assert shared[:whole].tolist() == [count[raw[k : k + S.LENGTH]] > 1 for k in range(whole)]
    assert sum(first[:whole]) >= len(count) and len({raw[k : k + S.LENGTH] for k in range(whole) if first[k]}) == len(count)


def substituted(seed, size=2500, copies=4, letters=9):
    """Copies of a text that differ by single letters, so that many pairs share just a bit more or less than the order looks at."""
    r = np.random.default_rng(seed)
    base, out = r.integers(97, 123, size).astype(np.uint8), []
    for _ in range(copies):
        x = base.copy()
        x[r.integers(0, size, letters)] = r.integers(97, 123, letters)
        out.append(x.tobytes())
    return out


@pytest.mark.parametrize("seed", range(4))
def test_repeats_of_substituted_copies(seed):
    raw = S.joined(substituted(seed))[0].tobytes()
    whole = len(raw) - S.LENGTH + 1
    count = collections.Counter(raw[k : k + S.LENGTH] for k in range(whole))
    shared, first = S.repeats(np.frombuffer(raw, np.uint8))
    assert shared[:whole].tolist() == [count[raw[k : k + S.LENGTH]] > 1 for k in range(whole)]
    assert {raw[k : k + S.LENGTH] for k in range(whole) if first[k]} == set(count)


def test_exactly_256_shared_bytes():
    r = np.random.default_rng(1)
    passage = r.integers(97, 123, 256).astype(np.uint8).tobytes()
    # the place after the passage's start gets another predecessor, which shares bytes 192 to 199 and not all before
    other = passage[1:150] + b"#" + passage[151:256]
    raw = S.joined([passage + b"z" + passage[:99], other + b"m" + passage[:99], passage + b"a" + passage[99:198]])[0].tobytes()
    whole = len(raw) - S.LENGTH + 1
    count = collections.Counter(raw[k : k + S.LENGTH] for k in range(whole))
    assert S.repeats(np.frombuffer(raw, np.uint8))[0][:whole].tolist() == [count[raw[k : k + S.LENGTH]] > 1 for k in range(whole)]


def test_substituted_copies_equal_brute_force(spark):
    rows = [(10 * s + k, t.decode(), None, None) for s in range(4) for k, t in enumerate(substituted(s))]
    got = S.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(2)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows)


def test_empty(spark):
    assert S.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_texts_are_anchored_piece_by_piece(monkeypatch):
    r = np.random.default_rng(6)
    data = r.integers(97, 101, 5000, dtype=np.uint8)
    offs = np.array([0, 1700, 1700, 1750, 5000])
    want = S.owners(data, offs)
    monkeypatch.setattr(S, "MOST_AT_ONCE", 700)
    assert all(np.array_equal(x, y) for x, y in zip(S.owners(data, offs), want, strict=True))


def test_strings_that_share_a_digest_are_compared_by_bytes(monkeypatch):
    monkeypatch.setattr(S, "span_hash", lambda h, a, b: np.zeros(len(a), np.uint64))
    parts = [bytes([97 + k]) * 200 for k in (0, 1, 2, 1, 3, 2, 2)]
    got = S.same_strings(np.frombuffer(b"".join(parts), np.uint8), np.arange(7) * 200)
    assert [x.tolist() for x in got] == [[False, True, True, True, False, True, True], [True, True, True, False, True, False, False]]
    again, lead = S.same_strings(np.frombuffer(parts[0] + parts[1], np.uint8), np.array([0, 200]))
    assert not again.any() and lead.all()


@pytest.mark.parametrize("hot", [1, 3, 20])
def test_passages_of_most_texts_merge_in_levels(spark, monkeypatch, hot):
    """One passage in nearly all texts, one gram in all of them with other bytes around it, and pairs that only meet at the top."""
    monkeypatch.setattr(S, "HOT", hot)
    monkeypatch.setattr(S, "SHARD", 700)
    r = np.random.default_rng(9)
    text = lambda n: "".join(r.choice(list("abcdefgh "), n))
    shared, gram = text(420), text(S.GRAM)
    rows = [(k, text(int(r.integers(0, 90))) + shared[k % 3 : 420 - k % 5] + text(int(r.integers(0, 90))), None, None) for k in range(90)]
    rows += [(100 + k, text(190) + gram + text(190), None, None) for k in range(60)]
    rows += [(200 + k, rows[90 + k][1][5:400] + text(30), None, None) for k in range(0, 60, 7)]
    got = S.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert sorted((str(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == brute(rows)
