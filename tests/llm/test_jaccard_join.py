import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackspark.llm import jaccard_join as J
from trackspark.llm import storage
from trackspark.llm.components import components

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("v", T.StringType()), T.StructField("n", T.StringType())])


def shingle_set(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())


def brute(rows):
    own = [shingle_set(r[1]) for r in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if own[i] and own[j] and 100 * len(own[i] & own[j]) >= 85 * len(own[i] | own[j]):
            up[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted((str(r[0]), len(own[i]), str(least.get(find(i)))) for i, r in enumerate(rows))


def data(seed, groups=12):
    r = np.random.default_rng(seed)
    words = lambda n: [f"w{x}" for x in r.integers(0, 3000, n)]
    line, passage = words(12), words(60)
    texts = []
    for g in range(groups):
        base = words(int(r.choice([5, 12, 30, 60, 150, 400])))
        for _ in range(int(r.integers(1, 12))):
            t = list(base)
            for _ in range(int(r.integers(0, max(2, len(base) // 40 + 1)))):
                t[int(r.integers(len(t)))] = f"x{r.integers(1e6)}"
            texts.append(" ".join((line if r.random() < 0.3 else []) + t + (passage if r.random() < 0.3 else [])))
    texts += [" ".join(passage + words(k)) for k in range(1, 30)] + [" ".join(line)] * 3
    rows = [(k, t.upper() if k % 5 == 0 else t, "clash", None) for k, t in enumerate(texts)]
    return rows + [(None, None, None, None), (900, "", None, None), (901, " \t\n", None, None), (902, "a B c", None, None), (903, "A b\x0bC", None, None), (904, "a b", None, None), (None, texts[0], None, None), (3, texts[40], None, None), (None, "null alone", None, None), (905, "é É", None, None), (906, "É é", None, None)]


@pytest.mark.parametrize(("seed", "rare"), [(0, 16), (1, 1), (2, 2)])
def test_equals_brute_force(spark, monkeypatch, seed, rare):
    monkeypatch.setattr(J, "RARE", rare)  # where it is small, nearly every shared shingle is indexed in combinations
    rows = data(seed)
    got = J.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows)


def test_all_links(spark):
    rows = [r for r in data(3) if r[0] is not None]
    members, links = J.jaccard_links(spark.createDataFrame(rows, SCHEMA))
    of = {}
    for r in members.where("v IS NOT NULL").collect():
        of.setdefault(r.v, set()).add(r.doc_id)
    got = {frozenset((x, y)) for r in links.collect() for x in of[r.a] for y in of[r.b]}
    own = [(r[0], shingle_set(r[1])) for r in rows]
    want = {frozenset((i, j)) for (i, x), (j, y) in itertools.combinations(own, 2) if x != y and x and y and 100 * len(x & y) >= 85 * len(x | y)}
    assert {p for p in got if len(p) == 2} == want


def test_many_near_copies(spark):
    r = np.random.default_rng(5)
    base = [f"w{x}" for x in r.integers(0, 3000, 80)]
    rows = [(k, " ".join(base[:k % 80] + [f"y{k}"] + base[k % 80 + 1 :]), None, None) for k in range(300)]
    got = J.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.component_id) for r in got} == {0}


@pytest.mark.parametrize(("percent", "common"), [(85, 0.0), (85, 0.6), (85, 1.0), (80, 0.9), (50, 1.0), (40, 0.5)])
def test_linked_sets_share_an_entry(percent, common):
    r = np.random.default_rng(percent)
    bounds = J.size_bounds(percent)
    for n in [1, 2, 3, 6, 7, 8, 13, 14, 15, 16, 17, 23, 24, 25, 40, 63, 64, 100, 127, 128, 500]:
        for _ in range(8):
            x = r.integers(0, 2**63, n, dtype=np.uint64)
            # a partner with as many tokens lost and won as the similarity allows
            lost = next((k for k in range(int(r.integers(0, n + 1)), -1, -1) if 100 * (n - k) >= percent * n), 0)
            won = next((k for k in range(int(r.integers(0, n + 1)), -1, -1) if 100 * (n - lost) >= percent * (n + k)), None)
            if won is None:
                continue
            y = np.concatenate([x[lost:], r.integers(0, 2**63, won, dtype=np.uint64)])
            every = np.unique(np.r_[x, y])
            df = np.where(r.random(len(every)) < common, r.choice([3, 20, 300, 9000], len(every)), 2)
            alone = r.random(len(every)) < 0.3  # tokens of one of them are often in no other set
            both = np.intersect1d(x, y)
            entries = []
            for s in (x, y):
                s = np.unique(s)
                at = np.searchsorted(every, s)
                has = np.isin(s, both) | ~alone[at]
                entries.append(J.signatures(s[has], df[at][has], len(s), percent, bounds))
            assert np.intersect1d(*entries).size


def test_bitmap_never_rules_out_a_link():
    r = np.random.default_rng(1)
    differ = lambda x, y: sum(bin(int(a) & (2**64 - 1)).count("1") for a in J.bitmap(x) ^ J.bitmap(y))
    for n in (1, 50, 5000):
        x = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.r_[x[n // 10 :], r.integers(0, 2**63, n // 20, dtype=np.uint64)])
        assert (len(x) + len(y) - differ(x, y)) // 2 >= len(np.intersect1d(x, y))


def test_words_that_a_polynomial_confuses():
    a = b"a"
    for _ in range(10):
        a += bytes(195 - c for c in a)  # the Thue-Morse word of a and b, and its complement
    data = np.frombuffer(a + bytes(195 - c for c in a), np.uint8)
    h = J.word_hash(data, np.array([0, 1024]), np.array([1024, 2048]))
    assert h[0] != h[1]
    assert (J.word_hash(data[3:], np.array([0]), np.array([700])) == J.word_hash(data, np.array([3]), np.array([703]))).all()


def test_components(spark):
    r = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 200, (150, 2))] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, k) for k in range(4000, 4200)]
    got = {x.v: x.label for x in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    assert got == {v: find(v) for v in list(up) if any(v in e and e[0] != e[1] for e in edges)}


def test_empty(spark):
    assert J.jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_of_each(spark):
    """Clashing columns, a null identifier, repeated rows, empty texts: one row of each component stays, all without words."""
    rows = data(4)
    names = ["doc_id", "text", "stays", "x_v"]
    kept = J.one_of_each(spark.createDataFrame(rows, T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, SCHEMA.fields, strict=True)])))
    assert kept.columns == names
    kept = [tuple(r) for r in kept.collect()]
    of = {}
    for r, (_, _, c) in zip(sorted(rows, key=lambda r: str(r[0])), sorted(brute(rows), key=lambda r: r[0]), strict=True):
        of.setdefault(c, []).append(r)
    empty = [r for r in rows if not shingle_set(r[1])]
    assert sorted(map(str, (r for r in kept if not shingle_set(r[1])))) == sorted(map(str, empty))
    linked = [r[0] for r in kept if shingle_set(r[1])]
    assert len(linked) == len(set(linked)) and set(map(str, linked)) >= {c for c in of if c != "None"} - {str(r[0]) for r in empty}


def test_near_copies_meet_once(spark):
    """Sets that share hundreds of entries meet in one of those that the same sets share, and as few pairs are looked at as there are."""
    words_ = [f"w{i}" for i in range(900)]
    rows = [(k, " ".join(w if (i * 7 + k * 13) % 90 else f"x{k}_{i}" for i, w in enumerate(words_))) for k in range(4)]
    docs = J._rows(spark.createDataFrame(rows, "doc_id long, text string"))
    members = J._membership(docs, 1, 80, storage.table)
    sizes = {}

    def table(df, name):
        out = storage.table(df, name)
        sizes[name] = out.count()
        return out

    own = J._tokens(docs, members, members.select("v"), 1, table)
    post, _ = J._postings(own, 80, table)
    groups = post.groupBy("sig").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    assert groups.count() == groups.select("vs").distinct().count() and sizes["postings"] < sizes["entries"] / 5
    met = J._across(post.withColumn("label", F.col("v")), own, 80, table)
    assert met.count() == 6  # every pair links, and none is lost
