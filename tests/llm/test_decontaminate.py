import numpy as np
import pytest
from pyspark.sql import types as T

from trackspark.llm.decontaminate import EDITS, Items, decontaminate, edit_distance, enough_walks, leaks, normalise

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("item_id", T.StringType()), T.StructField("edits", T.StringType())])
ITEMS = "item_id bigint, text string, doc_id bigint"


def prose(r, n):
    return " ".join("".join(r.choice(list("aeioulnrst"), r.integers(2, 8))) for _ in range(n))


def edited(r, t, k):
    t = list(t)
    for _ in range(k):
        p, kind = int(r.integers(len(t))), int(r.integers(3))
        if kind == 0:
            t[p] = str(r.choice(list("aeioulnrst")))
        elif kind == 1:
            del t[p]
        else:
            t.insert(p, str(r.choice(list("aeioulnrst"))))
    return "".join(t)


def plain_distance(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return min(row)


def norm(t):
    raw = (t or "").encode()
    return normalise(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tobytes().rstrip()


def data():
    r = np.random.default_rng(4)
    items = [(k, prose(r, int(r.integers(14, 60))).capitalize() + ".", 0) for k in range(40)] + [(90, "tiny one", 0), (91, "", 0), (92, None, 0), (None, prose(r, 20), 0)]
    docs = [(k, prose(r, int(r.integers(1, 200))), "clash", None) for k in range(150)]
    for k in range(40):  # exact, lightly and heavily edited
        t = items[k][1]
        docs.append((1000 + k, f"{prose(r, 9)}. {t} {prose(r, 30)}", None, None))
        docs.append((2000 + k, f"{prose(r, 9)}\n{edited(r, t, len(t) // 20)} {prose(r, 3)}", None, None))
        docs.append((3000 + k, f"{prose(r, 9)} {edited(r, t, len(t) // 2)} {prose(r, 3)}", None, None))
        docs.append((4000 + k, t[: len(t) // 2], None, None))
    docs += [(None, items[0][1].upper(), None, None), (7, None, None, None), (8, "", None, None), (9, prose(r, 30_000) + items[3][1], None, None), (10, "a tiny-one stands", None, None), (1000, docs[150][1], None, None)]
    return docs, items


def test_against_brute_force(spark):
    docs, items = data()
    got = {(r.doc_id, r.item_id): r.edits for r in leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block=4000).collect()}
    texts = {k: norm(t) for k, t, _ in items if t}
    want = {}
    for doc_id, t, *_ in docs:
        if doc_id is None or doc_id >= 1000:
            x = norm(t)
            for k in {doc_id % 1000 if doc_id else 0, 5, 6}:
                d, y = plain_distance(texts[k], x), texts[k]
                if d <= min(int(EDITS * len(y)), (len(y) - 10) // 8):
                    want[doc_id, k] = d
    assert {p for p in want if p[0] is None or p[0] < 2000} <= set(got)  # exact passages
    assert len(set(want) & set(got)) >= 0.95 * len(want)
    assert all(got[p] == want[p] for p in set(want) & set(got))
    assert set(got) - set(want) == {(9, 3), (10, 90)}


def test_rows_stay_or_go(spark):
    docs, items = data()
    df = spark.createDataFrame(docs, DOCS)
    left = decontaminate(df, spark.createDataFrame(items, ITEMS))
    ids = {r.doc_id for r in left.collect()}
    assert left.columns == df.columns and {*range(150)} - {9, 10} <= ids and {7, 8} <= ids
    assert not ids & {1000 + k for k in range(40)} and {4000 + k for k in range(40)} <= ids


def test_recall_at_the_largest_distance():
    r = np.random.default_rng(8)
    texts = [prose(r, int(r.integers(14, 60))) for _ in range(60)]
    items = Items(list(range(60)), texts)
    raw = [f"{prose(r, 20)} {edited(r, t, int(items.most[k]))} {prose(r, 20)}".encode() for k, t in enumerate(texts)]
    found = items.find(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    assert sum((k, k) in found for k in range(60)) >= 54


def found(texts, docs):
    raw = [d.encode() for d in docs]
    return Items(list(range(len(texts))), texts).find(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])


@pytest.mark.parametrize("size", [81, 233, 394, 600])
@pytest.mark.parametrize("kind", ["insert", "delete", "delete in front"])
def test_every_passage_at_the_largest_distance(size, kind):
    r = np.random.default_rng(size)
    letters = list("abcdefghijklmnopqrstuvwxyz0123456789")
    texts = ["".join(r.choice(letters, size)) for _ in range(60)]
    docs = []
    for t, most in zip(texts, Items(list(range(60)), texts).most.tolist(), strict=True):
        t = list(t)
        for p in np.linspace(0, (size - 9) / (2 if "front" in kind else 1), most).astype(int)[::-1]:
            t[p : p + 1] = [t[p], str(r.choice(letters))] if kind == "insert" else []
        docs.append("".join(t))
    assert set(found(texts, docs)) == {(k, k) for k in range(60)}


@pytest.mark.parametrize("size", [700, 2000, 5000])
def test_long_items_allow_their_share_of_edits(size):
    r = np.random.default_rng(size)
    letters = list("abcdefghijklmnopqrstuvwxyz0123456789")
    texts = ["".join(r.choice(letters, n)) for n in (size, 100)]
    most = int(EDITS * size)
    less, more = (np.linspace(0, size - 9, k).astype(int) for k in (most, most + size // 20))
    docs = [texts[1], "".join(np.delete(list(texts[0]), less)), "".join(np.insert(list(texts[0]), less, "z")), "".join(np.delete(list(texts[0]), more))]
    got = found(texts, docs)
    assert got[0, 1] == 0 and set(got) == {(0, 1), (1, 0), (2, 0)} and max(got.values()) <= most and got[1, 0] > 63


def test_passages_without_spaces_around():
    r = np.random.default_rng(5)
    han = lambda n: "".join(map(chr, r.integers(0x4E00, 0x9FA5, n)))
    thai = lambda n: "".join(map(chr, r.integers(0xE01, 0xE2F, n)))
    texts = [han(60), thai(70), f"{han(20)}，{han(30)}。", prose(r, 1) + "".join(r.choice(list("aeioulnrst"), 120)), prose(r, 30), han(5), "tiny one"]
    docs = [han(300) + texts[0] + han(300), thai(200) + texts[1] + thai(99), f"{han(40)}「{texts[2]}」{han(9)}", f"x{texts[3]}y", f"“{texts[4]}”"]
    docs += [han(30) + texts[5] + han(30), "“tiny one”", "a tiny onerous", "atiny one", "tiny oné", texts[0][:40] + "一" + texts[0][41:]]
    got = found(texts, docs)
    assert {p for p, d in got.items() if d == 0} == {*((k, k) for k in range(7))} and set(got) == {*((k, k) for k in range(7)), (10, 0)}


@pytest.mark.parametrize("seed", range(5))
def test_edit_distance(seed):
    r = np.random.default_rng(seed)
    a, b = prose(r, 12), prose(r, 5) + edited(r, prose(np.random.default_rng(seed), 12), 6)
    assert edit_distance(a.encode(), b.encode(), 99) == plain_distance(a, b)


def test_empty(spark):
    docs, items = data()
    assert leaks(spark.createDataFrame([], DOCS), spark.createDataFrame(items, ITEMS)).collect() == []
    assert leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).collect() == []
    assert decontaminate(spark.createDataFrame(docs, DOCS), spark.createDataFrame([], ITEMS)).count() == len(docs)


@pytest.mark.parametrize("size", [24, 43, 81, 233, 394, 993, 2203, 5000])
def test_recall_by_length(size):
    r = np.random.default_rng(size)
    items = Items(list(range(40)), [prose(r, size // 4)[:size].strip() for _ in range(40)])
    assert items.recall(seed=size) >= 0.95
    items.draw(1)
    assert items.recall(seed=size) < 0.95  # the samples do the search: one walk finds fewer


def test_walks_are_drawn_until_the_recall_is_reached(monkeypatch):
    monkeypatch.setattr("trackspark.llm.decontaminate.WALKS", 1)
    r = np.random.default_rng(0)
    texts = [prose(r, 60) for _ in range(30)]
    assert enough_walks(list(range(30)), texts, recall=0.99) > 1


def test_walks_end_with_an_error(monkeypatch):
    from trackspark.llm import decontaminate as D

    monkeypatch.setattr(D.Items, "recall", lambda self, seed=0: 0.5)
    monkeypatch.setattr(D, "MOST_WALKS", 64)
    with pytest.raises(ArithmeticError, match="recall of 0.500"):
        D.enough_walks([1], ["a benchmark item of some length, to be found in texts"])
