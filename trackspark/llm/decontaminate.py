"""Benchmark decontamination: CGK walks and bit samples of item-sized windows find candidates, edit distance verifies them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .cgk import Walks, edited
from .textbytes import mix, text_views

#: Edits that a passage may have, as a share of the item's length.
EDITS = 0.1
#: Share of the passages at the largest distance that must meet their item in a sample.
RECALL = 0.99
#: Edited copies of each class of lengths that the number of walks is tried on, and how many walks it begins with.
TRIALS, WALKS = 200, 32
#: Walks beyond which none are drawn.
MOST_WALKS = 4096
#: Lengths of a class of items lie within this ratio.
CLASS = 1.25
#: Characters of a gram, and least diagonals of a band; an item's bands are wider than its edits (see Items).
Q, BAND = 8, 64
#: Windows whose walks are taken at once.
WINDOWS = 4096
#: Characters and number of the items searched for in one pass over the documents; more items take more passes.
BLOCK_CHARS, BLOCK_ITEMS = 4_000_000, 20_000
_SLOTS = 22

_LOW = np.full(256, 32, np.uint8)
_LOW[48:58] = np.arange(48, 58)
_LOW[97:123] = np.arange(97, 123)
_LOW[65:91] = np.arange(97, 123)
_LOW[128:] = np.arange(128, 256)


def normalise(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ASCII letters lower-cased, every run of other ASCII than letters and digits one space, none at a document's start."""
    low = _LOW[data]
    space = low == 32
    before = np.ones(len(low) + 1, bool)
    before[1:] = space
    before[offs] = True
    keep = ~(space & before[:-1])
    return low[keep], np.r_[0, np.cumsum(keep)][offs]


def gram_codes(x: np.ndarray) -> np.ndarray:
    """The Q bytes from each place as one integer."""
    a = x.astype(np.uint64)
    b = a[:-1] << np.uint64(8) | a[1:]
    c = b[:-2] << np.uint64(16) | b[2:]
    return c[:-4] << np.uint64(32) | c[4:]


def _slot(code: np.ndarray) -> np.ndarray:
    return code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOTS)


def edit_distance(item: bytes, text: bytes, most: int) -> int:
    """The least number of edits that turn item into any substring of text, or most + 1: Myers' bit-vectors."""
    if item in text:
        return 0
    m = len(item)
    eq: dict[int, int] = {}
    for k, c in enumerate(item):
        eq[c] = eq.get(c, 0) | 1 << k
    full, high = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best = full, 0, m, m
    for c in text:
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & high) - bool(mh & high)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        best = min(best, score)
    return min(best, most + 1)


def _spaced(c: str) -> bool:
    """Whether c is a letter or digit of a script that puts spaces between words: not Thai to Myanmar, Khmer, Chinese or Japanese."""
    k = ord(c)
    return c.isalnum() and not (0xE00 <= k < 0xF00 or 0x1000 <= k < 0x10A0 or 0x1780 <= k < 0x1800 or 0x2E80 <= k < 0xA000 or 0xF900 <= k < 0xFB00 or 0xFF00 <= k < 0xFFF0 or k >= 0x20000)


def stands(item: bytes, text: bytes) -> bool:
    """Whether text, normalised, holds item other than as a part of longer words."""
    a, b, at = item.decode(errors="replace"), text.decode(errors="replace"), -1
    while (at := b.find(a, at + 1)) >= 0:
        left, right = b[at - 1 : at], b[at + len(a) : at + len(a) + 1]
        if not (left and _spaced(left) and _spaced(a[0])) and not (right and _spaced(right) and _spaced(a[-1])):
            return True
    return False


class Items:
    """What one pass looks for. An item of n characters allows k = EDITS * n edits, but no more than leave one of its
    grams whole (one edit less at 20 to 23 and at 30 and 31 characters). Items under 2 * Q characters are only found whole, and not within a longer word.

    Where windows are worth a walk: k edits destroy Q * k grams at most, so a passage keeps need = n - Q + 1 - Q * k of
    them on diagonals at most k apart, in two neighbouring bands of more than k. Diagonals of such bands are the starts of
    windows, as long as the items of that class of lengths; no passage is lost by this. Which items a window is compared with is decided by the samples alone.
    """

    def __init__(self, ids: list, texts: list[str], edits: float = EDITS, walks: int = WALKS):
        raw = [t.encode() for t in texts]
        x, offs = normalise(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64))
        self.ids, self.texts = ids, [x[a:b].tobytes().rstrip(b" ") for a, b in zip(offs, offs[1:], strict=False)]
        n = np.array([len(t) for t in self.texts], np.int64)
        self.most = np.maximum(0, np.minimum((edits * n).astype(np.int64), (n - Q) // Q))
        self.band = np.maximum(BAND, self.most + 1)
        self.need = n - Q + 1 - Q * self.most
        self.short = [k for k in range(len(ids)) if 0 < n[k] < 2 * Q]
        self.use = np.flatnonzero(n >= 2 * Q)
        codes = [gram_codes(np.frombuffer(self.texts[k], np.uint8)) for k in self.use]
        code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        item = np.repeat(self.use, [len(c) for c in codes])
        place = np.concatenate([np.arange(len(c)) for c in codes]) if codes else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        self.item, self.place = item[order], place[order]
        self.codes, self.first = np.unique(code[order], return_index=True)
        self.count = np.diff(np.r_[self.first, len(code)])
        self.slots = np.zeros(1 << _SLOTS, bool)
        self.slots[_slot(self.codes)] = True
        self.longest = int(n.max()) if len(n) else 0
        self.kind = np.floor(np.log(np.maximum(n, 1) / (2 * Q)) / np.log(CLASS) + 1e-9).astype(np.int64)
        self.length = np.array([n[self.kind == c].min() if (self.kind == c).any() else 0 for c in range(int(self.kind.max()) + 1)] if len(self.use) else [], np.int64)
        self.draw(walks)

    def draw(self, walks: int) -> None:
        """Draws so many walks and puts every item's samples in one sorted table."""
        self.walks = Walks(walks)
        x = np.frombuffer(b"".join(self.texts), np.uint8)
        at = np.r_[0, np.cumsum([len(t) for t in self.texts])].astype(np.int64)
        keys = self._samples(x, at[self.use], at[self.use], at[self.use + 1], self.kind[self.use])
        order = np.argsort(keys.ravel(), kind="stable")
        self.keys, self.owner = keys.ravel()[order], np.repeat(self.use, keys.shape[1])[order]

    def _samples(self, x: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, kind: np.ndarray) -> np.ndarray:
        h = self.walks.hashes(x, start, low, high, self.length[kind])
        return mix(h + (kind[:, None].astype(np.uint64) << np.uint64(40)))

    def _windows(self, x: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, start, fullest) of the windows worth a walk: diagonals wherever two neighbouring bands hold as
        many of an item's grams as any passage must, and whether it is the band's fullest one."""
        none = (*(np.zeros(0, np.int64),) * 3, np.zeros(0, bool))
        if len(x) < Q or not len(self.codes):
            return none
        code = gram_codes(x)
        hit = np.flatnonzero(self.slots[_slot(code)])
        k = np.minimum(np.searchsorted(self.codes, code[hit]), len(self.codes) - 1)
        doc = np.searchsorted(offs, hit, side="right") - 1
        ok = (self.codes[k] == code[hit]) & (hit + Q <= offs[doc + 1])
        hit, k, doc = hit[ok], k[ok], doc[ok]
        n = self.count[k]
        of = np.repeat(self.first[k] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        item, start, doc = self.item[of], np.repeat(hit, n) - self.place[of], np.repeat(doc, n)
        band = (start + self.longest) // self.band[item]
        width = (len(x) + self.longest) // BAND + 3
        key, back = np.unique((doc * len(self.ids) + item) * width + band, return_inverse=True)
        if not len(key):
            return none
        # a gram of the item counts once in a band, however often the text repeats it
        once = np.unique(back * (self.longest + 1) + self.place[of])
        count = np.bincount(once // (self.longest + 1), minlength=len(key))
        next_ = np.r_[np.where(key[1:] == key[:-1] + 1, count[1:], 0), 0]
        before = np.r_[0, np.where(key[1:] == key[:-1] + 1, count[:-1], 0)]
        good = (count + np.maximum(next_, before) >= self.need[key // width % len(self.ids)])[back]
        own, n = np.unique(np.stack([back[good], doc[good], item[good], start[good]]), axis=1, return_counts=True)
        own = own[:, np.lexsort((-n, own[0]))]
        return own[1], own[2], own[3], np.r_[True, own[0, 1:] != own[0, :-1]][: own.shape[1]]

    def candidates(self, x: np.ndarray, offs: np.ndarray, windows: tuple | None = None) -> dict[tuple[int, int], list[int]]:
        """(document, item) -> starts of the windows, by default all, that meet the item in a sample at least."""
        doc, item, start = (windows or self._windows(x, offs))[:3]
        doc, kind, start = np.unique(np.stack([doc, self.kind[item], start]), axis=1)
        out: dict[tuple[int, int], list[int]] = {}
        for a in range(0, len(doc), WINDOWS):
            d, s = doc[a : a + WINDOWS], start[a : a + WINDOWS]
            keys = self._samples(x, s, offs[d], offs[d + 1], kind[a : a + WINDOWS])
            left, right = (np.searchsorted(self.keys, keys, side=side) for side in ("left", "right"))
            w, j = np.nonzero(right > left)
            n = (right - left)[w, j]
            of = np.repeat(left[w, j] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            met = np.unique(np.repeat(w, n) * len(self.ids) + self.owner[of])
            for i, item in zip((met // len(self.ids)).tolist(), (met % len(self.ids)).tolist(), strict=True):
                out.setdefault((int(d[i]), item), []).append(int(s[i]))
        return out

    def find(self, data: np.ndarray, offs: np.ndarray) -> dict[tuple[int, int], int]:
        """(document, item) -> edits, for all documents of a slice.

        The fullest diagonal of each band is walked first; the others only for what those did not find.
        """
        x, at = normalise(data, offs)
        found: dict[tuple[int, int], int] = {}
        raw = x.tobytes()
        doc, item, start, fullest = self._windows(x, at)
        self._verify(self.candidates(x, at, (doc[fullest], item[fullest], start[fullest])), raw, at, found)
        left = np.fromiter((pair not in found for pair in zip(doc.tolist(), item.tolist(), strict=True)), bool, len(doc)) & ~fullest
        self._verify(self.candidates(x, at, (doc[left], item[left], start[left])), raw, at, found)
        for item in self.short:
            for doc in range(len(at) - 1) if self.texts[item] in raw else ():
                if stands(self.texts[item], raw[at[doc] : at[doc + 1]]):
                    found[doc, item] = 0
        return found

    def _verify(self, met: dict[tuple[int, int], list[int]], raw: bytes, at: np.ndarray, found: dict[tuple[int, int], int]) -> None:
        for (doc, item), starts in met.items():
            # a passage starts at most its edits away from the diagonals of its grams; near starts are verified together
            most, text = int(self.most[item]), self.texts[item]
            starts.sort()
            cuts = [0, *(i + 1 for i, (p, q) in enumerate(zip(starts, starts[1:], strict=False)) if q - p > len(text)), len(starts)]
            best = found.get((doc, item), most + 1)
            for i, j in zip(cuts, cuts[1:], strict=False):
                lo, hi = max(int(at[doc]), starts[i] - most), min(int(at[doc + 1]), starts[j - 1] + len(text) + 2 * most)
                best = min(best, edit_distance(text, raw[lo:hi], best - 1)) if best else 0
            if best <= most:
                found[doc, item] = best

    def recall(self, seed: int = 0) -> float:
        """The least share, over the classes of lengths, of copies with as many random edits as allowed that meet their item; each stands between other text."""
        shares = []
        for kind in np.unique(self.kind[self.use]).tolist():
            rng = np.random.default_rng([seed, kind])
            own = self.use[self.kind[self.use] == kind]
            pick = own[rng.integers(0, len(own), TRIALS)].tolist()
            around = lambda rng=rng: bytes(rng.integers(97, 123, 20).tolist())
            copies = [around() + b" " + edited(self.texts[k], int(self.most[k]), rng) + b" " + around() for k in pick]
            met = self.candidates(np.frombuffer(b"".join(copies), np.uint8), np.r_[0, np.cumsum([len(c) for c in copies])].astype(np.int64))
            same = {}
            for k in own.tolist():  # an item that repeats another is met with it
                same.setdefault(self.texts[k], []).append(k)
            shares.append(np.mean([any((d, j) in met for j in same[self.texts[k]]) for d, k in enumerate(pick)]))
        return float(min(shares, default=1.0))


def enough_walks(ids: list, texts: list[str], edits: float = EDITS, recall: float = RECALL) -> int:
    """The number of walks with which every class of lengths reaches the recall asked for: doubled until trials by the search itself say so.

    Raises ArithmeticError where MOST_WALKS walks do not reach it.
    """
    items = Items(ids, texts, edits, WALKS)
    walks = WALKS
    while (reached := items.recall()) < recall:
        if walks >= MOST_WALKS:
            raise ArithmeticError(f"{walks} walks reach a recall of {reached:.3f}, not {recall}")
        walks *= 2
        items.draw(walks)
    return walks


def _blocks(items: DataFrame, most: int) -> Iterator[tuple[list, list[str]]]:
    storage.bound_batches(items.sparkSession)
    ids, texts, size = [], [], 0
    for r in items.where("text IS NOT NULL").select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        if ids and (size + len(r.text) > most or len(ids) == BLOCK_ITEMS):
            yield ids, texts
            ids, texts, size = [], [], 0
        ids, texts, size = [*ids, r.item_id], [*texts, r.text], size + len(r.text)
    yield ids, texts


SCHEMA = "doc_id bigint, item_id bigint, edits bigint, similarity double"


def leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, recall: float = RECALL, block: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, similarity) for documents that hold a passage within edits * length of an item.

    A window meets an item where all symbols of a bit sample of their CGK walks agree; each meeting is verified by edit
    distance over the normalised texts. The walks are drawn until, of copies with as many edits as are allowed, at random places,
    `recall` meet their item, for every class of lengths of the items at hand; unchanged passages always do.
    More walks than MOST_WALKS are not drawn: where they do not reach the recall, ArithmeticError is raised. `edits` above 1/8 counts as one edit less than an
    eighth of an item's characters, as an item must keep one of its grams whole (see Items).
    The column `edits` is the least over the windows that met, so a document with several passages of an item may hold a nearer one.
    Null and empty texts hold nothing; null ids stay null; repeated rows answer alike; empty tables give no rows;
    other columns are ignored; long texts are searched whole. No shuffle: a block of items of bounded size travels to the documents.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for ids, texts in _blocks(benchmark, block):
        shared = docs.sparkSession.sparkContext.broadcast((ids, texts, edits, enough_walks(ids, texts, edits, recall)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value)
            for rows, data, offs in text_views(batches):
                found = sorted(items.find(data, offs).items())
                doc_ids = rows.column(0).to_pylist()
                cols = ([doc_ids[d] for (d, _), _ in found], [items.ids[k] for (_, k), _ in found], [e for _, e in found], [1 - e / len(items.texts[k]) for (_, k), e in found])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(),) * 3 + (pa.float64(),), strict=True)], names=["doc_id", "item_id", "edits", "similarity"])

        part = rows.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS, recall: float = RECALL, block: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, all columns as they are, without those that hold a passage of an item; see leaks().

    Rows with null or empty texts stay, and so do all columns, whatever their names.
    """
    for ids, texts in _blocks(benchmark, block):
        shared = docs.sparkSession.sparkContext.broadcast((ids, texts, edits, enough_walks(ids, texts, edits, recall)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value)
            for rows, data, offs in text_views(batches):
                held = {d for d, _ in items.find(data, offs)}
                yield rows.filter(pa.array([k not in held for k in range(rows.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
