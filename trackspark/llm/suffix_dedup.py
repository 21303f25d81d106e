"""Removal of repeated byte strings: per-shard suffix arrays, Kasai common prefixes, cross-shard merging.

Every string of LENGTH bytes owns an anchor, the gram of least hash in it (the leftmost of equals). Equal strings own
equal anchors at equal places, so only strings whose anchor occurs again can repeat: all others are ruled out before
any suffix is sorted. The remaining documents are dealt into shards; each sorts its suffixes and finds what repeats
within it. One string of each kind goes on to meet those of other shards: they are dealt by anchor, and each is
searched for in the sorted list of the others, and what is found is compared byte by byte. Strings of an anchor that very
many texts have are dealt by a second anchor, too, and where that is common as well, they merge in levels: each part of the texts
sends one string of each kind up, so that a passage that a third of all documents share is no single task.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .textbytes import mix, prefix_hash, runs, same_spans, span_hash, text_views

#: Bytes of a string that may not repeat, and of an anchor's gram.
LENGTH, GRAM = 200, 24
#: Bytes of text whose suffixes are sorted together.
SHARD = 1 << 21
#: Texts with an anchor beyond which its strings are dealt by a second anchor as well; rows of a key beyond which they merge in levels.
HOT = 4000
#: Mixed into the hashes of grams for second anchors.
_SECOND = np.uint64(0x5851F42D4C957F2D)
#: Texts that a task remembers having anchored; forgetting costs rows only.
SEEN = 500_000
#: Identifiers that are broadcast to fetch texts, at most; beyond, texts are joined by shuffle.
MOST_IDS = 2_000_000
_PLACE = np.uint64((1 << 28) - 1)
#: Bytes whose places fit beside a hash; longer texts are anchored piece by piece.
MOST_AT_ONCE = int(_PLACE)
#: Bytes of strings of whole anchors that are compared at once.
TOGETHER = 1 << 20


# ---------------------------------------------------------------- anchors


def owners(data: np.ndarray, offs: np.ndarray, second: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all strings within documents, the place of each one's anchor (or second anchor: by another hash), and the hash of the gram at every place."""
    n = len(data)
    if n > MOST_AT_ONCE:  # a string's anchor depends on its own bytes alone
        parts, step = [], MOST_AT_ONCE - LENGTH + 1
        for a in range(0, n - LENGTH + 1, step):
            piece = data[a : a + MOST_AT_ONCE]
            s, p, g = owners(piece, np.clip(offs - a, 0, len(piece)), second)
            parts.append((s + a, p + a, g if a + step > n - LENGTH else g[:step]))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - GRAM + 1)
    gram = span_hash(prefix_hash(data), at, at + GRAM)
    gram = mix(gram ^ _SECOND) if second else gram
    least = (gram & ~_PLACE) | at.astype(np.uint64)
    width = LENGTH - GRAM + 1
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: n - LENGTH + 1], least[width - span : width - span + n - LENGTH + 1])
    inside = np.zeros(n - LENGTH + 1, bool)
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
        if b - a >= LENGTH:
            inside[a : b - LENGTH + 1] = True
    starts = np.flatnonzero(inside)
    return starts, (least[starts] & _PLACE).astype(np.int64), gram


# ---------------------------------------------------------------- suffix arrays


def eight_bytes(x: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number, in the order of strings; zeros beyond the end."""
    a = np.r_[x, np.zeros(8, np.uint8)].astype(np.uint64)
    a = a[:-1] << np.uint64(8) | a[1:]
    a = a[:-2] << np.uint64(16) | a[2:]
    return (a[:-4] << np.uint64(32) | a[4:])[: len(x)]


def suffix_array(x: np.ndarray, depth: int = LENGTH, code: np.ndarray | None = None) -> np.ndarray:
    """Suffixes in the order of their first `depth` bytes at least: Larsson-Sadakane refinement.

    Ranks by the first 8 bytes, then by twice as many in turn; only suffixes that still share their rank are sorted
    again, by the rank of what follows.
    """
    n = len(x)
    code = eight_bytes(x) if code is None else code
    sa = np.argsort(code, kind="stable")
    new = np.r_[True, code[sa[1:]] != code[sa[:-1]]] if n else np.zeros(0, bool)
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1
    rank[sa] = first
    h = 8
    at = np.arange(n)
    while h < depth:
        r = rank[sa[at]]
        tied = np.zeros(len(at), bool)
        if len(at) > 1:
            same = r[1:] == r[:-1]
            tied[1:] |= same
            tied[:-1] |= same
        at, r = at[tied], r[tied]
        if not len(at):
            break
        s = sa[at]
        key = r * (n + 1) + rank[np.minimum(s + h, n)] + 1
        order = np.argsort(key, kind="stable")
        key, s = key[order], s[order]
        sa[at] = s
        new = np.r_[True, key[1:] != key[:-1]]
        rank[s] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        h *= 2
    return sa


def repeats(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shared, first): whether the string from each place occurs elsewhere in x too, and is the first of its kind in order.

    Kasai: a suffix shares with its predecessor in order at least one byte less than the suffix one place before it
    does. The text is walked in parallel lanes, each carrying its length on; lengths are raised 8 bytes at a time
    and so may fall short by 7, which the last comparison makes good. The order knows no more than a suffix's first
    bytes (see suffix_array): after a length that reached LENGTH the next predecessor may be any other, so the length
    goes on only if that is the byte after the last predecessor, and is counted anew if not.
    """
    n = len(x)
    code = eight_bytes(x)
    sa = suffix_array(x, LENGTH, code)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    padded = np.r_[code, np.arange(LENGTH + 8, dtype=np.uint64)]
    equal = np.zeros(n, bool)
    lanes = max(1, n // 256)
    steps = -(-n // lanes)
    start, length, before = np.arange(lanes) * steps, np.zeros(lanes, np.int64), np.full(lanes, -1, np.int64)
    for t in range(steps):
        i = start + t
        live = np.flatnonzero(i < n)
        if not len(live):
            break
        p, j = i[live], phi[i[live]]
        known = (j >= 0) & ((length[live] < LENGTH) | (j == before[live] + 1))
        k = np.where(known, np.maximum(length[live] - 1, 0), 0)
        go = np.flatnonzero(j >= 0)
        while len(go):
            go = go[(k[go] < LENGTH) & (padded[p[go] + k[go]] == padded[j[go] + k[go]])]
            k[go] += 8
        length[live], before[live] = k, j
        far = np.flatnonzero((k >= LENGTH - 8) & (j >= 0))
        equal[p[far]] = padded[p[far] + LENGTH - 8] == padded[j[far] + LENGTH - 8]
    shared = equal.copy()
    shared[sa[:-1]] |= equal[sa[1:]]
    return shared, ~equal


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after another, each followed by a separator that no other has: bytes that UTF-8 never uses, and a number."""
    parts, at, to = [], [], 0
    for k, t in enumerate(texts):
        parts += [t, b"\xff" + (k + 1).to_bytes(5, "big") + b"\xfe\xff"]
        at.append(to)
        to += len(t) + 8
    return np.frombuffer(b"".join(parts), np.uint8), np.array(at, np.int64)


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of True."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return edge[::2], edge[1::2] - edge[::2]


# ---------------------------------------------------------------- stages

MEMBERS = "doc_id bigint, n_bytes bigint, t bigint, sha string"
#: kind 0: `count` strings of text t from `start` are repeated. 1: strings that go on, with their bytes; h is what they are dealt by.
FOUND = "kind int, h bigint, t bigint, start bigint, count bigint, body binary"
_FOUND = pa.schema([("kind", pa.int32()), ("h", pa.int64()), ("t", pa.int64()), ("start", pa.int64()), ("count", pa.int64()), ("body", pa.binary())])


def text_key(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)


def _members(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in text_views(batches):
            raw, o = data.tobytes(), offs.tolist()
            own = [raw[a:b] for a, b in zip(o, o[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, own), pa.int64()), pa.array(map(text_key, own), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in own], pa.string())],
                names=["doc_id", "n_bytes", "t", "sha"],
            )

    return storage.table(rows.mapInArrow(run, MEMBERS), "members")


def _anchors(rows: DataFrame) -> DataFrame:
    """h, t, texts for each anchor that occurs again, in another text or the same; texts is about how many have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, data, offs in text_views(batches):
            if len(seen) > SEEN:
                seen.clear()
            raw, o = data.tobytes(), offs.tolist()
            keys = np.array([text_key(raw[a:b]) for a, b in zip(o, o[1:], strict=False)], np.int64)
            fresh = np.zeros(len(keys), bool)
            for k, x in enumerate(keys.tolist()):
                if x not in seen:
                    fresh[k] = True
                    seen.add(x)
            _, place, gram = owners(data, offs)
            place = np.unique(place)
            doc = np.searchsorted(offs, place, side="right") - 1
            place, doc = place[fresh[doc]], doc[fresh[doc]]
            h = gram[place].view(np.int64)
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            again = np.diff(np.r_[first, len(h)]) > 1
            yield pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(keys[doc[first]]), pa.array(again)], names=["h", "t", "again"])

    found = storage.table(rows.where("text IS NOT NULL").mapInArrow(run, "h bigint, t bigint, again boolean"), "found")
    sums = found.groupBy("h").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.max("again").alias("twice"), F.count("*").alias("texts"))
    return storage.table(found.join(sums.where("lo <> hi OR twice").select("h", "texts"), "h").select("h", "t", "texts"), "anchors")


def _candidates(rows: DataFrame, members: DataFrame, anchors: DataFrame) -> DataFrame:
    """t, text, hs (anchors that occur again), hot (whether each is in more than HOT texts): one row for each text with any."""
    lists = anchors.distinct().groupBy("t").agg(F.collect_list(F.struct("h", (F.col("texts") > HOT).alias("hot"))).alias("a"))
    lists = lists.select("t", F.col("a.h").alias("hs"), F.col("a.hot").alias("hot"))
    ids = storage.table(members.join(lists.select("t"), "t", "left_semi").groupBy("t").agg(F.min("doc_id").alias("doc_id")), "ids")
    some = ids.where("doc_id IS NOT NULL").select("doc_id")
    near = rows.join(F.broadcast(some) if ids.count() <= MOST_IDS else some, "doc_id", "left_semi").unionAll(rows.where("doc_id IS NULL"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in text_views(batches):
            raw, o = data.tobytes(), offs.tolist()
            yield pa.RecordBatch.from_arrays([pa.array([text_key(raw[a:b]) for a, b in zip(o, o[1:], strict=False)], pa.int64()), batch.column(1)], names=["t", "text"])

    texts = near.where("text IS NOT NULL").mapInArrow(run, "t bigint, text string").dropDuplicates(["t"])
    return storage.table(texts.join(lists, "t"), "candidates")


def _shards(candidates: DataFrame) -> DataFrame:
    """What repeats within each shard, and the strings that go on; see FOUND."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in text_views(batches, limit=SHARD):
            raw, o = data.tobytes(), offs.tolist()
            texts = [raw[a:b] for a, b in zip(o, o[1:], strict=False)]
            x, at = joined(texts)
            shared, first = repeats(x)
            keys, lists, hots = batch.column(0).to_pylist(), batch.column(2), batch.column(3)
            starts, place, gram = owners(data, offs)
            bounds = np.searchsorted(starts, offs)
            out: list[tuple] = []
            for d, t in enumerate(keys):
                p, a = starts[bounds[d] : bounds[d + 1]], place[bounds[d] : bounds[d + 1]]
                if not len(p):
                    continue
                hs = lists[d].values.to_numpy(zero_copy_only=False)
                order = np.argsort(hs)
                h = gram[a].view(np.int64)
                k = np.minimum(np.searchsorted(hs[order], h), len(hs) - 1)
                candidate = hs[order][k] == h
                hot = candidate & hots[d].values.to_numpy(zero_copy_only=False)[order][k]
                local = p - o[d]
                own = slice(int(at[d]), int(at[d]) + len(p))
                out += [(0, None, t, int(s), int(n), None) for s, n in zip(*runs_of(shared[own]), strict=True)]
                send = candidate & first[own]
                if (hot & send).any():
                    _, b, other = owners(data[o[d] : o[d + 1]], np.array([0, o[d + 1] - o[d]]), second=True)
                    h = np.where(hot, mix(h.view(np.uint64) ^ other[b]).view(np.int64), h)
                # a run of strings of one key
                cut = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (send[1:] != send[:-1])])
                for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(p)], strict=True):
                    if send[s]:
                        out.append((1, int(h[s]), t, int(local[s]), e - s, texts[d][s : e - 1 + LENGTH]))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FOUND, strict=True)], schema=_FOUND)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _FOUND, strict=True)], schema=_FOUND)

    return storage.table(candidates.select("t", "text", "hs", "hot").mapInArrow(run, FOUND), "found")


def same_strings(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(again, lead): whether the string of LENGTH bytes at each place has the same bytes as that at another, and is the first of its kind.

    Their digests are sorted, and each is searched for in the short list of those that occur twice; strings
    found so are compared with the first of their digest byte by byte, and those unlike it among themselves.
    """
    dig = span_hash(prefix_hash(data), at, at + LENGTH)
    ordered = np.sort(dig)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    again, lead = np.zeros(len(at), bool), np.ones(len(at), bool)
    if not len(twice):
        return again, lead
    k = np.minimum(np.searchsorted(twice, dig), len(twice) - 1)
    some = np.flatnonzero(twice[k] == dig)
    _, first, kind = np.unique(k[some], return_index=True, return_inverse=True)
    rep = at[some[first[kind]]]
    same = same_spans(data, at[some], at[some] + LENGTH, rep, rep + LENGTH)
    again[some] = same & (np.bincount(kind[same], minlength=len(first)) > 1)[kind]
    lead[some[same]] = False
    lead[some[first]] = True
    if not same.all():
        places: dict[bytes, list[int]] = {}
        for i in some[~same].tolist():
            places.setdefault(data[at[i] : at[i] + LENGTH].tobytes(), []).append(i)
        for i in itertools.chain.from_iterable(x for x in places.values() if len(x) > 1):
            again[i] = True
        for i in itertools.chain.from_iterable(x[1:] for x in places.values()):
            lead[i] = False
    return again, lead


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What repeats among strings (h, t, start, count, body, up) that come sorted by h; and of keys with `up` one string of each kind, to go on.

    Whole keys of about TOGETHER bytes are compared at once; equal strings have equal keys, so none is missed.
    """

    def compare(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        h, t, start, n = (rows.column(k).to_numpy() for k in range(4))
        up = rows.column(5).to_numpy(zero_copy_only=False)
        body = [x.as_buffer() for x in rows.column(4).combine_chunks()] if len(n) else []
        data = np.frombuffer(b"".join(body), np.uint8)
        offs = np.r_[0, np.cumsum([len(x) for x in body])].astype(np.int64)
        at = np.arange(n.sum()) + np.repeat(offs[:-1] - (np.cumsum(n) - n), n)
        bounds = np.r_[0, np.cumsum(n)]
        again, lead = same_strings(data, at)
        a, e = runs(again, bounds)
        row = np.searchsorted(bounds, a, side="right") - 1
        c, f = runs(lead & np.repeat(up, n), bounds)
        on = np.searchsorted(bounds, c, side="right") - 1
        sent = [data[at[i] : at[j - 1] + LENGTH].tobytes() for i, j in zip(c.tolist(), f.tolist(), strict=True)]
        kind = np.repeat(np.array([0, 1], np.int32), [len(a), len(c)])
        cols = [np.r_[h[row], h[on]], np.r_[t[row], t[on]], np.r_[start[row] + a - bounds[row], start[on] + c - bounds[on]], np.r_[e - a, f - c]]
        return pa.RecordBatch.from_arrays([pa.array(kind), *(pa.array(x.astype(np.int64)) for x in cols), pa.array([None] * len(a) + sent, pa.binary())], schema=_FOUND)

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        h = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.r_[False, h[1:] != h[:-1]]).tolist() if len(h) else []
        at = 0
        for end in [*cuts, len(h)]:
            part = batch.slice(at, end - at)
            at = end
            if held and held[-1].column(0)[-1].as_py() != part.column(0)[0].as_py() and size >= TOGETHER:
                yield compare(held)
                held, size = [], 0
            held.append(part)
            size += pc.sum(pc.binary_length(part.column(4))).as_py() or 0
    if held:
        yield compare(held)


def _across(found: DataFrame) -> DataFrame:
    """t, start, count of the strings that repeat between shards.

    Strings of one key come together in one task. A key with more than HOT rows is dealt over parts of its texts, and each part sends one
    string of each kind to the next level, until no key has more, or nothing is gained any more (its strings are then all different).
    """
    cols = ("h", "t", "start", "count", "body")
    rows, marks = found.where("kind = 1").select(*cols), []
    before = None
    while True:
        many = storage.table(rows.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > HOT), "many")
        left = many.agg(F.sum("n")).first()[0] or 0
        if not left or before is not None and left > 0.9 * before:
            break
        before = left
        part = F.when(F.col("n").isNull(), 0).otherwise(F.pmod(F.xxhash64("t", F.lit(len(marks))), F.ceil(F.col("n") / HOT))).cast("bigint")
        dealt = rows.join(many, "h", "left").withColumns({"_part": part, "up": F.col("n").isNotNull()}).repartition("h", "_part").sortWithinPartitions("h", "_part")
        met = storage.table(dealt.select(*cols, "up").mapInArrow(_met, FOUND), "met")
        marks.append(met.where("kind = 0").select("t", "start", "count"))
        rows = met.where("kind = 1").select(*cols)
    last = rows.withColumn("up", F.lit(False)).repartition("h").sortWithinPartitions("h").mapInArrow(_met, FOUND).select("t", "start", "count")
    return reduce(DataFrame.unionAll, marks, last)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs.

    A byte goes if it is covered by a string of LENGTH bytes that also starts anywhere else, in this text or another;
    strings are judged on the input. A null or empty text keeps nothing and loses nothing; rows with equal texts of
    LENGTH bytes or more lose all of it; a null doc_id is a row like any other; an empty table gives no rows; other
    columns are ignored; texts of any length (up to Arrow's 2 GB) are handled whole.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    members = _members(rows)
    candidates = _candidates(rows, members, _anchors(rows))
    found = _shards(candidates)
    parts = found.where("kind = 0").select("t", "start", "count").unionAll(_across(found))
    parts = parts.groupBy("t").agg(F.collect_list("start").alias("starts"), F.collect_list("count").alias("counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, data, offs in text_views(batches):
            out, o = [], offs.tolist()
            for d, t in enumerate(b.column(0).to_pylist()):
                body = data[o[d] : o[d + 1]]
                edge = np.zeros(len(body) + 1, np.int64)
                s = b.column(2)[d].values.to_numpy(zero_copy_only=False)
                np.add.at(edge, s, 1)
                np.add.at(edge, s + b.column(3)[d].values.to_numpy(zero_copy_only=False) - 1 + LENGTH, -1)
                gone = np.cumsum(edge[:-1]) > 0
                out.append((t, int(gone.sum()), len(runs_of(gone)[0]), hashlib.sha256(body[~gone].tobytes()).hexdigest()))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["t", "removed", "spans", "kept"])

    changed = candidates.select("t", "text").join(parts, "t").select("t", "text", "starts", "counts").mapInArrow(run, "t bigint, removed bigint, spans bigint, kept string")
    same = members.groupBy("t").agg((F.count("*") > 1).alias("copied"))
    m = members.join(same.join(changed, "t", "left"), "t")
    gone = F.col("copied") & (F.col("n_bytes") >= LENGTH)
    return m.select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
