"""N-gram Jaccard join with token-combination prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage
from .components import components
from .textbytes import lower_ascii, mix, text_views, word_hash, words

#: Words of a shingle; two sets link when 100 * intersection >= PERCENT * union.
SHINGLE, PERCENT = 4, 85
#: The first prefix is this share of the set longer than one common token needs, so that many of its tokens must recur.
EXTENDED = 0.1
#: A token in at most RARE ** k sets is of class k and indexed in combinations of k; MOST_K is the last class.
RARE, MOST_K = 16, 3
#: Tokens of a set that share a group, for each token of a combination.
GROUP = 6
#: Pairs of size classes whose larger one starts below this index single tokens of every class.
SMALL = 24
#: Draws of one other set for each set before all pairs across components are checked.
ROUNDS = 2
#: Bits of a parity bitmap, in words of 64: sets of many hundreds of tokens differ by hundreds, which fewer bits cannot show.
BITMAP = 2048
#: Least open entries of a set that its rows carry, to leave out pairs that an entry before has brought together.
LEAST = 16
#: Identifiers that are broadcast to fetch texts, at most; beyond, texts are joined by shuffle.
MOST_IDS = 2_000_000
#: Sets that a task remembers having written; forgetting costs rows only.
SEEN = 500_000

Table = Callable[[DataFrame, str], DataFrame]


# ---------------------------------------------------------------- sets


def shingles(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles in turn (not yet a set), and how many each document has before it."""
    data = lower_ascii(data)
    s, e, first = words(data, offs)
    w = word_hash(data, s, e)
    mult = mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    n = np.diff(first)
    out = np.zeros(max(0, len(w) - k + 1), np.uint64)
    for j in range(k):
        out += w[j : j + len(out)] * mult[j]
    inside = np.zeros(len(out), bool)
    doc = np.repeat(np.arange(len(n)), n)
    inside[:] = doc[: len(out)] == doc[k - 1 : k - 1 + len(out)]
    each = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    at = np.r_[0, np.cumsum(each)]
    full = np.zeros(at[-1], np.uint64)
    long_ = np.repeat(n >= k, each)
    full[long_] = mix(out[inside])
    for d in np.flatnonzero((n > 0) & (n < k)).tolist():
        h = np.uint64(n[d])
        for x in w[first[d] : first[d + 1]]:
            h = mix(np.array([h * mult[0] + x]))[0]
        full[at[d]] = h
    return full, at


def sets(data: np.ndarray, offs: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    h, at = shingles(data, offs, k)
    a = at.tolist()
    return [np.unique(h[x:y]) for x, y in zip(a, a[1:], strict=False)]


def vertex(s: np.ndarray) -> int | None:
    """An identifier of the set: equal sets are one vertex."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the number of tokens by their hash modulo BITMAP: two sets differ by as many tokens at least as their bitmaps by bits."""
    return np.packbits(np.bincount((s % np.uint64(BITMAP)).astype(np.int64), minlength=BITMAP) & 1).view(np.int64)


# ---------------------------------------------------------------- prefixes and combinations


def spare(n: int, other: int, percent: int) -> int:
    """Tokens that a set of n may have beyond those it shares with one of at least `other`, if they link."""
    return n - -(-percent * (n + other) // (100 + percent))


def loosest(n: int, percent: int) -> int:
    """spare() for a partner of any size: it then holds nothing but the shared tokens."""
    return n - -(-percent * n // 100)


def size_bounds(percent: int) -> np.ndarray:
    """Least sizes of the classes of sizes: two classes lie between a size and the largest that it may link with."""
    steps = np.arange(int(np.log(1 << 40) / np.log(100 / percent) * 2) + 1)
    return np.unique(np.ceil((100 / percent) ** (steps / 2)).astype(np.int64))


def signatures(tokens: np.ndarray, df: np.ndarray, n: int, percent: int, bounds: np.ndarray) -> np.ndarray:
    """The index entries of a set of n tokens, of which those that other sets have too are given, with their number of sets.

    A set writes entries for every class of sizes that a partner may be of; both classes are part of an entry. Tokens are ordered by number
    of sets, then by hash, those of no other set first. The partner has all but `spare` of the tokens. So any first part
    of the order in which destroying every entry takes more than `spare` tokens holds a common entry: a rare token is an
    entry by itself; of the x tokens of a group of class k, all combinations of k are entries, and x - k + 1 must go
    to destroy them. The prefix is extended until that sum exceeds `spare`. Of two sets that link, the one whose prefix ends first
    shares an entry by this, and the other's prefix holds it. What groups there are depends on the classes of sizes alone; they are so few that
    a whole set of any size in its class reaches the sum.
    """
    order = np.lexsort((tokens, df))
    tokens, df = tokens[order], df[order]
    own = int(np.searchsorted(bounds, n, side="right")) - 1
    low = int(np.searchsorted(bounds, -(-n * percent // 100), side="right")) - 1
    high = int(np.searchsorted(bounds, n * 100 // percent, side="right")) - 1
    out = []
    for other in range(low, high + 1):
        least = max(int(bounds[other]), -(-n * percent // 100))
        left = spare(n, least, percent) + 1 - (n - len(tokens))
        if left <= 0:
            continue
        large = int(bounds[max(own, other)])
        salt = mix(np.array([min(own, other) << 20 | max(own, other)], np.uint64))
        k = np.ones(len(tokens), np.int64)
        if large >= SMALL and percent >= 50:
            for c in range(1, MOST_K):
                k += df > RARE**c
        groups = np.where(k > 1, np.maximum(1, large // (GROUP * k)), 1 << 40)
        group = (mix(tokens ^ salt) % groups.astype(np.uint64)).astype(np.int64) * MOST_K + k - 1
        order = np.argsort(group, kind="stable")
        g = group[order]
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
        rank = np.empty(len(g), np.int64)
        rank[order] = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)]))
        gain = np.cumsum((rank >= k - 1) | (k == 1))
        take = int(np.searchsorted(gain, left)) + 1
        single = k[:take] == 1
        out.append(mix(tokens[:take][single] ^ salt))
        order = np.argsort(group[:take], kind="stable")
        order = order[~single[order]]
        g = group[:take][order]
        bound = np.flatnonzero(np.r_[True, g[1:] != g[:-1], True]).tolist() if len(g) else []
        for a, b in zip(bound, bound[1:], strict=False):
            of = np.sort(tokens[order[a:b]])
            if k[order[a]] == 2:
                i, j = np.triu_indices(b - a, 1)
                out.append(mix(mix(of[i] ^ salt) + of[j]))
            elif b - a > 2:
                i, j, h = np.array([(x, y, z) for x in range(b - a) for y in range(x) for z in range(y)]).T
                out.append(mix(mix(mix(of[h] ^ salt) + of[j]) + of[i]))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


# ---------------------------------------------------------------- stages


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _membership(rows: DataFrame, k: int, percent: int, table: Table) -> DataFrame:
    """doc_id, n, v of every row, and the extended prefix by hash of each set, once at least, null elsewhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int | None] = {None}
        for batch, data, offs in text_views(batches):
            own = sets(data, offs, k)
            v = [vertex(s) for s in own]
            if len(seen) > SEEN:
                seen = {None}
            prefix = []
            for s, x in zip(own, v, strict=True):
                prefix.append(None if x in seen else s[: loosest(len(s), percent) + 1 + int(EXTENDED * len(s))].view(np.int64))
                seen.add(x)
            cols = [batch.column(0), pa.array(map(len, own), pa.int64()), pa.array(v, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "v", "prefix"])

    return table(rows.mapInArrow(run, "doc_id bigint, n bigint, v bigint, prefix array<bigint>"), "membership")


def _recurring(members: DataFrame, percent: int, table: Table) -> DataFrame:
    """v of the sets that may have a partner by their extended prefix: all but loosest() of its tokens are in others' too.

    A partner that shares all but d tokens of a set has at least p - d of its first p in its own first p + d. A task
    may write a set that another task has written too, so a set's tokens are counted as often as it is written.
    """
    written = members.where("prefix IS NOT NULL")
    entries = written.select("v", F.explode("prefix").alias("token"))
    shared = entries.groupBy("token").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where("lo <> hi").select("token")
    hits = entries.join(shared, "token").groupBy("v").agg(F.count("*").alias("hits"))
    each = written.groupBy("v").agg(F.first("n").alias("n"), F.count("*").alias("times"), F.first(F.size("prefix")).alias("p"))
    most = F.col("n") - F.ceil(F.col("n") * percent / 100)
    return table(each.join(hits, "v").where(F.col("hits") >= F.col("times") * (F.col("p") - most)).select("v"), "recurring")


def _tokens(rows: DataFrame, members: DataFrame, wanted: DataFrame, k: int, table: Table) -> DataFrame:
    """v, n, tokens, b0.. (the bitmap's words) of the wanted sets, from one document of each."""
    ids = table(members.select("v", "doc_id").join(wanted, "v", "left_semi").groupBy("v").agg(F.min("doc_id").alias("doc_id")), "ids")
    few = ids.count() <= MOST_IDS
    maybe = F.broadcast if few else lambda df: df
    near = rows.join(maybe(ids.where("doc_id IS NOT NULL").select("doc_id").distinct()), "doc_id", "left_semi").unionAll(rows.where("doc_id IS NULL"))
    names = [f"b{j}" for j in range(BITMAP // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offs in text_views(batches):
            own = [s for s in sets(data, offs, k) if len(s)]
            if own:
                bits = np.array([bitmap(s) for s in own])
                cols = [pa.array(map(vertex, own), pa.int64()), pa.array(map(len, own), pa.int64()), pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(bits[:, j].copy()) for j in range(len(names)))], names=["v", "n", "tokens", *names])

    got = near.where("text IS NOT NULL").mapInArrow(run, "v bigint, n bigint, tokens array<bigint>, " + ", ".join(f"{x} bigint" for x in names))
    return table(got.join(maybe(ids.select("v")), "v", "left_semi").dropDuplicates(["v"]), "sets")


def _postings(own: DataFrame, percent: int, table: Table) -> tuple[DataFrame, DataFrame]:
    """(sig, v) for each entry that different sets share, and (v, score): how widely the tokens of a set are shared.

    The number of sets that have a token is exact. A set with more tokens of its own than any link allows writes nothing. Of
    entries that the same sets share, one stays: it brings together the pairs that all of them would. They are told by number, least,
    largest, and two 64-bit hashes of their sets.
    """
    each = own.select("v", F.explode("tokens").alias("token"))
    df = each.groupBy("token").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    back = each.join(df, "token").groupBy("v").agg(F.collect_list("token").alias("tokens"), F.collect_list("df").alias("df"), F.sum("df").alias("score"))
    most = F.col("n") - F.ceil(F.col("n") * percent / 100)
    back = table(back.join(own.select("v", "n"), "v").where(F.size("tokens") >= F.col("n") - most), "tokens")
    bounds = size_bounds(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            lists = [(c.flatten().to_numpy(), c.offsets.to_numpy() - c.offsets[0].as_py()) for c in (r.column(2), r.column(3))]
            sigs = []
            for i, n in enumerate(r.column(1).to_pylist()):
                (tokens, at), (df, _) = lists
                sigs.append(signatures(tokens[at[i] : at[i + 1]].view(np.uint64), df[at[i] : at[i + 1]], n, percent, bounds))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(r.column(0).to_numpy(), [len(s) for s in sigs]))], names=["sig", "v"])

    entries = table(back.select("v", "n", "tokens", "df").mapInArrow(run, "sig bigint, v bigint"), "entries")
    same = {"lo": F.min("v"), "hi": F.max("v"), "c": F.count("*"), "h0": F.bit_xor(F.xxhash64("v")), "h1": F.bit_xor(F.xxhash64("v", F.lit(1)))}
    shared = entries.groupBy("sig").agg(*(e.alias(name) for name, e in same.items())).where("lo <> hi").groupBy(*same).agg(F.min("sig").alias("sig")).select("sig")
    return table(entries.join(shared, "sig"), "postings"), back.select("v", (F.col("score") / F.col("n")).alias("score"))


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether sizes and bitmaps of the sides named x and y allow a link; no pair that links is ruled out."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = sum((F.bit_count(F.col(f"{x}.b{j}").bitwiseXOR(F.col(f"{y}.b{j}"))) for j in range(BITMAP // 64)), F.lit(0))
    return (F.least(nx, ny) * 100 >= F.greatest(nx, ny) * percent) & ((nx + ny - differ) * (100 + percent) >= (nx + ny) * (2 * percent))


def _verified(pairs: DataFrame, own: DataFrame, percent: int, table: Table) -> DataFrame:
    """The pairs (a, b) that link, by their sets."""
    p = pairs.join(own.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("x")), "a").join(own.select(F.col("v").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return table(p.where(both * 100 >= (F.col("na") + F.col("nb") - both) * percent).select("a", "b"), "edges")


def _draw(labelled: DataFrame, own: DataFrame, rank: Column, percent: int, table: Table) -> DataFrame:
    """Pairs (a, b): each set with one set of another component that it shares an entry with, the one that ranks highest among its entries' highest."""
    top = labelled.groupBy("sig").agg(F.max(F.struct(rank.alias("r"), "v", "label")).alias("x"))
    one = labelled.join(top, "sig").where(F.col("label") != F.col("x.label")).groupBy("v").agg(F.max("x").alias("x"))
    bits = own.drop("tokens")
    pairs = table(one.select(F.col("v").alias("a"), F.col("x.v").alias("b")), "drawn")
    x = pairs.join(bits.alias("x"), F.col("a") == F.col("x.v")).join(bits.alias("y"), F.col("b") == F.col("y.v"))
    return table(x.where(_may_link("x", "y", percent)).select("a", "b"), "likely")


def _across(labelled: DataFrame, own: DataFrame, percent: int, table: Table) -> DataFrame:
    """All pairs (a, b) of sets in different components that share an entry and that sizes and bitmaps allow.

    Entries all of whose sets are of one component are closed. In the others every set outside the component that
    most of the entry's sets are of meets all sets of the entry; the join's condition holds the bitmaps, so only likely pairs leave it.
    Near copies share most of their entries: a pair is left to the first of those that both sets carry.
    """
    sums = labelled.groupBy("sig", "label").agg(F.count("*").alias("c")).groupBy("sig").agg(F.max_by("label", "c").alias("main"), F.count("*").alias("labels")).where("labels > 1").select("sig", "main")
    opened = table(labelled.join(sums, "sig"), "opened")
    least = opened.groupBy("v").agg(F.slice(F.sort_array(F.collect_set("sig")), 1, LEAST).alias("least"))
    full = table(opened.join(own.drop("tokens").join(least, "v"), "v"), "open")
    on = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.label") != F.col("y.label")) & ((F.col("y.label") == F.col("y.main")) | (F.col("x.v") < F.col("y.v")))
    # the first entry of both is never after one that both carry, so no pair is lost
    first = F.coalesce(F.array_min(F.array_intersect("x.least", "y.least")) >= F.col("x.sig"), F.lit(True))
    pairs = full.where("label <> main").alias("x").join(full.alias("y"), on & _may_link("x", "y", percent) & first)
    return table(pairs.select(F.least("x.v", "y.v").alias("a"), F.greatest("x.v", "y.v").alias("b")).distinct(), "likely")


def linked_sets(rows: DataFrame, members: DataFrame, k: int, percent: int) -> DataFrame:
    """v, label: the components of the sets that have links at all.

    Sets most of whose tokens are in no other set go first. Then each set is checked against one other of its entries at
    a time, a widely shared one to begin with: groups of near copies come together with as many pairs as sets. At last all pairs
    across the components are checked. A pair within one component cannot change the components, so none is lost.
    """
    with storage.scratch(rows.sparkSession) as table:
        own = _tokens(rows, members, _recurring(members, percent, table), k, table)
        post, score = _postings(own, percent, table)
        edges, label = None, None
        for turn in range(ROUNDS + 1):
            labelled = post.withColumn("label", F.col("v")) if label is None else post.join(label, "v", "left").withColumn("label", F.coalesce("label", "v"))
            if turn < ROUNDS:
                rank = F.col("score") if turn == 0 else F.xxhash64("v", F.lit(turn))
                pairs = _draw(labelled.join(score, "v"), own, rank, percent, table)
            else:
                pairs = _across(labelled, own, percent, table)
            found = _verified(pairs, own, percent, table)
            if turn < ROUNDS or found.limit(1).count():
                edges = found if edges is None else table(edges.unionAll(found), "edges")
                label = components(edges)
        return label


def jaccard_links(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, v) of every row, v null for empty sets, and every linked pair (a, b) of different sets, a < b.

    The number of links of a group of near copies is the square of its size: this is for tables where such groups are small;
    components() of the links, or jaccard_components, which needs no such pairs, suit the rest.
    """
    rows = _rows(docs)
    members = _membership(rows, k, percent, storage.table)
    with storage.scratch(docs.sparkSession) as table:
        own = _tokens(rows, members, _recurring(members, percent, table), k, table)
        post, _ = _postings(own, percent, table)
        labelled = post.withColumn("label", F.col("v"))
        return members.select("doc_id", "v"), storage.table(_verified(_across(labelled, own, percent, table), own, percent, table), "links")


def jaccard_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, n_same (rows with exactly its set) for every row of docs.

    A row whose text is null or without words has an empty set, links with nothing and is its own component. A null
    doc_id takes part like any other, and its component is named by the smallest identifier that isn't null; if there is
    none, the name is null. Rows that repeat an identifier are rows of their own. An empty table gives no rows; other
    columns are ignored. Equal sets are one vertex, so copies cost nothing beyond the first pass. A text of any length is
    one set, held whole by a task, with 8 bytes a shingle.
    """
    rows = _rows(docs)
    members = _membership(rows, k, percent, storage.table)
    m = members.join(linked_sets(rows, members, k, percent), "v", "left").withColumn("c", F.coalesce("label", "v"))
    same = m.where("v IS NOT NULL").groupBy("v", "c").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_same"))
    same = storage.table(same, "same")
    names = same.join(same.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("v", "component_id", "n_same")
    out = members.where("v IS NOT NULL").join(names, "v").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_same")
    return out.unionAll(members.where("v IS NULL").select("doc_id", "n", "doc_id", F.lit(1).cast("bigint")))


def one_of_each(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns as they are, without those of a set whose component has a row before it.

    A component keeps the row of its smallest doc_id (a null one comes last) and, where several sets have that
    identifier, of its smallest set; equal rows that tie in both are kept once. Rows without words (null or empty texts) all stay. Long
    texts are handled whole, an empty table stays empty, and no column of docs clashes with those added meanwhile.
    """
    rows = _rows(docs)
    members = _membership(rows, k, percent, storage.table)
    label = linked_sets(rows, members, k, percent)
    m = members.where("v IS NOT NULL").select("doc_id", "v").join(label, "v", "left").withColumn("c", F.coalesce("label", "v"))
    each = m.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "v")).alias("stay"), F.count("*").alias("rows"))
    # rows to take out, by identifier and set: all of the component but the one that stays, and that one's repetitions
    out = m.join(each.where("rows > 1"), "c").groupBy("doc_id", "v").agg(F.first("stay").alias("stay"), F.count("*").alias("same"))
    out = out.withColumn("stays", F.col("stay.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("stay.v") == F.col("v")))
    key, x_id, x_v, stays = (storage.PREFIX + name for name in ("v", "x_id", "x_v", "stays"))
    out = storage.table(out.where("NOT stays OR same > 1").select(F.col("doc_id").alias(x_id), F.col("v").alias(x_v), F.col("stays").alias(stays)), "out")
    few = out.count() <= MOST_IDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offs in text_views(batches):
            v = pa.array(map(vertex, sets(data, offs, k)), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, v], names=[*batch.schema.names, key])

    keyed = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(key, T.LongType())]))
    on = F.col("doc_id").eqNullSafe(F.col(x_id)) & (F.col(key) == F.col(x_v))
    kept = keyed.join(F.broadcast(out) if few else out, on, "left").where(F.col(x_v).isNull() | F.col(stays))
    again = kept.where(stays).dropDuplicates(["doc_id", key])
    return kept.where(F.col(x_v).isNull()).unionAll(again).select(*docs.columns)
