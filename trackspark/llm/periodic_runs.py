"""Runs of words in texts by Kolpakov and Kucherov's way: LZ factors, Main's search at their borders, copies for the rest.

A run is a stretch of words with smallest period q that no neighbouring word extends. The factors come from a suffix automaton:
each is a new word, or the longest stretch that also starts earlier (overlaps allowed). A run that touches a border between
factors reaches a bounded way to its left, so Main's common prefixes and suffixes around the border find it in time in
proportion to the two factors. A run that touches none lies strictly inside one factor, and is a copy of one found where the
factor occurs first.

Only stretches where every string of GRAM words occurs twice in its text are factorised: a run of LEAST words or more and TIMES
periods or more lies in one of them, whole, and its words beyond do not carry on its period.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .textbytes import BASE, mix, runs, text_views, word_hash, words

#: A run has so many words, and so many periods, at least.
LEAST, TIMES = 24, 3
#: Words of a string: each one within a run of n words and period q has a copy q words off, within the run too, if n >= 2 * q + GRAM - 1.
GRAM_STEPS = (1, 2, 4)
GRAM = 1 + sum(GRAM_STEPS)
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


# ---------------------------------------------------------------- one sequence


class Automaton:
    """The suffix automaton of a list of small integers; of each state the end of its strings' first occurrence.

    A state's first transition lies in two arrays and only further ones in a dictionary, as most states have one.
    """

    def __init__(self, s: list[int]) -> None:
        self.letter, self.target, self.first, self.more = array("i", [-1]), array("i", [-1]), array("i", [-1]), {}
        link, length, last = array("i", [-1]), array("i", [0]), 0
        letter, target, first, more = self.letter, self.target, self.first, self.more
        for i, c in enumerate(s):
            new = len(length)
            length.append(i + 1), first.append(i), link.append(0), letter.append(-1), target.append(-1)
            p, q = last, -1
            while p >= 0:
                if letter[p] < 0:
                    letter[p], target[p] = c, new
                elif (q := target[p] if letter[p] == c else more[p].get(c, -1) if p in more else -1) >= 0:
                    break
                else:
                    more.setdefault(p, {})[c] = new
                p = link[p]
            if p >= 0 and length[q] == length[p] + 1:
                link[new] = q
            elif p >= 0:
                twin = len(length)
                length.append(length[p] + 1), first.append(first[q]), link.append(link[q]), letter.append(letter[q]), target.append(target[q])
                if q in more:
                    more[twin] = dict(more[q])
                while p >= 0 and self.step(p, c) == q:
                    if letter[p] == c:
                        target[p] = twin
                    else:
                        more[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
            last = new

    def step(self, state: int, c: int) -> int:
        return self.target[state] if self.letter[state] == c else self.more[state].get(c, -1) if state in self.more else -1


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, where it starts first) of the LZ factors of s; a new letter has -1."""
    states, out, at = Automaton(s), [], 0
    while at < len(s):
        state, n = 0, 0
        while at + n < len(s):
            to = states.step(state, s[at + n])
            if states.first[to] - n >= at:
                break
            state, n = to, n + 1
        out.append((at, n, states.first[state] - n + 1) if n else (at, 1, -1))
        at += max(n, 1)
    return out


def _shared(s: list[int]) -> list[int]:
    """The length that each suffix of s shares with s from the start; 0 for s itself."""
    out, left, right = [0] * len(s), 0, 0
    for i in range(1, len(s)):
        n = min(right - i, out[i - left]) if i < right else 0
        while i + n < len(s) and s[n] == s[i + n]:
            n += 1
        out[i] = n
        if i + n > right:
            left, right = i, i + n
    return out


def _at_border(s: list[int], lo: int, at: int, hi: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the repetitions within s[lo:hi] that touch `at`, each as long as it goes there."""
    t, u = s[lo:at], s[at:hi]
    back_t, back_u = t[::-1], u[::-1]
    ahead, back = _shared([*u, -1, *t, *u]), _shared([*back_t, -1, *back_u, *back_t])
    for p in range(1, (hi - lo) // times + 1):
        need = max(least, times * p)
        if p <= len(u):  # words from the border on, against those a period later
            a, b = ahead[p] if p < len(u) else 0, back[len(t) + 1 + len(u) - p]
            if a + b + p >= need:
                yield at - b, at + p + a, p
        if p <= len(t):  # words of the period before the border, against those from it on
            a, b = ahead[len(u) + 1 + len(t) - p], back[p] if p < len(t) else 0
            if a + b + p >= need:
                yield at - p - b, at + a, p


def sequence_runs(s: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of s with `least` words and `times` periods (at least two) or more, by start, then period."""
    n, found, starts, cut = len(s), {}, [], factors(s)

    def add(b: int, e: int, p: int) -> None:
        ends = found.get(b)
        if ends is None:
            found[b] = {e: p}
            insort(starts, b)
        else:
            ends[e] = min(p, ends.get(e, p))  # a period's multiples give the same run

    for k in range(1, len(cut) + 1):
        at, length, source = cut[k] if k < len(cut) else (n, 0, -1)
        lo, hi = max(0, at - 2 * cut[k - 1][1] - length), at + length
        if hi - lo >= least:
            for b, e, p in _at_border(s, lo, at, hi, least, times):
                # what goes on beyond the window belongs to another border
                if not (b == lo > 0 and s[b - 1] == s[b - 1 + p] or e == hi < n and s[e] == s[e - p]):
                    add(b, e, p)
        if source >= 0 and length > least:
            i = bisect_right(starts, source)
            while i < len(starts) and starts[i] < source + length:  # copies may be copied again: the factor may overlap its source
                for e, p in list(found[starts[i]].items()):
                    if e < source + length:
                        add(starts[i] + at - source, e + at - source, p)
                i += 1
    return sorted((b, e - b, p) for b, ends in found.items() for e, p in ends.items())


# ---------------------------------------------------------------- texts


def _twice(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (in words) of the stretches whose strings of GRAM words all occur twice in their text; long enough for a run."""
    n = len(hashes)
    if n < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g = hashes
    for step in GRAM_STEPS:
        g = mix(g[:-step] * BASE ^ g[step:])
    text = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    whole = np.flatnonzero(text[: len(g)] == text[GRAM - 1 :])
    key = mix(g[whole] ^ (text[whole] + np.uint64(1)) * BASE)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n, bool)
    twice[whole[order[1:][same]]] = twice[whole[order[:-1][same]]] = True
    s, e = runs(twice, first)
    long = e - s >= LEAST - GRAM + 1
    return s[long], e[long] + GRAM - 1


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b, data, offs in text_views(batches):
        start, end, first = words(data, offs)
        spans: dict[int, list[tuple[int, int, int]]] = {}
        s, e = _twice(word_hash(data, start, end), first)
        for x, y in zip(s.tolist(), e.tolist(), strict=True):
            names: dict[bytes, int] = {}
            got = sequence_runs([names.setdefault(data[start[i] : end[i]].tobytes(), len(names)) for i in range(x, y)])
            if got:
                d = int(np.searchsorted(first, x, "right")) - 1
                spans.setdefault(d, []).extend((r + x - int(first[d]), n, p) for r, n, p in got)
        out, o = [], offs.tolist()
        for d in range(b.num_rows):
            own = data[o[d] : o[d + 1]].tobytes().split()
            if d in spans:
                edge = np.zeros(len(own) + 1, np.int32)
                for r, n, p in spans[d]:
                    edge[r + p] += 1
                    edge[r + n] -= 1
                own = [own[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
            out.append(b" ".join(own))
        listed = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in sorted(spans.get(d, []))] for d in range(b.num_rows)]
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in b.schema.names if n != "text"), pa.array(listed, kind), pa.array(out, pa.binary()).cast(pa.string())], names=[*(n for n in b.schema.names if n != "text"), "runs", "collapsed"])


def collapse_runs(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, runs (start, length, period, in words), collapsed (the text's words, of each run only the first period) for every row of docs.

    Words are what lies between ASCII white space, and are compared by their bytes. Runs have LEAST words and TIMES periods or more, and
    are listed by start, then period. A null or empty text has no runs and collapses to the empty text; a null key is carried on; repeated rows are
    treated each; an empty table gives no rows; other columns are ignored whatever their names. A text is analysed whole, by
    one task, in time in proportion to its length; a stretch of n words that occurs twice takes some 200 n bytes of memory.
    """
    storage.bound_batches(docs.sparkSession)
    rows = docs.select(F.col(key), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_collapsed, f"`{key}` {rows.schema[key].dataType.simpleString()}, runs {RUNS}, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where each document whose crc32(doc_id as text) = h is divisible by 10 repeats words: with g = h / 10, from word a = g mod n on those of a to a + p - 1 in turn, p = 1 + (n - a) / (3 + g mod 8). A null doc_id leaves the text as it is."""
    own = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))
    marked = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("g", F.when(h % 10 == 0, F.floor(h / 10)))
    n = F.size(own)
    at = marked.withColumn("n", F.when(F.col("g").isNotNull(), n)).withColumn("a", F.expr("if(n > 0, cast(g % n as int), null)")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    head, tail = F.slice(own, 1, F.col("a")), F.slice(own, F.col("a") + 1, F.col("p"))
    again = F.flatten(F.array_repeat(tail, F.expr("cast((n - a) div p + 1 as int)")))
    return at.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.slice(F.concat(head, again), 1, F.col("n")), " ")).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period and exponent_milli of the run with the greatest length / period, runs_sha256, collapsed_sha256; cases as collapse_runs() and with_planted_runs() say."""
    got = collapse_runs(with_planted_runs(docs))
    more = "r.length * x.period - x.length * r.period"  # runs come by start, then period, so the first of equals is kept
    best = F.expr(f"aggregate(runs, runs[0], (x, r) -> if({more} > 0, r, x))")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    top = F.when(F.size("runs") > 0, best)
    return got.withColumn("top", top).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), *(F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * top.length div top.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
