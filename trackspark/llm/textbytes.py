"""Vectorised passes over the UTF-8 bytes of Arrow string columns: views, word bounds and hashes.

All hashes are functions of the bytes alone, so any two tasks give equal strings equal hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document is handled alone, whole.
CHUNK = 1 << 20

_RNG = np.random.Generator(np.random.PCG64(20240607))
#: One random 64-bit value per byte value.
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(int(BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 4096)
        out = np.full(size, BASE if kind == "up" else _BASE_INV)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if size > 4 * CHUNK:
            return out
        _powers[kind] = have = out
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xA0761D6478BD642F)
    x ^= x >> np.uint64(32)
    return x


def text_views(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for slices of at most `limit` bytes of text or one row; a null text counts as empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        if col.null_count:
            col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) else "")
        col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
        offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
        at = 0
        while at < len(col):
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at), data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
            at = to


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with len(data)+1 entries, for span_hash."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * _power("up", len(data))[: len(data)], out=out[1:])
    return out


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span; it depends on the bytes only."""
    return mix((h[end] - h[start]) * _power("down", len(h))[start])


#: The low bytes of a block that belong to a span with so many bytes left.
_LEFT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a span from which a digest of the span takes the place of blocks in turn.
_LONG = 4096


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, its blocks of eight bytes mixed in one after the other.

    For words and pieces: unlike span_hash it is no polynomial, so no two texts are known to collide, but it takes time in
    proportion to the spans' bytes.
    """
    n = end - start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    block = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    out = n.astype(np.uint64) * BASE
    live, k = np.flatnonzero(n < _LONG), 0
    while len(live):
        out[live] = mix(out[live] * BASE ^ (block[start[live] + k] & _LEFT[np.minimum(n[live] - k, 8)]))
        k += 8
        live = live[n[live] > k]
    for i in np.flatnonzero(n >= _LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def same_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> np.ndarray:
    """Whether each span of the first kind has the same bytes as that of the second, eight at a time."""
    n = end - start
    same = n == end_b - start_b
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    block = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    live, k = np.flatnonzero(same & (start != start_b) & (n < _LONG)), 0
    while len(live):
        same[live] = (block[start[live] + k] ^ block[start_b[live] + k]) & _LEFT[np.minimum(n[live] - k, 8)] == 0
        k += 8
        live = live[same[live] & (n[live] > k)]
    for i in np.flatnonzero(same & (start != start_b) & (n >= _LONG)).tolist():
        same[i] = np.array_equal(data[start[i] : end[i]], data[start_b[i] : end_b[i]])
    return same


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[ord("A") : ord("Z") + 1] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _UPPER[data]


def runs(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True, cut at document bounds."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs outside \\x20 \\x09-\\x0D, and each document's first word (one entry more than documents)."""
    s, e = runs(~_SPACE[data], offs)
    return s, e, np.searchsorted(s, offs)
