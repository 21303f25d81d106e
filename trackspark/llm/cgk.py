"""CGK embeddings of byte strings and bit samples of them: strings of small edit distance meet in some sample."""

from __future__ import annotations

import numpy as np

from .textbytes import mix

#: Bytes that one walk reads, and its steps: a walk moves on at about every second.
STRETCH = 128
STEPS = 2 * STRETCH - 2
#: Samples of a walk, and symbols of a sample.
SAMPLES, BITS = 24, 4
_SEED = 20240611


class Walks:
    """Random walks over strings, each over a stretch of its own, and the steps that samples take from them.

    A walk reads a string's symbols in turn; at each step it writes the symbol that it stands on, and a random bit for the
    step and the symbol says whether it moves on. Two walks that an edit has brought apart meet again by chance, so
    few edits change few steps. A walk's numbers depend on its own number, not on how many are drawn.
    """

    def __init__(self, walks: int):
        rng = [np.random.default_rng([_SEED, w]) for w in range(walks)]
        #: By walk and step, an odd factor; the highest bit of its product with the symbol moves the walk on.
        self.factor = np.array([r.integers(0, 2**63, STEPS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for r in rng])
        self.offset = np.array([r.random() for r in rng])
        self.step = np.array([r.random((SAMPLES, BITS)) for r in rng])

    def hashes(self, x: np.ndarray, start: np.ndarray, low: np.ndarray, high: np.ndarray, length: np.ndarray) -> np.ndarray:
        """(windows, walks * samples): hashes of the samples of the windows x[start : start + length]; what lies outside low to high reads as the nearest end."""
        stretch = np.minimum(length, STRETCH)
        at = start[:, None] + (self.offset * (length - stretch + 1)[:, None]).astype(np.int64)
        stop = np.minimum(at + stretch[:, None], high[:, None])
        at = np.maximum(at, low[:, None])
        symbols = np.append(x, 0).astype(np.uint64)
        seen = np.empty((STEPS, *at.shape), np.uint8)
        for j in range(STEPS):
            symbol = symbols[np.where(at < stop, at, len(x))]
            seen[j] = symbol
            at += ((symbol + np.uint64(1)) * self.factor[:, j] >> np.uint64(63)).astype(np.int64)
        out = np.empty((len(start), len(self.factor), SAMPLES), np.uint64)
        window, walk = np.arange(len(start))[:, None, None], np.arange(len(self.factor))[:, None]
        out[:] = np.arange(len(self.factor) * SAMPLES, dtype=np.uint64).reshape(-1, SAMPLES)
        for b in range(BITS):
            step = (self.step[None, :, :, b] * np.maximum(1, 2 * stretch - 2)[:, None, None]).astype(np.int64)
            out = mix(out + seen[step, window, walk] * np.uint64(0x9E3779B97F4A7C15))
        return out.reshape(len(start), len(self.factor) * SAMPLES)


def edited(text: bytes, edits: int, rng: np.random.Generator) -> bytes:
    """text after so many substitutions, insertions and deletions at random places."""
    out = bytearray(text)
    for kind, letter in zip(rng.integers(0, 3, edits).tolist(), rng.integers(97, 123, edits).tolist(), strict=True):
        at = int(rng.integers(0, max(1, len(out))))
        if kind == 0 and out:
            out[at] = letter
        elif kind == 1:
            out.insert(at, letter)
        elif out:
            del out[at]
    return bytes(out)
