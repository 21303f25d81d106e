"""Language identification by mixture inference: proportions by expectation-maximisation over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage
from .ngram_counts import count_grams
from .textbytes import runs, text_views

BUCKETS = 1 << 16
SMOOTH = 0.05
#: Words of one unit; a unit is in one language.
UNIT = 4
STEPS = 20
UNDETERMINED = "und"

_LOW = np.full(256, 32, np.uint8)
_LOW[97:123] = np.arange(97, 123)
_LOW[65:91] = np.arange(97, 123)
_LOW[128:] = np.arange(128, 256)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[97:123] = True


def _letters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes with all else a space; starts and ends of words."""
    low = _LOW[data]
    return low, *runs(low != 32, offs)


def _trigrams(low: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of each word with a space on either side, and how many each word has before it."""
    size = e - s + 2
    to = np.cumsum(size)
    padded = np.full(int(to[-1]) + 2 if len(to) else 2, 32, np.uint32)
    at = np.arange(int(to[-1]) if len(to) else 0) - np.repeat(to - size, size)  # place within the padded word
    inside = (at > 0) & (at < np.repeat(size - 1, size))
    padded[: len(at)][inside] = low[np.repeat(s, size)[inside] + at[inside] - 1]
    code = padded[:-2] << 16 | padded[1:-1] << 8 | padded[2:]
    code = (code * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64)
    keep = at < np.repeat(size - 2, size)  # a trigram does not leave its word
    return code[keep], np.r_[0, np.cumsum(size - 2)]


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, s, e = _letters(data, offs)
    code, at = _trigrams(low, s, e)
    return code, np.repeat(np.arange(len(offs) - 1), np.diff(at[np.searchsorted(s, offs)]))


class Mixture:
    """Log-likelihoods of trigrams by language, and inference of a document's set of languages and their shares."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = list(counts)
        c = np.array([counts[g] for g in self.langs], float).reshape(len(self.langs), BUCKETS) + SMOOTH
        self.table = np.ascontiguousarray(np.log(c / c.sum(axis=1, keepdims=True)).T)  # bucket x language

    def units(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each unit of UNIT words by language, and how many units each document has before it."""
        low, s, e = _letters(data, offs)
        code, at = _trigrams(low, s, e)
        first = np.searchsorted(s, offs)  # each document's first word
        n = -(-np.diff(first) // UNIT)
        bounds = np.r_[0, np.cumsum(n)]
        k = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n)
        begin = at[np.repeat(first[:-1], n) + k * UNIT]
        if not len(begin):
            return np.zeros((0, len(self.langs))), bounds
        return np.add.reduceat(self.table[code], begin, axis=0), bounds

    @staticmethod
    def _em(ll: np.ndarray, doc: np.ndarray, first: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares and log-likelihood of each document when only the masked languages may occur."""
        pi = mask / mask.sum(axis=1, keepdims=True)
        top = ll.max(axis=1, keepdims=True)
        p = np.exp(np.maximum(ll - top, -600))
        units = np.add.reduceat(np.ones(len(ll)), first)[:, None]
        for _ in range(STEPS):
            r = p * pi[doc]
            r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
            pi = np.add.reduceat(r, first, axis=0) / units
        total = np.log(np.maximum((p * pi[doc]).sum(axis=1), 1e-300)) + top[:, 0]
        return pi, np.add.reduceat(total, first)

    def infer(self, ll: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Each document's shares of the languages in the set of highest penalised likelihood; zeros without units.

        The penalty is half the log of the number of units for each language beyond the first. No set of two or more
        can beat the best single language unless all languages together beat it by the penalty of two; only for
        such documents are languages taken out one by one, the least share first.
        """
        n, langs = len(bounds) - 1, len(self.langs)
        shares = np.zeros((n, langs))
        has = np.flatnonzero(np.diff(bounds))
        if not len(has) or not langs:
            return shares
        count = np.diff(bounds)[has]
        first = np.r_[0, np.cumsum(count)[:-1]]
        single = np.add.reduceat(ll, first, axis=0)
        best = single.max(axis=1)
        shares[has, single.argmax(axis=1)] = 1.0
        penalty = 0.5 * np.log(np.maximum(count, 2))
        # a bound that needs no iterations: each unit in its own best language
        open_ = np.flatnonzero(np.add.reduceat(ll.max(axis=1), first) - penalty > best)
        if not len(open_) or langs == 1:
            return shares
        rows = np.repeat(np.isin(np.arange(len(has)), open_), count)
        ll, count, best, penalty, who = ll[rows], count[open_], best[open_], penalty[open_], has[open_]
        mask = np.ones((len(who), langs))
        for size in range(langs, 1, -1):
            first, doc = np.r_[0, np.cumsum(count)[:-1]], np.repeat(np.arange(len(who)), count)
            pi, total = self._em(ll, doc, first, mask)
            good = total - (size - 1) * penalty > best
            best = np.where(good, total - (size - 1) * penalty, best)
            shares[who[good]] = pi[good]
            go = total - penalty > best - (size - 1) * penalty if size > 2 else np.zeros(len(who), bool)
            if not go.any():
                break
            ll, mask, pi = ll[go[doc]], mask[go], pi[go]
            count, best, penalty, who = count[go], best[go], penalty[go], who[go]
            mask[np.arange(len(who)), np.where(mask > 0, pi, np.inf).argmin(axis=1)] = 0
        return shares


def train(docs: DataFrame, lang: Column) -> Mixture:
    """Counts the trigrams of every row whose lang isn't null."""
    return Mixture(count_grams(docs, lang, grams, BUCKETS))


SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, langs string"


def predict(docs: DataFrame, model: Mixture, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of lang_pred in the document), langs (the set, largest share first).

    lang_pred is UNDETERMINED with score 0 for a null text, one without a letter, or without any language learned.
    Only the text is an input. One pass, no shuffle; repeated rows are answered alike, and other columns ignored.
    """
    storage.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages, at most ngram_counts.MOST_GROUPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rows, data, offs in text_views(batches):
            shares = m.infer(*m.units(data, offs)) if m.langs else np.zeros((rows.num_rows, 1))
            plain = np.r_[0, np.cumsum(_ASCII_LETTER[_LOW[data]])]
            sure = np.diff(plain[offs]) > 0
            texts = rows.column(2)
            pred, score, sets = [], [], []
            order = np.argsort(-shares, axis=1, kind="stable")
            for k, row in enumerate(shares):
                if not m.langs or not row.any() or not (sure[k] or any(map(str.isalpha, texts[k].as_py() or ""))):
                    pred, score, sets = [*pred, UNDETERMINED], [*score, 0.0], [*sets, ""]
                    continue
                top = order[k]
                pred.append(m.langs[top[0]])
                score.append(float(min(1.0, row[top[0]])))
                sets.append(",".join(m.langs[j] for j in top if row[j] > 0))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())], names=[c.split()[0] for c in SCHEMA.split(", ")])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def fold() -> Column:
    """Whether crc32 of doc_id as text leaves 2 on division by 4; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows outside the fold that have a text and a lang, then answers every row.

    A null or empty text, or one without letters, is `und` with score 0; a null doc_id is outside the fold; repeated rows answer alike; an empty
    table gives no rows; other columns, whatever their names, are ignored; long texts are read whole. Every language is a dense
    vector of counts (512 KB) on the driver and in each task, so more than ngram_counts.MOST_GROUPS languages raise ValueError
    rather than lose some.
    """
    model = train(docs.where(~fold()), F.col("lang"))
    return predict(docs, model, fold())
