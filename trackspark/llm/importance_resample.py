"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage
from .ngram_counts import count_grams
from .textbytes import mix, text_views, word_hash, words

BYTE_BUCKETS, PAIR_BUCKETS = 1 << 15, 1 << 10
BUCKETS = BYTE_BUCKETS + PAIR_BUCKETS
#: The bucket of all pairs of equal words; other pairs are hashed over the rest.
EQUAL_PAIR = BYTE_BUCKETS
#: n-grams worth of the raw model that the target model starts with, and zeros that each document's mean starts with.
PRIOR, SHRINK = 2000.0, 6.0
#: Labelled rows that the target model and the calibration are fitted on, at most: those of smallest hash.
LABELLED = 20_000
#: Passes of 1024 bins that find the k-th largest key.
PASSES = 5
SCORE = f"{storage.PREFIX}score"


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte trigrams and pairs of neighbouring words of each document."""
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    wide = data.astype(np.uint32)
    code = wide[:-2] << 16 | wide[1:-1] << 8 | wide[2:] if len(data) > 2 else np.zeros(0, np.uint32)
    inside = doc[: len(code)] == doc[2:] if len(code) else np.zeros(0, bool)
    code = (code * np.uint32(2654435761) >> np.uint32(17)).astype(np.int64)[inside]
    s, e, _ = words(data, offs)
    h = word_hash(data, s, e)
    of = doc[s] if len(s) else np.zeros(0, np.int64)
    both = of[1:] == of[:-1]
    pair = mix(h[:-1] * np.uint64(3) + h[1:]) % np.uint64(PAIR_BUCKETS - 1)
    pair = np.where(h[1:] == h[:-1], EQUAL_PAIR, EQUAL_PAIR + 1 + pair.astype(np.int64))[both]
    return np.r_[code, pair], np.r_[doc[: len(inside)][inside], of[1:][both]]


@dataclass
class Model:
    """Log ratio of target to raw by bucket, the calibration of a document's mean ratio, and the key of the k-th row."""

    ratio: np.ndarray
    slope: float = 0.0
    shift: float = 30.0
    least_key: float = -np.inf
    counts: dict[str, int] = field(default_factory=dict)

    @staticmethod
    def of(target: np.ndarray, raw: np.ndarray) -> Model:
        ratio = np.zeros(BUCKETS)
        for part in (slice(0, BYTE_BUCKETS), slice(BYTE_BUCKETS, BUCKETS)):
            r = (raw[part] + 1.0) / (raw[part].sum() + len(raw[part]))
            ratio[part] = np.log((target[part] + PRIOR * r) / (target[part].sum() + PRIOR) / r)
        return Model(ratio)

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The mean log ratio of the trigrams plus that of the pairs."""
        bucket, doc = grams(data, offs)
        n, at = len(offs) - 1, int((bucket < BYTE_BUCKETS).sum())  # trigrams come first
        out = np.zeros(n)
        for part in (slice(0, at), slice(at, len(bucket))):
            out += np.bincount(doc[part], self.ratio[bucket[part]], n) / (np.bincount(doc[part], minlength=n) + SHRINK)
        return np.round(out, 9)


def with_score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs and SCORE, from one pass without a shuffle."""
    storage.bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.ratio)  # BUCKETS doubles
    name = "text" if docs.schema["text"].dataType.typeName() == "string" else storage.PREFIX + "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(shared.value)
        for rows, data, offs in text_views(batches, name):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(m.score(data, offs))], names=[*rows.schema.names, SCORE])

    read = docs if name == "text" else docs.withColumn(name, F.col("text").cast("string"))
    return read.mapInArrow(run, T.StructType([*read.schema.fields, T.StructField(SCORE, T.DoubleType())])).drop(*{name} - {"text"})


def log_odds(model: Model) -> Column:
    return F.col(SCORE) * model.slope + model.shift


def key(model: Model, doc_id: str = "doc_id") -> Column:
    """Log odds plus Gumbel noise drawn from the identifier: the largest keys are a draw by odds without replacement."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit("gumbel"), doc_id), 11).cast("double") + 0.5) / float(1 << 53)
    return log_odds(model) - F.log(-F.log(u))


def labelled_sample(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """doc_id, quality (0 or 1) of at most `most` labelled documents; a document labelled twice has its lowest label."""
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("quality"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _calibrate(s: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the log odds of y given s: ridge logistic regression by Newton steps, on the sample's own scale."""
    if not len(s) or y.all() or not y.any():
        return 0.0, 30.0 if not len(s) or y.all() else -30.0
    mid, scale = s.mean(), s.std() + 1e-9
    x = np.c_[(s - mid) / scale, np.ones(len(s))]
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g, h = x.T @ (p - y) + 0.01 * w * (1, 0), (x * (p * (1 - p))[:, None]).T @ x + np.diag([0.01, 1e-6])
        w = w - np.clip(np.linalg.solve(h, g), -5, 5)
    slope = max(0.0, w[0] / scale)
    return float(slope), float(w[1] - slope * mid)


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """A value that k rows reach, by PASSES histograms; rows closer to it than a 2**50th of the range count with it."""
    lo, hi = rows.agg(F.min(column), F.max(column)).first()
    if lo is None or k <= 0:
        return np.inf
    above = 0
    for _ in range(PASSES):
        width = (hi - lo) / 1024
        if width <= 0 or lo + width == lo:
            break
        b = F.least(F.floor((F.col(column) - lo) / width), F.lit(1023))
        bins = dict(rows.where(F.col(column).between(lo, hi)).groupBy(b.alias("b")).count().collect())
        for j in range(1023, -1, -1):
            if above + bins.get(j, 0) >= k or j == 0:
                lo, hi = lo + j * width, min(hi, lo + (j + 1) * width)
                break
            above += bins.get(j, 0)
    return lo


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[Model, DataFrame]:
    """The model, and doc_id, SCORE, quality of every row of docs (a written table).

    The raw model counts all rows; the target model those of the labelled sample with quality 1; the calibration
    takes the sample's scores. k is the expected number of target-like rows, the sum of all posteriors.
    """
    sample = F.broadcast(labelled_sample(labels, most))  # at most `most` rows
    rows = docs.select("doc_id", "text").join(sample, "doc_id", "left")
    counts = count_grams(rows, F.when(F.col("quality") == 1, "target").otherwise("other"), grams, BUCKETS)
    none = np.zeros(BUCKETS, np.int64)
    target = counts.get("target", none)
    model = Model.of(target, target + counts.get("other", none))
    scored = storage.table(with_score(rows, model).select("doc_id", SCORE, "quality"), "scores")
    one = F.min(F.struct(SCORE, "quality")).alias("one")  # of rows that repeat an identifier that of the least score
    pairs = scored.where("quality IS NOT NULL").groupBy("doc_id").agg(one).select("doc_id", "one.*").orderBy("doc_id").limit(most).toPandas()
    model.slope, model.shift = _calibrate(pairs[SCORE].to_numpy(float), pairs["quality"].to_numpy(float))
    total, expected = scored.agg(F.count("*"), F.sum(1 / (1 + F.exp(-log_odds(model))))).first()
    k = round(expected or 0)
    model.counts = {"rows": total, "k": k}
    model.least_key = -np.inf if k >= total else kth_largest(scored.select(key(model).alias("k")), "k", k)
    return model, scored


def importance_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, log_ratio, score (posterior of being target-like), keep, for every row of docs.

    A null or empty text has no n-grams and mean 0; a null doc_id draws noise like any other; rows that repeat an
    identifier draw the same noise, and the one of least score calibrates; without labels everything is kept; an empty table gives no rows;
    texts of any length are scored whole; other columns, whatever their names, are left out.
    """
    model, scored = fit(docs, labels)
    return scored.select("doc_id", F.col(SCORE).alias("log_ratio"), (1 / (1 + F.exp(-log_odds(model)))).alias("score"), (key(model) >= float(model.least_key)).alias("keep"))


def resample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are and whatever their names, whose key is among the k largest. Texts are read again, not shuffled; one of another type than string counts as its text."""
    model, _ = fit(docs, labels)
    return with_score(docs, model).where(key(model) >= float(model.least_key)).drop(SCORE)
