"""Counts of hashed n-grams over a whole table, by group: dense in each task, summed by a stream of blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import storage
from .textbytes import text_views

#: Buckets of a block: what one row of partial counts holds.
BLOCK = 4096
#: Groups whose counts are brought to the driver, at most; each is one dense vector.
MOST_GROUPS = 1000

#: (bytes, offsets) -> buckets of all n-grams, and the document of each.
Grams = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def count_grams(docs: DataFrame, group: Column, grams: Grams, buckets: int) -> dict[str, np.ndarray]:
    """Counts by group over every row whose group isn't null. Only blocks of counts are shuffled, never n-grams."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for rows, data, offs in text_views(batches):
            bucket, doc = grams(data, offs)
            names, code = np.unique(np.array(rows.column(0).to_pylist(), object).astype(str), return_inverse=True)
            both = np.bincount(code[doc] * buckets + bucket, minlength=len(names) * buckets).reshape(len(names), buckets)
            for k, g in enumerate(names.tolist()):
                sums[g] = sums[g] + both[k] if g in sums else both[k]
        yield from _blocks(sums, buckets)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for g, b, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                c = np.frombuffer(c, np.int64)
                sums[g, b] = sums[g, b] + c if (g, b) in sums else c
        for (g, b), c in sums.items():
            yield _row(g, b, c)

    storage.bound_batches(docs.sparkSession)
    rows = docs.select(group.cast("string").alias("g"), F.col("text").cast("string").alias("text")).where("g IS NOT NULL AND text IS NOT NULL")
    schema = "g string, b int, c binary"
    out: dict[str, np.ndarray] = {}
    for r in rows.mapInArrow(count, schema).repartition("g", "b").mapInArrow(add, schema).toLocalIterator():
        if r.g not in out:
            if len(out) == MOST_GROUPS:
                raise ValueError(f"more than {MOST_GROUPS} groups")
            out[r.g] = np.zeros(buckets, np.int64)
        out[r.g][r.b * BLOCK : (r.b + 1) * BLOCK] += np.frombuffer(r.c, np.int64)
    return dict(sorted(out.items()))


def _row(g: str, b: int, c: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([g]), pa.array([b], pa.int32()), pa.array([c.tobytes()], pa.binary())], names=["g", "b", "c"])


def _blocks(sums: dict[str, np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    for g, c in sums.items():
        for b in range(0, buckets, BLOCK):
            yield _row(g, b // BLOCK, c[b : b + BLOCK])
