"""Document fingerprints by content-defined chunking with a normalised gear hash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import storage
from .textbytes import BYTE, prefix_hash, span_hash, text_views

#: Bytes of a chunk: at least, where the boundary rule turns easier, at most. Lengths fit one byte.
LEAST, NORMAL, MOST = 16, 48, 192
#: Bits of the gear hash that must be zero at a boundary before and after NORMAL.
HARD_BITS, EASY_BITS = 8, 4
#: The gear hash has 16 bits and so sees the last 16 bytes: never beyond a chunk of LEAST bytes.
GEAR = (BYTE >> np.uint64(40)).astype(np.uint16)
#: Ranges of identifiers that neighbours() deals rows over, at most.
MOST_RANGES = 4096
#: Bytes of text in a range, about.
RANGE_BYTES = 256 << 20


def gear_hash(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of GEAR[byte k before] << k, modulo 2**16, by doubling the window four times."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << k  # the right side is a copy made before the addition
    return h


def _next_zero(h: np.ndarray, bits: int) -> memoryview:
    """For each place the first place from it on whose top `bits` bits are zero; len(h) or more where there is none."""
    n = len(h)
    at = np.full(n + NORMAL, n + MOST, np.int32)
    hit = np.flatnonzero(h < (1 << 16 - bits))
    at[hit] = hit
    return memoryview(np.ascontiguousarray(np.minimum.accumulate(at[::-1])[::-1]))


def boundaries(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks of all documents in turn, and how many each document has before it."""
    h = gear_hash(data)
    hard, easy = _next_zero(h, HARD_BITS), _next_zero(h, EASY_BITS)
    ends: list[int] = []
    counts = [0]
    bounds = offs.tolist()
    for s, end in zip(bounds, bounds[1:], strict=False):
        while s < end:
            cut = hard[s + LEAST - 1]
            if cut >= s + NORMAL - 1:
                cut = min(easy[s + NORMAL - 1], s + MOST - 1)
            s = cut + 1 if cut + 1 < end else end
            ends.append(s)
        counts.append(len(ends))
    return np.array(ends, np.int64), np.array(counts)


def chunk_sets(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Each document's sorted set of chunks, a chunk being 40 bits of digest and 8 of length."""
    ends, counts = boundaries(data, offs)
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    chunk = (span_hash(prefix_hash(data), starts, ends) >> np.uint64(24)) << np.uint64(8) | (ends - starts).astype(np.uint64)
    c = counts.tolist()
    return [np.unique(chunk[a:b]) for a, b in zip(c, c[1:], strict=False)]


def encode(chunks: np.ndarray) -> str:
    """12 hex digits a chunk, ascending."""
    return chunks.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()


def decode(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, 2:] = raw
    return out.view(">u8").ravel().astype(np.uint64)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Bytes in shared chunks over the bytes of the set that has fewer; 1 for two empty sets, 0 for one."""
    weight = lambda x: int((x & np.uint64(255)).sum())
    least = min(weight(a), weight(b))
    if not least:
        return float(len(a) == len(b))
    return weight(np.intersect1d(a, b, assume_unique=True)) / least


def _sets(texts: list[str]) -> list[np.ndarray]:
    raw = [t.encode() for t in texts]
    return chunk_sets(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])].astype(np.int64))


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint for every row of docs: shift-resistant, equal for equal texts, no shuffle.

    A null or empty text has the empty fingerprint; rows may repeat; other columns, whatever their names, are ignored; texts of any length are chunked whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in text_views(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([encode(s) for s in chunk_sets(data, offs)], pa.string())], names=["doc_id", "fingerprint"])

    storage.bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, fingerprint string")


def neighbours(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Rows doc_id, text, follows, part dealt by ranges of doc_id and sorted descending; each range ends with a row `follows`.

    The row that follows a range's last is the first of the next lower range that has rows, or the very first row
    after the very last. Equal identifiers are in order of text, a null identifier comes last of all. Ranges are
    counted by quantiles of doc_id; only one row of a range is copied, and texts are shuffled once.
    """
    spark = docs.sparkSession
    storage.bound_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = min(MOST_RANGES, ranges or storage.parts_of(rows, "text", RANGE_BYTES))
    cuts = sorted(set(rows.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [k / n for k in range(1, n)], 0.1 / n))) if n > 1 else []
    # parts count from the highest identifiers down; null is the last part
    part = F.size(F.filter(F.array(*(F.lit(int(c)) for c in cuts)).cast("array<bigint>"), lambda c: c > F.col("doc_id"))) if cuts else F.lit(0)
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(n)).otherwise(part).cast("int"))
    top = rows.groupBy("part").agg(F.max("doc_id").alias("top"))
    # at most MOST_RANGES + 1 rows
    heads = rows.join(F.broadcast(top.withColumnRenamed("part", "p")), (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("part").agg(F.min("text").alias("text"))
    each, all_ = Window.partitionBy().orderBy("part"), Window.partitionBy().orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = heads.select(F.lit(None).cast("bigint").alias("doc_id"), F.coalesce(F.lead("text").over(each), F.first("text").over(all_)).alias("text"), "part", F.lit(True).alias("follows"))
    dealt = rows.withColumn("follows", F.lit(False)).unionByName(ends).repartition(n, "part")
    return dealt.sortWithinPartitions("part", "follows", F.desc("doc_id"), "text")


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; see SCHEMA.

    The edited text has its last third (rounded down) replaced by as many characters of the next row in descending
    doc_id. A null text counts as empty; an only row is its own next; an empty table gives no rows. Rows that repeat a doc_id follow each other in order of
    text, rows without one come last; other columns, whatever their names, are ignored; texts of any length are read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None  # the last row, until the next is known
        for rows, _, _ in text_views(batches):
            ids, texts, follows = (rows.column(k).to_pylist() for k in range(3))
            sets = _sets(texts)
            lines = list(zip(ids, texts, sets, follows, strict=True))
            lines = [before, *lines] if before else lines
            before = lines[-1]
            pairs = [(a, b) for a, b in zip(lines, lines[1:], strict=False) if not a[3]]
            edited = [a[1][: len(a[1]) - len(a[1]) // 3] + b[1][: len(a[1]) // 3] for a, b in pairs]
            if pairs:
                new = _sets(edited)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[0] for a, _ in pairs], pa.int64()), pa.array([len(a[1]) for a, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()), pa.array([encode(a[2]) for a, _ in pairs], pa.string()),
                        pa.array([encode(s) for s in new], pa.string()), pa.array([containment(a[2], s) for (a, _), s in zip(pairs, new, strict=True)], pa.float64()),
                        pa.array([containment(a[2], b[2]) for a, b in pairs], pa.float64()),
                    ],
                    names=[c.split()[0] for c in SCHEMA.split(", ")],
                )

    return neighbours(docs, ranges).select("doc_id", "text", "follows").mapInArrow(run, SCHEMA)
