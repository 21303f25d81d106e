"""Vectors as codes of four bytes: codebooks of integer parts, refined by an RDD's treeAggregate over columnar blocks.

Kept vectors are packed once into blocks: for each part a NumPy array with a row per dimension and a column per vector. A round
sends every block past the codebooks (a fixed 4 x 256 entries): distances accumulate dimension by dimension, the least one
names the entry, and np.add.at adds each part to int64 tensors of sums and counts. These tensors, not the vectors, go
up a reduction tree, and the driver gets one pair of them however many vectors there are.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage

#: Fixed by the format: parts of a vector, entries of a part's codebook, rounds, and what a component is multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bytes of a block's components, and vectors whose distances are held at once.
BLOCK_BYTES, AT_ONCE = 1 << 20, 1024
#: Integer components are below this in size, so that an error always fits 64 bits.
MOST = 1 << 26


def _pack(dims: int, per_block: int):
    """Rows of (vec_id, label, q) to blocks: lists of identifiers and labels, and the components by part, dimension and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, per_block):
                s = b.slice(at, per_block)
                q = s.column(2).flatten().to_numpy(zero_copy_only=False).reshape(s.num_rows, dims).astype(np.int32)
                offs = pa.array([0, s.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offs, s.column(0)), pa.ListArray.from_arrays(offs, s.column(1)), pa.array([np.ascontiguousarray(q.T).tobytes()], pa.binary())], names=["ids", "labels", "parts"])

    return run


def _unpack(raw: bytes, dims: int) -> np.ndarray:
    """part x dimension x vector"""
    return np.frombuffer(raw, np.int32).reshape(PARTS, dims // PARTS, -1) if dims else np.zeros((PARTS, 0, 0), np.int32)


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each column of part (dimension x vector) the row of book (entry x dimension) at the least squared distance, the first of equals, and that distance."""
    n, most = part.shape[1], max(int(np.abs(x).max(initial=0)) for x in (part, book))
    kind = np.int32 if part.shape[0] * (2 * most) ** 2 < 1 << 31 else np.int64
    part, book = part.astype(kind), book.astype(kind)
    entry, error = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for at in range(0, n, AT_ONCE):
        here = part[:, at : at + AT_ONCE]
        total = np.zeros((here.shape[1], len(book)), kind)
        gap = np.empty_like(total)
        for d in range(len(here)):
            np.subtract(here[d][:, None], book[None, :, d], out=gap)
            np.multiply(gap, gap, out=gap)
            total += gap
        entry[at : at + AT_ONCE] = to = total.argmin(1)
        error[at : at + AT_ONCE] = total[np.arange(len(to)), to]
    return entry, error


def _refined(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: every part to its nearest entry, every entry to the floor of its parts' mean."""
    dims = PARTS * books.shape[2]
    entries = blocks.sparkSession.sparkContext.broadcast(books)  # at most 4 x 256 entries

    def add(acc: tuple, raw: bytes) -> tuple:
        sums, counts = acc or (np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64))
        for p, part in enumerate(_unpack(raw, dims)):
            to, _ = nearest(part, entries.value[p])
            np.add.at(sums[p], to, part.T)
            np.add.at(counts[p], to, 1)
        return sums, counts

    def merge(a: tuple, b: tuple) -> tuple:
        if not (a and b):
            return a or b
        a[0][...] += b[0]
        a[1][...] += b[1]
        return a

    rows = blocks.select("parts").rdd.map(lambda r: bytes(r[0]))
    depth = max(2, math.ceil(math.log(max(rows.getNumPartitions(), 2), 32)))
    sums, counts = rows.treeAggregate((), add, merge, depth)
    entries.destroy()
    return np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)


def _prepared(rows: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, label, q (integer components) of the rows that stay, and how many components they have."""
    x = F.col("embedding").cast("array<double>")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = rows.where(x.isNotNull() & ~odd).select("vec_id", "label", x.alias("x"))
    top = F.max(F.when(F.size("x") > 0, F.array_max(F.transform("x", F.abs)))).alias("top")
    sizes = kept.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n"), top)
    best = sizes.where(f"dims % {PARTS} = 0").orderBy(F.desc("n"), F.desc("dims")).first()
    if best is None:
        return kept.where(F.lit(False)).select("vec_id", "label", F.col("x").cast("array<int>").alias("q")), 0
    if (best["top"] or 0) * SCALE >= MOST:
        raise ValueError(f"components of {MOST // SCALE} or more have no code")
    q = F.transform("x", lambda c: F.floor(c * SCALE).cast("int"))
    return kept.where(F.size("x") == best["dims"]).select("vec_id", "label", q.alias("q")), best["dims"]


def compress(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) for every vector kept, and the codebooks: part x entry x dimension.

    Each component x counts as floor(1024 x). A codebook starts as the parts of the 256 smallest vec_ids (of fewer, if there are fewer;
    null ones last, rows that repeat one in the order of their components). Vectors that are null or hold a null or
    non-finite component are left out, and so are those of another length than most have: of lengths that four divides the
    commonest, of equals the largest. A null label or vec_id is carried on, repeated rows are coded each, other columns are ignored, and an
    empty table gives no rows. Components of 65,536 or more in size raise ValueError, as errors would not fit 64 bits.
    """
    spark = vectors.sparkSession
    storage.bound_batches(spark)
    rows, dims = _prepared(vectors)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").select("q").limit(ENTRIES).collect()
    books = np.array([r.q for r in first], np.int64).reshape(len(first), PARTS, dims // PARTS).transpose(1, 0, 2)
    per_block = max(1, BLOCK_BYTES // (4 * max(dims, 1)))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    blocks = storage.table(rows.mapInArrow(_pack(dims, per_block), f"ids array<{kinds[0]}>, labels array<{kinds[1]}>, parts binary"), "blocks")
    for _ in range(ROUNDS if first and dims else 0):
        books = _refined(blocks, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                ids, labels = b.column(0)[k].values, b.column(1)[k].values
                found = [nearest(part, books[p]) for p, part in enumerate(_unpack(b.column(2)[k].as_py(), dims))] if dims else [(np.zeros(len(ids), np.int64),) * 2] * PARTS
                code = np.stack([f[0] for f in found], 1).astype(np.uint8).tobytes().hex()
                wide = 2 * PARTS
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([code[i : i + wide] for i in range(0, len(code), wide)], pa.string()), pa.array(sum(f[1] for f in found), pa.int64())], names=["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id {kinds[0]}, label {kinds[1]}, code string, error bigint"), books


def compressed_codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (errors summed over equal labels, nulls together), codebooks_sha256; cases as compress() says."""
    coded, books = compress(vectors)
    coded = storage.table(coded, "codes")
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return coded.join(sums.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def restored(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id and the vector that each code stands for, back in the vectors' own scale."""
    entries = [F.array(*(F.array(*(F.lit(float(v) / SCALE) for v in e)) for e in part)) for part in books.tolist()]
    parts = [F.element_at(e, F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + 1) for p, e in enumerate(entries)]
    return codes.select("vec_id", F.concat(*parts).cast(T.ArrayType(T.FloatType())).alias("embedding"))


def _sql() -> str:
    part = f"""SELECT v.vid, v.part, v.pos, v.val FROM flat v"""
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"""
dist{k} AS (SELECT v.vid, v.part, b.entry, sum((v.val - b.val) * (v.val - b.val))::BIGINT AS d FROM ({part}) v JOIN book{k} b ON v.part = b.part AND v.pos = b.pos GROUP BY v.vid, v.part, b.entry),
near{k} AS MATERIALIZED (SELECT vid, part, arg_min(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d FROM dist{k} GROUP BY vid, part)""")
        if k < ROUNDS:
            steps.append(f"""
mean{k} AS (SELECT n.part, n.entry, v.pos, floor(sum(v.val)::DOUBLE / count(*))::BIGINT AS val FROM near{k} n JOIN flat v ON n.vid = v.vid AND n.part = v.part GROUP BY n.part, n.entry, v.pos),
book{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(m.val, b.val) AS val FROM book{k} b LEFT JOIN mean{k} m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS vid, vec_id, label, embedding AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
flat AS MATERIALIZED (
  SELECT vid, (i - 1) // (len(x) // {PARTS}) AS part, (i - 1) % (len(x) // {PARTS}) AS pos, floor(x[i]::DOUBLE * {SCALE})::BIGINT AS val
  FROM (SELECT vid, x, unnest(range(1, len(x) + 1)) AS i FROM kept)),
book0 AS MATERIALIZED (SELECT part, vid - 1 AS entry, pos, val FROM flat WHERE vid <= {ENTRIES}),{",".join(steps)},
codes AS (SELECT vid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY vid),
sha AS (SELECT sha256(string_agg(val::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, sha.codebooks_sha256
FROM kept k JOIN codes c ON k.vid = c.vid, sha
"""


SQL = _sql()
