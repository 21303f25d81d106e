"""Exact duplicates by radix partitioning from the most significant byte, over Spark's shuffles.

A text is a number of its own: its length, then its bytes in turn. Each round splits every open group by the next digit, a block
of successive bytes; blocks grow, so that a long text takes few rounds. A group of one is decided, a group whose bytes have ended
is a group of copies, and only the rest go on, with the bytes not yet read. Digits are compared as they are: no digest says that
two texts are equal.

What a round shuffles to count its groups is aggregated within each task first; rows meet their group's count in a join whose
large keys Spark splits, as both sides are shuffled and nothing stands between. A group that holds a third of all rows
therefore takes many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .textbytes import lower_ascii, text_views

#: Characters of the digit by which most texts are already alone; bytes of the first round's digit, and by how much it grows.
HEAD, WIDTH, GROW = 48, 256, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text with A-Z lower-cased: its SHA-256 for the report, and its bytes where it may have copies."""
    for b, data, offs in text_views(batches):
        low, o = lower_ascii(data), offs.tolist()
        sha = [hashlib.sha256(low[s:e]).hexdigest() for s, e in zip(o, o[1:], strict=False)]
        body = pa.Array.from_buffers(pa.large_binary(), len(sha), [None, pa.py_buffer(offs), pa.py_buffer(low)])
        rest = pc.if_else(b.column("open"), body, pa.scalar(None, pa.large_binary())).cast(pa.binary())
        cols = {n: b.column(n) for n in b.schema.names if n not in ("text", "open")} | {"text_sha256": pa.array(sha, pa.string()), "rest": rest}
        yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def _first(rows: DataFrame, table: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Every row with a number of its own in uid; rest is null where length and first characters are no other row's."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = rows.withColumn("text", text).withColumns({"g": F.octet_length("text").cast("bigint"), "head": F.translate(F.left("text", F.lit(HEAD)), UPPER, LOWER)})
    heads = table(keyed.groupBy("g", "head").agg(F.count("*").alias("n")).where("n > 1").withColumn("open", F.lit(True)).drop("n"), "heads")
    met = keyed.join(heads.hint("merge"), ["g", "head"], "left").withColumn("open", F.coalesce("open", F.lit(False))).drop("head")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.schema if f.name not in ("text", "open"))
    read = met.mapInArrow(_normalised, f"{kinds}, text_sha256 string, rest binary")
    one = F.col("rest").isNull()
    return table(read.withColumns({
        "uid": F.monotonically_increasing_id(), "keep_id": F.when(one, F.col("doc_id")), "group_size": F.when(one, F.lit(1)).cast("bigint"), "kept": F.when(one, F.lit(True)),
    }), "texts")


def _round(rows: DataFrame, width: int, table: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """Open rows split by their next `width` bytes; rest is null for those decided."""
    keyed = rows.where("rest is not null").select("uid", "doc_id", "text_sha256", "g", "rest", F.substring("rest", 1, width).alias("digit"))
    best = F.max(F.struct("doc_id", (-F.col("uid")).alias("first"))).alias("best")
    groups = keyed.groupBy("g", "digit").agg(F.count("*").alias("n"), F.min("uid").alias("to"), best).where("n > 1")
    met = keyed.join(table(groups, "groups").hint("merge"), ["g", "digit"], "left")
    one, ended = F.col("n").isNull(), F.length("rest") <= width
    return table(met.select(
        "uid", "doc_id", "text_sha256", F.col("to").alias("g"), F.when(~one & ~ended, F.expr(f"substring(rest, {width + 1})")).alias("rest"),
        F.when(one, F.col("doc_id")).when(ended, F.col("best.doc_id")).alias("keep_id"),
        F.when(one, F.lit(1)).when(ended, F.col("n")).cast("bigint").alias("group_size"),
        F.when(one, F.lit(True)).when(ended, F.col("best.first") == -F.col("uid")).alias("kept"),
    ), "round")


def _groups(rows: DataFrame, table: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All rows as _first() numbered them, and each one's group: uid, doc_id, keep_id, group_size, kept, text_sha256."""
    storage.bound_batches(rows.sparkSession)
    first = at = _first(rows, table)
    done, width = [first.where("rest is null")], WIDTH
    while not at.where("rest is not null").isEmpty():
        at = _round(at, width, table)
        done.append(at.where("rest is null"))
        width *= GROW
    report = ("uid", "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    return first, reduce(DataFrame.unionAll, (d.select(*report) for d in done))


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Texts are equal when identical after lower-casing A-Z only. A null text counts as empty, and all empty texts are copies of
    each other. keep_id is the group's largest doc_id, null only where all are; rows that repeat doc_id and text are copies, and
    one of them has kept. An empty table gives no rows, other columns are ignored whatever their names, and texts of any length
    are read whole: rounds grow with the logarithm of the longest shared length.
    """
    with storage.scratch(docs.sparkSession) as table:
        _, got = _groups(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), table)
        return storage.table(got.drop("uid"), "exact")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_groups() keeps, with all their columns as they were."""
    with storage.scratch(docs.sparkSession) as table:
        whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
        first, got = _groups(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", whole), table)
        return storage.table(first.select("uid", "whole").join(got.where("kept").select("uid"), "uid").select("whole.*"), "kept")


#: Reads every row of documents, as exact_groups() does.
SQL = f"""
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
WINDOW g AS (PARTITION BY norm)
"""
