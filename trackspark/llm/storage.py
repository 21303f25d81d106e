"""Where intermediate tables and files go: a folder that every executor of the cluster shares."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackspark.tables import fresh_path, shared_dir
from trackspark.tables import table as _table

__all__ = ["PREFIX", "bound_batches", "fresh_path", "scratch", "shared_dir", "table"]

#: A clash-free name for columns that an operator adds beside whatever columns its caller brings.
PREFIX = "__ts_"
#: Bytes of an Arrow batch on its way to Python: rows of text have no bound of their own.
BATCH_BYTES = 16 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes as well as by rows, for this session; every operator over texts calls this."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.conf.get(name, None)
    digits = "".join(c for c in have or "" if c.isdigit())
    if not digits or not 0 < int(digits) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def parts_of(rows: DataFrame, column: str, part_bytes: int) -> int:
    """Partitions to deal rows into: as many as shuffles have, and so many more that none has more than part_bytes of the column's text on average."""
    total = rows.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // part_bytes))


def table(df: DataFrame, what: str = "table", folder: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: a cut of the lineage that outlives executors."""
    bound_batches(df.sparkSession)
    return _table(df, what, folder)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """table() for what only the body of a with-statement reads: all of it is deleted at the end."""
    folder = fresh_path(spark, "scratch")
    try:
        yield lambda df, what: table(df, what, folder)
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
