"""Connected components of an undirected graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage


def components(edges: DataFrame) -> DataFrame:
    """v, label for every end of an edge (columns a, b); label is the component's smallest v.

    Each round links every vertex's larger neighbours to its smallest neighbour, then its smaller ones; the number of
    edges never grows, and the rounds are about the logarithm of the longest path. Minima are gathered by partial
    aggregation. The joins meet a vertex's edges with one row, its minimum, so the edges of a vertex with very many
    are split by Spark's skew handling. Each round is a written table, deleted at the end. Null ends are no edge.
    """
    spark = edges.sparkSession
    with storage.scratch(spark) as table:
        e = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        state = None
        while True:
            both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            # vertices that are the smallest of their neighbourhood keep their edge through the larger end
            large = table(large.where("a <> b").distinct(), "edges")
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            e = table(small.where("a <> b").distinct(), "edges")
            now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
            if now == state:
                break
            state = now
        ends = e.select(F.col("a").alias("v"), F.col("b").alias("label")).unionAll(e.select(F.col("b").alias("v"), F.col("b").alias("label")))
        return storage.table(ends.groupBy("v").agg(F.min("label").alias("label")), "labels")
