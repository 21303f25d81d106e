"""Spatial joins by grid cells: pairs within a radius, static points, and the nearest within a radius."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import table

PART = 4096  # so many points of a block are asked about in one task
PAIRS = 1 << 15  # so many distances are looked at together


def grid_join(a: DataFrame, b: DataFrame, radius: float, keys: list[str]) -> DataFrame:
    """Rows of a (with x, y) joined with those of b (with _x, _y) of equal keys within `radius`, and their distance _d.

    Cells are as wide as the radius, so partners lie in a point's own cell and the eight around it; b is copied nine
    times and the join is an equality.
    """
    cell = lambda c: F.floor(F.col(c) / radius).cast("bigint")
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    left = a.withColumns({"_i": cell("x"), "_j": cell("y")})
    right = b.withColumns({"_ci": cell("_x"), "_cj": cell("_y"), "_n": near}).withColumns({"_i": F.col("_ci") + F.col("_n.i"), "_j": F.col("_cj") + F.col("_n.j")}).drop("_ci", "_cj", "_n")
    d = F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y"))
    return left.join(right, [*keys, "_i", "_j"]).withColumn("_d", d).where(F.col("_d") <= radius).drop("_i", "_j", "_x", "_y")


def pairs_within(points: DataFrame, radius: float, keys: list[str], cols: list[str]) -> DataFrame:
    """Every point joined with all within `radius` of it (itself included): the point's cols, and the other's as other_<col>."""
    other = points.select(*keys, *(F.col(c).alias(f"other_{c}") for c in cols), F.col("x").alias("_x"), F.col("y").alias("_y"))
    return grid_join(points.select(*keys, *cols, "x", "y"), other, radius, keys).drop("_d")


def frame_runs(points: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """keys, runs: the distinct frames of a key as array<struct<a, b>> of consecutive ones, in no order."""
    w = Window.partitionBy(*keys).orderBy(frame)
    d = points.select(*keys, frame).distinct().withColumn("_new", F.coalesce((F.col(frame) - F.lag(frame).over(w) > 1).cast("int"), F.lit(1)))
    d = d.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.groupBy(*keys, "_run").agg(F.min(frame).cast("bigint").alias("a"), F.max(frame).cast("bigint").alias("b")).groupBy(*keys).agg(F.collect_list(F.struct("a", "b")).alias("runs"))


def run_stats(runs: Column, gap: int) -> Column:
    """struct<frames, span, visits> of the union of runs of frames: how many, from first to last, and in how many visits more than `gap` apart."""
    ordered = F.array_sort(runs)
    none = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("visits"))

    def add(s: Column, r: Column) -> Column:
        end = s["end"]
        more = F.greatest(F.lit(0), r["b"] - F.greatest(r["a"] - 1, F.coalesce(end, r["a"] - 1)))
        away = F.coalesce(r["a"] - end > gap, F.lit(True)).cast("bigint")
        return F.struct((s["n"] + more).alias("n"), F.greatest(end, r["b"]).alias("end"), (s["visits"] + away).alias("visits"))

    return F.aggregate(ordered, none, add, lambda s: F.struct(s["n"].cast("int").alias("frames"), (s["end"] - F.get(ordered, F.lit(0))["a"]).alias("span"), s["visits"].cast("int").alias("visits")))


def crowded(cells: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The rows of cells (keys, _i, _j) but those that neither have `least` rows within two cells of their own nor are among such.

    Strips of two cells' width are counted with the strips beside them, without copies; a row that can see `least` rows lies in a strip that
    has them, and so do all rows that it sees within one strip more. Then blocks of two by two cells are counted alike, by nine copies of their counts.
    """
    half = {"_bi": F.floor(F.col("_i") / 2).cast("bigint"), "_bj": F.floor(F.col("_j") / 2).cast("bigint")}
    rows = cells.withColumns(half)
    for c in half:
        # a strip stays if it or one beside it has enough around
        around = Window.partitionBy(*keys).orderBy(c).rangeBetween(-1, 1)
        strips = rows.groupBy(*keys, c).agg(F.count("*").alias("_n")).withColumn("_n", F.sum("_n").over(around)).withColumn("_n", F.max("_n").over(around))
        rows = rows.join(strips.where(F.col("_n") >= least).select(*keys, c), [*keys, c], "left_semi")
    rows = table(rows, "strips")
    block = [*keys, "_bi", "_bj"]
    near = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    beside = lambda b: b.withColumn("_o", near).withColumns({"_bi": F.col("_bi") + F.col("_o.i"), "_bj": F.col("_bj") + F.col("_o.j")}).drop("_o")
    blocks = rows.groupBy(*block).agg(F.count("*").alias("_n"))
    # copies count at blocks without rows too; those drop out where rows are asked again
    full = beside(blocks).groupBy(*block).agg(F.sum("_n").alias("_n")).where(F.col("_n") >= least).select(*block)
    return rows.join(beside(full).distinct(), block, "left_semi").drop(*half)


def around_each(radius: float, cols: list[str], gap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """cols, frames, span, visits of the rows of a block's part (_block, _part; sorted by them) that are _own, by all its rows within `radius` of each: for mapInArrow."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.RecordBatch]]:
        for batch in batches:
            at, part = (batch.column(c).to_numpy() for c in ("_block", "_part"))
            ends = [*(np.flatnonzero((np.diff(at) != 0) | (np.diff(part) != 0)) + 1).tolist(), len(at)] if len(at) else []
            for a, b in zip([0, *ends], ends, strict=False):
                yield (at[a], part[a]), batch.slice(a, b - a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[pa.Table] = []
        for _, same in groupby(stretches(batches), lambda s: s[0]):
            done.append(count(pa.Table.from_batches([b for _, b in same])))
            if sum(map(len, done)) >= PART:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
                done = []
        if done:
            yield from pa.concat_tables(done).combine_chunks().to_batches()

    def count(t: pa.Table) -> pa.Table:
        f, x, y, i, j = (t.column(c).to_numpy() for c in ("_f", "x", "y", "_i", "_j"))
        order = np.argsort(f, kind="stable")
        f, x, y, i, j = (v[order] for v in (f, x, y, i, j))
        own = np.flatnonzero(t.column("_own").to_numpy()[order])
        own = own[np.lexsort((j[own], i[own]))]
        out = np.zeros((3, len(own)), np.int64)
        ends = [*(np.flatnonzero((np.diff(i[own]) != 0) | (np.diff(j[own]) != 0)) + 1).tolist(), len(own)]
        for a, b in zip([0, *ends], ends, strict=False):
            # one cell's points see no further than the radius around their box
            xq, yq = x[own[a:b]], y[own[a:b]]
            near = (xq.min() - x <= radius) & (x - xq.max() <= radius) & (yq.min() - y <= radius) & (y - yq.max() <= radius)
            xs, ys = x[near], y[near]
            many = max(1, min(b - a, PAIRS // len(xs)))
            fs = np.tile(f[near], many)
            for c in range(0, b - a, many):
                within = np.square(xq[c : c + many, None] - xs)
                within += np.square(yq[c : c + many, None] - ys)
                within = within <= radius * radius
                got = fs[np.flatnonzero(within)]  # by point, and its frames in order
                last = np.cumsum(np.count_nonzero(within, axis=1))
                first = np.r_[0, last[:-1]]  # a point has itself at least
                step = np.diff(got, prepend=0)
                step[first] = gap + 1  # each point begins anew
                out[:, a + c : a + c + len(first)] = np.add.reduceat(step > 0, first, dtype=np.int64), got[last - 1] - got[first], np.add.reduceat(step > gap, first, dtype=np.int64)
        asked = t.select(cols).take(pa.array(order[own]))
        for name, v, kind in zip(("frames", "span", "visits"), out, (pa.int32(), pa.int64(), pa.int32()), strict=True):
            asked = asked.append_column(name, pa.array(v, kind))
        return asked

    return run


def static_points(points: DataFrame, radius: float, keys: list[str], ident: str, frame: str = "frame", min_frames: int = 4, min_span: int = 12, min_visits: int = 3, gap: int = 2) -> DataFrame:
    """keys, ident, frames, span, visits of points that something keeps coming back to: false detections that do not move.

    Points are dealt into cells half a radius wide, so that a cell's points are all neighbours, and a cell is one row: the box around
    its points and the runs of their frames. A cell whose box lies within the radius of each box that it reaches at all, wholly, decides all
    its points at once. Points without enough others around go first (see crowded), before any cell is copied; cells with too few points
    or frames in their whole surroundings are left at once.

    The points of the other cells are counted one by one, in blocks of two by two cells: a block gets the points of all cells that its own
    reach, so a point is copied to nine blocks at most (and to as many parts as a block has PART points) and no pair leaves its task. Time
    grows with the pairs within reach, what is moved and held with the points.
    """
    side = radius / 2
    cell = [*keys, "_i", "_j"]
    # what has no frame or no finite place is within reach of nothing
    known = F.col(frame).isNotNull() & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))
    p = points.where(known).select(*keys, ident, frame, "x", "y", F.floor(F.col("x") / side).cast("bigint").alias("_i"), F.floor(F.col("y") / side).cast("bigint").alias("_j"))
    box = [f(c).alias(n) for c, k in (("x", "x"), ("y", "y"), (frame, "f")) for f, n in ((F.min, f"_{k}0"), (F.max, f"_{k}1"))]
    p = crowded(p, keys, min_frames)
    cells = table(p.groupBy(*cell).agg(*box, F.count("*").alias("_n")).join(frame_runs(p, cell, frame), cell), "cells")

    offsets = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3))))
    other = cells.select(*keys, *(F.col(f"_{c}").alias(f"_b{c}") for c in ("i", "j", "x0", "x1", "y0", "y1", "f0", "f1", "n")), F.col("runs").alias("_bruns"))
    other = other.withColumn("_o", offsets).withColumns({"_i": F.col("_bi") + F.col("_o.i"), "_j": F.col("_bj") + F.col("_o.j")}).drop("_o")
    # how far the points of two boxes are apart at most, and at least; squares, as the points are compared
    most = lambda c: F.greatest(F.col(f"_b{c}1") - F.col(f"_{c}0"), F.col(f"_{c}1") - F.col(f"_b{c}0"))
    least = lambda c: F.greatest(F.lit(0.0), F.col(f"_b{c}0") - F.col(f"_{c}1"), F.col(f"_{c}0") - F.col(f"_b{c}1"))
    within = lambda d: d("x") * d("x") + d("y") * d("y") <= radius * radius

    met = cells.drop("runs", "_n", "_f0", "_f1").join(other, cell).where(within(least)).withColumn("_whole", within(most))
    enough = (F.sum("_bn") >= min_frames) & (F.max("_bf1") - F.min("_bf0") >= min_span)
    around = met.groupBy(*cell).agg(F.max(~F.col("_whole")).alias("_open"), enough.alias("_enough")).where("_enough")
    around = table(around.select(*cell, "_open"), "around")
    rule = (F.col("frames") >= min_frames) & (F.col("span") >= min_span) & (F.col("visits") >= min_visits)
    # what has only whole neighbours has one answer
    decided = met.join(around.where("NOT _open").select(*cell), cell).groupBy(*cell).agg(F.flatten(F.collect_list("_bruns")).alias("_runs"))
    decided = decided.select(*cell, run_stats(F.col("_runs"), gap).alias("_s")).select(*cell, "_s.*").where(rule)
    decided = p.select(*keys, ident, "_i", "_j").join(decided, cell).drop("_i", "_j")

    block = [*keys, "_ti", "_tj"]
    sees = met.join(around.where("_open").select(*cell), cell).select(*keys, *(F.floor(F.col(f"_{c}") / 2).cast("bigint").alias(f"_t{c}") for c in ("i", "j")), "_bi", "_bj", "_bn", ((F.col("_i") == F.col("_bi")) & (F.col("_j") == F.col("_bj"))).alias("_own"))
    sees = sees.groupBy(*block, F.col("_bi").alias("_i"), F.col("_bj").alias("_j"), "_bn").agg(F.max("_own").alias("_own"))
    sees = sees.groupBy(*block).agg(F.collect_list(F.struct("_i", "_j", "_own")).alias("_c"), F.ceil(F.sum(F.when(F.col("_own"), F.col("_bn"))) / PART).cast("int").alias("_parts"))
    sees = sees.withColumn("_block", F.monotonically_increasing_id()).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    # written: so a block's number stays, and the points are dealt out by where they go, not by where this lies
    sees = table(sees.select(*keys, "_block", "_part", "_parts", F.inline("_c")), "sees")
    mine = [*keys, ident, "x", "y"]
    at = F.pmod(F.xxhash64(ident, "x", "y"), "_parts").cast("int") == F.col("_part")
    rows = p.select(*cell, ident, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col(frame).cast("bigint").alias("_f")).join(sees, cell).withColumn("_own", F.col("_own") & at)
    rows = rows.select(*keys, "_block", "_part", F.when(F.col("_own"), F.col(ident)).alias(ident), "x", "y", "_f", "_i", "_j", "_own")
    schema = T.StructType([*(rows.schema[c] for c in mine), T.StructField("frames", T.IntegerType()), T.StructField("span", T.LongType()), T.StructField("visits", T.IntegerType())])
    rest = rows.repartition("_block", "_part").sortWithinPartitions("_block", "_part").mapInArrow(around_each(radius, mine, gap), schema)
    return decided.unionByName(rest.where(rule).dropDuplicates(mine).drop("x", "y"))


def nearest_within(points: DataFrame, candidates: DataFrame, radius: float, keys: list[str], ident: str, cand: str) -> DataFrame:
    """points with the nearest candidate of their keys within radius as near_<col>, null without; the earlier of equals."""
    cols = [c for c in candidates.columns if c not in keys]
    c = candidates.select(*keys, *(F.col(x).alias(f"near_{x}") for x in cols), F.col("x").alias("_x"), F.col("y").alias("_y"))
    names = [f"near_{x}" for x in cols]
    best = grid_join(points.select(*keys, ident, "x", "y"), c, radius, keys).groupBy(*keys, ident).agg(F.min_by(F.struct("_d", *names), F.struct("_d", f"near_{cand}")).alias("_b"))
    return points.join(best.select(*keys, ident, *(F.col(f"_b.{n}").alias(n) for n in names), F.col("_b._d").alias("near_dist")), [*keys, ident], "left")
