"""The tracker as a stateful stream: chains stay open from trigger to trigger, and a span's pieces are told once nothing can reach it any more."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..config import TrackParams
from ..operators.gapfill import points
from ..operators.linking import PIECE, Chain, Walk, fitted, quiet_frames

WEAK = "array<struct<frame: int, cand_idx: int, x: double, y: double, score: double>>"
ROW = "frame int, cand_idx int, x double, y double, score double, at bigint"
CHAIN = "open boolean, frames array<int>, xs array<double>, ys array<double>, scores array<double>"
#: What stateful operators with timers need of the session.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Spans(StatefulProcessor):
    """One key's candidates to the pieces of its spans.

    State: candidates that the watermark has not reached (they may still get earlier company), the chains of the open span, and
    where that span stands. A row is linked once the watermark has passed it, so order of arrival does not matter; a span
    ends when the watermark is so far beyond its last candidate that no step of the tracker could see across.
    """

    def __init__(self, keys: list[str], width: float, fps: float, p: TrackParams) -> None:
        self.keys, self.width, self.fps, self.p = keys, width, fps, p
        self.quiet = quiet_frames(p)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", ROW)
        self.weak = handle.getListState("weak", ROW)
        self.chains = handle.getListState("chains", CHAIN)
        self.span = handle.getValueState("span", "first int, last int, last_at bigint")

    def close(self) -> None:
        pass

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [r for pdf in rows for r in pdf[["frame", "cand_idx", "x", "y", "score", "ms"]].itertuples(index=False, name=None)]
        yield self._advance(key, came, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def _advance(self, key: tuple, came: list[tuple], watermark: int) -> pd.DataFrame:
        known = sorted([(int(f), int(k), float(x), float(y), float(s), int(t)) for f, k, x, y, s, t in [*self.waiting.get(), *came]])
        ready, wait = [r for r in known if r[5] <= watermark], [r for r in known if r[5] > watermark]
        weak = [tuple(r) for r in self.weak.get()] + ready
        walk = self._resumed()
        first, last, last_at = self.span.get() if self.span.exists() else (None, None, None)
        strong = [r for r in ready if r[4] >= self.p.min_score]
        out, at = [], 0
        while at < len(strong):
            to = next((i for i in range(at, len(strong)) if strong[i][0] != strong[at][0]), len(strong))
            frame = strong[at][0]
            if first is not None and frame - last > self.quiet:
                out += self._told(key, first, last, walk, weak)
                walk, first = Walk(self.width, self.fps, self.p), None
            walk.step(frame, np.array([r[2:4] for r in strong[at:to]]), np.array([r[4] for r in strong[at:to]]))
            first, last, last_at, at = frame if first is None else first, frame, strong[at][5], to
        if first is not None and watermark >= self._end(last_at):
            out += self._told(key, first, last, walk, weak)
            walk, first = Walk(self.width, self.fps, self.p), None
        self._keep(walk, first, last, last_at, wait, [r for r in weak if first is not None and r[0] >= first])
        return pd.DataFrame(out, columns=[*self.keys, "span", *(c.split()[0] for c in PIECE.split(", ")), "weak"])

    def _end(self, last_at: int) -> int:
        """The time from which no candidate can come within `quiet` frames."""
        return last_at + int(np.ceil(self.quiet * 1000 / self.fps)) + 1

    def _told(self, key: tuple, first: int, last: int, walk: Walk, weak: list[tuple]) -> list[tuple]:
        rows, out = fitted(walk.chains(), self.width, self.fps, self.p)
        near = [dict(zip(("frame", "cand_idx", "x", "y", "score"), r, strict=False)) for r in weak if first <= r[0] <= last]
        return [(*key, first, *(r | {"outliers": out if k == 0 else 0}).values(), near if k == 0 else []) for k, r in enumerate(rows)]

    def _resumed(self) -> Walk:
        walk = Walk(self.width, self.fps, self.p)
        for is_open, frames, xs, ys, scores in self.chains.get():
            c = Chain([int(f) for f in frames], [np.array(p, float) for p in zip(xs, ys, strict=True)], [float(s) for s in scores])
            (walk.open if is_open else walk.ended).append(c)
        return walk

    def _keep(self, walk: Walk, first: int | None, last: int | None, last_at: int | None, wait: list[tuple], weak: list[tuple]) -> None:
        for state, rows in ((self.waiting, wait), (self.weak, weak), (self.chains, [(o, [int(f) for f in c.frames], [float(p[0]) for p in c.points], [float(p[1]) for p in c.points], [float(s) for s in c.scores]) for o, cs in ((False, walk.ended), (True, walk.open)) for c in cs])):
            state.put(rows) if rows else state.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = [r[5] for r in wait]
        if first is None:
            self.span.clear()
        else:
            self.span.update((first, last, last_at))
            due.append(self._end(last_at))
        if due:
            self.handle.registerTimer(min(due))


def piece_stream(candidates: DataFrame, ts: str, keys: list[str], width: float, fps: float, late: str = "10 seconds", p: TrackParams = TrackParams()) -> DataFrame:
    """keys, span (its first frame), PIECE and weak (candidates that interpolated points may move to) for a stream of keys, frame, cand_idx, x, y, score, ts.

    keys name a shot; ts grows with the frame, one frame in 1 / fps seconds. Rows may come in any order, and as late as `late`. Static points
    are no part of this: they need the whole video, so a caller who has them takes them out beforehand. The state of a key is its open
    span, which the watermark bounds. The session must use the RocksDB state store (PROVIDER).
    """
    spark = candidates.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != PROVIDER:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    head = ", ".join(f"{c} {candidates.schema[c].dataType.simpleString()}" for c in keys)
    good = candidates.where(F.col("score") >= 0.5 * p.min_score).withWatermark(ts, late).withColumn("ms", F.expr(f"unix_millis({ts})"))
    good = good.select(*keys, F.col("frame").cast("int").alias("frame"), F.col("cand_idx").cast("int").alias("cand_idx"), "x", "y", "score", "ms", ts)
    return good.groupBy(*keys).transformWithStateInPandas(Spans(keys, width, fps, p), f"{head}, span int, {PIECE}, weak {WEAK}", "append", "eventtime")


def track_pieces(pieces: DataFrame, keys: list[str], width: float, height: float, fps: float, p: TrackParams = TrackParams(), key: str = "video_id") -> DataFrame:
    """The track of rows of piece_stream(), as gapfill.track() gives it: a span's pieces come in one trigger, so a batch is whole."""
    weak = pieces.select(key, F.explode("weak").alias("w")).select(key, "w.*")
    return points(pieces.drop("weak"), weak, [*keys, "span"], width, height, fps, p, key)


def start(candidates: DataFrame, ts: str, path: str, checkpoint: str, width: float, height: float, fps: float, late: str = "10 seconds", p: TrackParams = TrackParams(), key: str = "video_id", once: bool = False) -> StreamingQuery:
    """Runs the tracker on a stream with key and shot_id, and writes its points as Parquet under path, one folder for each trigger.

    A trigger that is run again after a failure replaces its own folder, so every point is there once.
    """
    from ..tables import table

    keys = [key, "shot_id"]

    def write(batch: DataFrame, number: int) -> None:
        pieces = table(batch, "pieces")
        track_pieces(pieces, keys, width, height, fps, p, key).write.mode("overwrite").parquet(f"{path}/trigger={number}")

    out = piece_stream(candidates, ts, keys, width, fps, late, p).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (out.trigger(availableNow=True) if once else out).start()
