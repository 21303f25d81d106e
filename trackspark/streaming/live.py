"""Streaming twins of the operators that need no look-ahead: ring colours, runs and event-time cells."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import WHITE
from ..operators import ring
from ..operators.folds import plain


def ring_colours(rows: DataFrame, key: str = "video_id", max_gap: int = 8) -> DataFrame:
    """key, frame, ring for a stream of (key, frame, lum): the state machine of operators.ring, reset after gaps longer than max_gap.

    Rows of a key must come in order of frames from one trigger to the next; within one they are sorted.
    """
    kind = rows.schema[key].dataType.simpleString()

    def update(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (None, None, 0, -1)
        pdf = plain(pd.concat(list(parts)).sort_values("frame"))
        out = []
        for frame, *row in pdf[["frame", *ring.SEEN]].itertuples(index=False, name=None):
            machine = now[:3] if now[3] < 0 or frame - now[3] <= max_gap + 1 else ring.START
            now = (*ring.advance(machine, row), frame)
            out.append((k[0], frame, now[0] or WHITE))
        state.update(now)
        yield pd.DataFrame(out, columns=[key, "frame", "ring"])

    return ring.seen(rows, [key], "frame").groupBy(key).applyInPandasWithState(update, f"{key} {kind}, frame bigint, ring string", "current string, pending string, count int, last bigint", "append", GroupStateTimeout.NoTimeout)


def runs(rows: DataFrame, ts: str, key: str, gap: str = "10 seconds", late: str = "1 minute") -> DataFrame:
    """key, first, last, n of runs of rows at most `gap` apart, told once the watermark has passed their end."""
    s = rows.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))
    return s.select(key, "first", "last", "n")


def covered(rows: DataFrame, ts: str, key: str, cell: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """key, start, n, visible: rows, and rows with a confidence of a half, in tumbling windows of event time."""
    w = rows.withWatermark(ts, late).groupBy(F.window(ts, cell), key).agg(F.count("*").alias("n"), F.count_if(F.col("conf") >= 0.5).alias("visible"))
    return w.select(key, F.col("window.start").alias("start"), "n", "visible")
