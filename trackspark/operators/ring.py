"""Ring colours: a debounced state machine over ordered luminances, and the luminance around a ball."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BLACK, MAGENTA, WHITE
from ..functions.geometry import LUMINANCE, best_candidate, contrast, luminance, segment_distance, srgb_to_linear
from .folds import fold_sorted

SWITCH_RATIO, SWITCH_FRAMES = 1.15, 3
COLOURS = (BLACK, WHITE, MAGENTA)


#: What advance() needs of a row, and where it starts from.
SEEN = ("best", "new", *(f"c{k}" for k in range(len(COLOURS))))
START = (None, None, 0)


def seen(rows: DataFrame, keys: list[str], frame: str, *more: str) -> DataFrame:
    """keys, frame, more and SEEN: the best colour on lum (null where that is unknown), its contrast, and that of every colour."""
    best = best_candidate(F.col("lum"))
    held = [contrast(F.lit(LUMINANCE[c]), F.col("lum")).alias(f"c{k}") for k, c in enumerate(COLOURS)]
    return rows.select(*keys, frame, *more, F.when(F.col("lum").isNotNull(), best["colour"]).alias("best"), best["contrast"].alias("new"), *held)


def advance(state: tuple, row: tuple) -> tuple:
    """(current, pending, count) after a row of SEEN: batches and streams share this step."""
    current, pending, count = state
    colour, new, *against = row
    if colour is None:  # nothing known: all stays
        return state
    if current is None:
        return colour, None, 0
    if colour == current or new < SWITCH_RATIO * against[COLOURS.index(current)]:
        return current, None, 0
    count = count + 1 if colour == pending else 1
    return (colour, None, 0) if count >= SWITCH_FRAMES else (current, colour, count)


def choose(rows: DataFrame, keys: list[str], frame: str = "frame") -> DataFrame:
    """keys, frame, ring from lum (null: unknown): a colour changes after 3 rows in a row whose best one has 1.15 times its contrast.

    keys name one span without breaks. What each row's best colour is, and how it stands against every colour, are native
    expressions; only who holds the ring is carried from row to row.
    """
    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        state = advance(state, row[1:])
        return state, (row[0], state[0] or WHITE)

    kind = rows.schema[frame].dataType.simpleString()
    return fold_sorted(seen(rows, keys, frame), keys, [frame], lambda: START, step, [frame, *SEEN], f"{frame} {kind}, ring string")


def background_luminance(pixels: DataFrame, keys: list[str], inner: float = 1.3, outer: float = 2.5, least: int = 4) -> DataFrame:
    """keys, lum of the median linear colour of pixels (px, py, red, green, blue in 0..255) between inner and outer radii of a ball (cx, cy, r, sl, sa)."""
    d = segment_distance(F.col("px") + 0.5, F.col("py") + 0.5, F.col("cx"), F.col("cy"), F.col("sl"), F.col("sa"))
    lo, hi = inner * F.col("r"), F.greatest(outer * F.col("r"), inner * F.col("r") + 1)
    lin = {c: F.percentile(srgb_to_linear(F.col(c) / 255.0), 0.5).alias(c) for c in ("red", "green", "blue")}
    g = pixels.withColumn("_d", d).where((F.col("_d") >= lo) & (F.col("_d") <= hi)).groupBy(*keys).agg(F.count("*").alias("n"), *lin.values())
    return g.select(*keys, F.when(F.col("n") >= least, luminance(F.col("red"), F.col("green"), F.col("blue"))).alias("lum"))
