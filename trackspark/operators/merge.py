"""Merging tracks: new rows replace old ones wherever the new segments reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import OPTIONAL_DEFAULTS
from . import intervals


def union_by_name(old: DataFrame, new: DataFrame, required: list[str] | None = None) -> DataFrame:
    """old's rows in new's columns, then new's: missing optional columns take their defaults, unknown ones go.

    A missing required column is an error if `required` names it, else null.
    """
    for c in new.columns:
        if c not in old.columns:
            if required and c in required:
                raise ValueError(f"old rows lack the column {c}")
            old = old.withColumn(c, F.lit(OPTIONAL_DEFAULTS.get(c)).cast(new.schema[c].dataType))
    return old.select(*new.columns).unionByName(new)


def merge_rows(old: DataFrame, new: DataFrame, new_segments: DataFrame, key: str = "video_id", eps: float = 1e-6) -> DataFrame:
    """Rows after a merge: old ones outside all new segments of their video, and all new ones."""
    return union_by_name(intervals.outside(old, new_segments, key, "t", eps), new)


def same_videos(old: DataFrame, new: DataFrame, key: str = "video_id") -> None:
    """Raises ValueError if one of two tracks (or sets of tracks) is of a video that the other is not."""
    for a, b in ((old, new), (new, old)):
        odd = a.select(key).distinct().join(b.select(key), key, "left_anti").orderBy(key).first()
        if odd:
            raise ValueError(f"cannot merge tracks of different videos: {odd[0]}")


def merge_tracks(old: dict[str, DataFrame], new: dict[str, DataFrame], eps: float = 1e-6, strict: bool = False) -> dict[str, DataFrame]:
    """rows and segments of both; eps 1e-6 is the pipeline's rule, 0 the service's. `strict`: both must be of the same videos, and old rows must have all required columns."""
    if strict:
        same_videos(old["segments"], new["segments"])
        return {"rows": union_by_name(intervals.outside(old["rows"], new["segments"], "video_id", "t", eps), new["rows"], [c for c in new["rows"].columns if c not in OPTIONAL_DEFAULTS]), "segments": intervals.union(old["segments"].unionByName(new["segments"]), eps=eps)}
    return {"rows": merge_rows(old["rows"], new["rows"], new["segments"], eps=eps), "segments": intervals.union(old["segments"].unionByName(new["segments"]), eps=eps)}


def all_columns(old: DataFrame, new: DataFrame) -> DataFrame:
    """The union of both sets of columns, old's order first."""
    return old.unionByName(new, allowMissingColumns=True)
