"""expand_track(doc): a table function for SQL and lateral joins that reads a track document row by row."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from ..config import DEFAULT_RING

RETURNS = "pos int, t double, x double, y double, r double, conf double, ring string, flags int, sl double, sa double"
_BLANK = re.compile(r"[ \t\r\n]*")
_RING = re.compile(r"#[0-9a-fA-F]{6}\Z")
_ONE = json.JSONDecoder()


def _skip(doc: str, at: int, mark: str | None = None) -> int:
    """The place after white space, and after `mark` if that is due."""
    at = _BLANK.match(doc, at).end()
    if mark is not None:
        if doc[at : at + 1] != mark:
            raise ValueError(f"no {mark} at {at}")
        at = _BLANK.match(doc, at + 1).end()
    return at


def _items(doc: str, at: int) -> Iterator[tuple[object, int]]:
    """The values of the array that begins at `at`, one by one, each with the place after it; the last item is None with the array's end."""
    at = _skip(doc, at, "[")
    first = True
    while doc[at : at + 1] != "]":
        at = at if first else _skip(doc, at, ",")
        value, at = _ONE.raw_decode(doc, at)
        at, first = _skip(doc, at), False
        yield value, at
    yield None, at + 1


def _checked(doc: str) -> tuple[object, int]:
    """The document's fields and where its rows begin (-1: none); raises ValueError for text that is no JSON object."""
    at, fields, rows = _skip(doc, 0, "{"), None, -1
    while doc[at : at + 1] != "}":
        name, at = _ONE.raw_decode(doc, at)
        at = _skip(doc, at, ":")
        if name == "frames" and doc[at : at + 1] == "[":
            rows = at
            for _, at in _items(doc, at):  # read over, not kept
                pass
        else:
            value, at = _ONE.raw_decode(doc, at)
            fields = value if name == "fields" else fields
            rows = -1 if name == "frames" else rows
        at = _skip(doc, at)
        if doc[at : at + 1] == ",":
            at = _skip(doc, at, ",")
            if doc[at : at + 1] == "}":
                raise ValueError("a comma before the end")
        elif doc[at : at + 1] != "}":
            raise ValueError(f"no end at {at}")
    if _skip(doc, at + 1) != len(doc):
        raise ValueError("text after the end")
    return fields, rows


def _number(v: object) -> float | None:
    try:
        return float(v) if isinstance(v, (int, float, str)) else None
    except (ValueError, OverflowError):
        return None


class ExpandTrack:
    """Rows of one document as sources.tracks.rows() gives them: columns by name in any order, others ignored, odd values replaced.

    The document is checked in one pass that keeps no row and read in a second that holds one, so a document's rows are never in memory together.
    Text that is no JSON object, or has no `frames`, has no rows; without `fields` no column is known.
    """

    def eval(self, doc: str | None) -> Iterator[tuple]:
        try:
            fields, at = _checked(doc or "")
        except (ValueError, RecursionError):
            return
        if at < 0:
            return
        place = {n: k for k, n in reversed(list(enumerate(fields if isinstance(fields, list) else []))) if isinstance(n, str)}
        for pos, (row, _) in enumerate(_items(doc, at)):
            if isinstance(row, list):
                cell = lambda n: row[place[n]] if n in place and place[n] < len(row) else None  # noqa: B023, E731
                ring, flags = cell("ring"), _number(cell("flags"))
                sl, sa = _number(cell("sl")), _number(cell("sa"))
                yield (
                    pos, *(_number(cell(c)) for c in ("t", "x", "y", "r", "conf")), ring.lower() if isinstance(ring, str) and _RING.match(ring) else DEFAULT_RING,
                    int(flags) & 255 if flags is not None and math.isfinite(flags) else 0, sl if sl is not None and sl > 0 else 0.0, sa if sa is not None and math.isfinite(sa) else 0.0,
                )


def register(spark: SparkSession, name: str = "expand_track") -> None:
    """Makes the function known to the session's SQL: SELECT r.* FROM docs, LATERAL expand_track(doc) r."""
    spark.udtf.register(name, udtf(ExpandTrack, returnType=RETURNS))


def expanded(docs: DataFrame, keys: list[str], doc: str = "doc") -> DataFrame:
    """keys and the rows of each document."""
    spark = docs.sparkSession
    register(spark)
    cols = ", ".join(f"d.`{k}`" for k in keys)
    return spark.sql(f"SELECT {cols}, r.* FROM {{docs}} d, LATERAL expand_track(d.`{doc}`) r", docs=docs)
