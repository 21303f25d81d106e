"""Order-dependent steps over sorted rows: one pass over each partition, a state carried from row to row."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def plain(pdf: pd.DataFrame) -> pd.DataFrame:
    """Values as Python has them, None for what is missing: two missing ones are equal then."""
    return pdf.astype(object).where(pdf.notna(), None)


def changes(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Whether each row but the first has another key than the one before; two missing values are equal."""
    new = np.zeros(max(0, len(pdf) - 1), bool)
    for c in keys:
        v, none = pdf[c].to_numpy(), pdf[c].isna().to_numpy()
        new |= (v[1:] != v[:-1]) & ~(none[1:] & none[:-1])
    return new


def fold_sorted(rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, tuple], tuple[Any, tuple | None]], inputs: list[str], out: str) -> DataFrame:
    """keys and the columns of `out` (as DDL): what step(state, inputs) gives for each row in order, None for no row.

    Rows are dealt by key and sorted within partitions; Arrow batches pass through, so however long a key's series, a task holds
    one batch and one state. Rows whose key is null, or not a number, are one series.
    """
    head = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    names = [*keys, *(c.split()[0] for c in out.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in batches:
            got = []
            for key, values in zip(plain(pdf[keys]).itertuples(index=False, name=None), plain(pdf[inputs]).itertuples(index=False, name=None), strict=True):
                if key != last:
                    last, state = key, start()
                state, row = step(state, values)
                if row is not None:
                    got.append((*key, *row))
            yield pd.DataFrame(got, columns=names)

    ordered = rows.select(*dict.fromkeys([*keys, *order, *inputs])).repartition(*keys).sortWithinPartitions(*keys, *order)
    return ordered.mapInPandas(run, f"{head}, {out}")
