"""Looking through sorted partitions as streams of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _same(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Whether each row but the first has the keys of the one before."""
    same = np.ones(max(len(rows) - 1, 0), bool)
    for key in keys:
        values = rows[key].to_numpy()
        same &= values[1:] == values[:-1]
    return same


def runs(rows: DataFrame, keys: list[str], order: list[str], first: bool) -> DataFrame:
    """Rows whose keys (numbers, never null) occur more than once, in runs sorted by ``order``.

    With ``first`` all of them, without it all but the first of each run. Rows are dealt and
    sorted by their keys and then only looked through, one batch at a time; so a run of any
    length needs no memory.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, inside = None, False
        for batch in batches:
            if not len(batch):
                continue
            if held is not None:
                batch = pd.concat([held, batch], ignore_index=True)
            same = np.concatenate([[inside], _same(batch, keys)])
            keep = same.copy()
            if first:
                keep[:-1] |= same[1:]
            yield batch.iloc[:-1][keep[:-1]]
            held, inside = batch.iloc[-1:], bool(same[-1])
        if inside:
            yield held

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInPandas(look, rows.schema)
