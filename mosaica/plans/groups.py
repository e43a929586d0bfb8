"""Grouped work in Arrow batches without a Python call frame for each group's table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def map_groups(df: DataFrame, key: str, fn: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Apply `fn` to the rows of each key, sorted by `order`; one shuffle, groups stream through in key order.

    A group must fit in a worker's memory. Nothing is held but the group at
    hand, however many a task has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None

        def done(parts: list[pd.DataFrame]) -> pd.DataFrame | None:
            return fn(parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True))

        for pdf in batches:
            if not len(pdf):
                continue
            keys = pdf[key].to_numpy()
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            outs = []
            for a, b in zip([0, *cuts], [*cuts, len(pdf)], strict=True):
                part = pdf.iloc[a:b]
                if held and keys[a] != last:
                    outs.append(done(held))
                    held = []
                held.append(part.reset_index(drop=True))
                last = keys[a]
            outs = [o for o in outs if o is not None and len(o)]
            if outs:
                yield pd.concat(outs, ignore_index=True)
        if held and (out := done(held)) is not None and len(out):
            yield out

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
