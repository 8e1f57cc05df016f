"""Small groups of a sorted partition, without one Arrow exchange per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Stands for a missing time on the way through pandas; no timestamp lies there.
_NO_TIME = -(2**63)


def map_any_time(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: T.StructType) -> DataFrame:
    """``df.mapInPandas(fn, schema)`` for times of any year.

    pandas counts nanoseconds, which end in the year 2262. So ``fn`` gets the timestamps of ``df`` as
    microseconds since 1970, which it may compare and must pass on as they are.
    """

    def is_time(field: T.StructField) -> bool:
        return isinstance(field.dataType, T.TimestampType)

    def column(field: T.StructField) -> Column:
        return F.col(f"`{field.name}`")

    sent = df.select(*[F.coalesce(F.unix_micros(column(f)), F.lit(_NO_TIME)).alias(f.name) if is_time(f) else column(f)
                       for f in df.schema])
    wire = T.StructType([T.StructField(f.name, T.LongType()) if is_time(f) else f for f in schema])
    back = sent.mapInPandas(fn, wire)
    return back.select(*[F.timestamp_micros(F.nullif(column(f), F.lit(_NO_TIME))).alias(f.name) if is_time(f) else column(f)
                         for f in schema])


def stream_groups(groups: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame]):
    """A ``mapInPandas`` function that calls ``fn`` for each run of equal ``groups``.

    The partition must be sorted by ``groups``. One group is held at a time, so groups must
    be bounded by construction (a tile, a chunk).
    """
    groups = list(groups)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        current = None
        for batch in batches:
            if not len(batch):
                continue
            names = list(zip(*[batch[g].tolist() for g in groups]))
            starts = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]]]
            ready = []
            for k, start in enumerate(starts):
                stop = starts[k + 1] if k + 1 < len(starts) else len(names)
                if held and names[start] != current:
                    ready.append(fn(pd.concat(held, ignore_index=True)))
                    held = []
                held.append(batch.iloc[start:stop])
                current = names[start]
            if ready:
                yield pd.concat(ready, ignore_index=True)
        if held:
            yield fn(pd.concat(held, ignore_index=True))

    return run


def whole_groups(groups: Sequence[str], fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame]):
    """A ``mapInPandas`` function that calls ``fn(rows, first)`` for all groups that end in a batch at once.

    ``first`` is the number of the row at which a row's group starts. The partition must be
    sorted by ``groups``, and groups be bounded, as above; small ones cost no call each.
    """
    groups = list(groups)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            new = np.ones(len(rows), dtype=bool)
            new[1:] = False
            for g in groups:
                names = rows[g].to_numpy()
                new[1:] |= names[1:] != names[:-1]
            first = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
            last = int(first[-1])
            held = rows.iloc[last:]
            if last:
                yield fn(rows.iloc[:last], first[:last])
        if held is not None:
            yield fn(held.reset_index(drop=True), np.zeros(len(held), dtype=np.int64))

    return run
