"""Small helpers for work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema) -> DataFrame:
    """``mapInArrow`` whose worker yields dicts of columns instead of record batches."""
    empty = df.sparkSession.createDataFrame([], schema)
    arrow = to_arrow_schema(empty.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in work(batches):
            arrays = [c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(arrays, names=arrow.names)

    return df.mapInArrow(run, empty.schema)


def slices(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a slice holds about ``max_bytes`` of the column ``text`` (one row at least)."""
    for batch in batches:
        column = batch.column(text)
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end positions of the runs of equal neighbours."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
    return starts, np.append(starts[1:], len(keys))
