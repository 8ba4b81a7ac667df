"""Texts of Arrow columns, a bounded number of bytes at a time, and models that one task fits."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

PART_BYTES = 8 << 20


def text_parts(column: pa.Array, most: int = PART_BYTES) -> Iterator[list[str | None]]:
    """The texts of a string column in order, as lists of whole texts of about ``most`` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(column):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield column.slice(at, stop - at).to_pylist()
        at = stop


def fitted(rows: DataFrame, fit: Callable[[list[dict]], Any]) -> Any:
    """What ``fit`` makes of all ``rows``, a bounded sample, in one task: the driver holds the result, never the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.dumps(fit([row for batch in batches for row in batch.to_pylist()]), pickle.HIGHEST_PROTOCOL)
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], ["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else fit([])  # a plan known to be empty has no task
