"""Adding up fixed-length integer vectors that tasks made, without a row for every entry."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MERGERS = 16


def packed(values: np.ndarray) -> pa.RecordBatch:
    """One row for the sums of one task."""
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(values, np.int64).tobytes()], pa.binary())], names=["sums"])


def added(rows: DataFrame, width: int) -> np.ndarray:
    """Sum of all rows of ``packed`` vectors of one width: a few tasks add them up and one task their sums, so that the
    driver gets one vector however many tasks there were."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for b in batches:
            for v in b.column(0):
                total += np.frombuffer(v.as_py(), np.int64)
        yield packed(total)

    few = rows.repartition(MERGERS).mapInArrow(add, "sums binary")
    (one,) = few.repartition(1).mapInArrow(add, "sums binary").collect()
    return np.frombuffer(bytes(one.sums), np.int64).copy()
