"""Whole texts in Python functions of columns: by small Arrow batches, a few texts at a time."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(rows: int = 1000) -> None:
    """Texts go to Python in batches of `rows` rows, unless the session has its own setting: 10,000, the default, are tens of megabytes in
    each worker, and several times that as Python objects."""
    spark = SparkSession.active()
    if spark.conf.get(ARROW_ROWS, None) is None:
        spark.conf.set(ARROW_ROWS, rows)


def by_few(of: Callable, kind: pa.DataType, *columns: pa.Array, rows: int = 32) -> pa.Array:
    """of(value, ...) for each row; Python objects of `rows` rows are there at a time."""
    parts = (pa.array([of(*row) for row in zip(*(c[k : k + rows].to_pylist() for c in columns), strict=True)], kind) for k in range(0, len(columns[0]), rows))
    return pa.concat_arrays([pa.array([], kind), *parts])
