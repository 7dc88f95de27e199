"""Vector columns: which rows take part, and their matrices inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.session import materialize


def usable(vector: str | Column) -> Column:
    """Not null, not empty, and every component a finite number."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite), F.lit(False))


def numbered(rows: DataFrame, key: str, vector: str, kind: str = "double") -> DataFrame:
    """Stored ``row_id, signal_id, vector, dims, usable``: one row for each input row, in any case."""
    cells = F.when(usable(vector), F.col(vector)).cast(f"array<{kind}>")
    return materialize(rows.select(F.monotonically_increasing_id().alias("row_id"), F.col(key).cast("bigint").alias("signal_id"), cells.alias("vector"), F.size(cells).alias("dims")))


def matrix(column: pa.Array | pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    """Lists of one length as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(n, -1) if n else np.zeros((0, 0), kind)
