"""Vectors of a table that can be compared, and a bounded sample of them for an index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id long, vec array<double>) of the rows that can be compared: an id, no null or non-finite component, not all
    zero, and as long as most vectors are (of equally frequent lengths the shorter)."""
    v = F.col("vec")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0")
    rows = rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).where(F.exists(v, lambda x: x != 0))
    length = rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    return rows.where(F.size("vec") == (length["n"] if length else 0))


def matrix(col: pa.Array) -> np.ndarray:
    """A list column of equally long vectors."""
    if len(col) == 0:
        return np.zeros((0, 0))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(col), -1)


def lists(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(rows).reshape(-1)))
