"""What the two vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows of one side in one block of comparisons
BLOCK = 1024


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(_key, vector: array<double>) of the rows that can be compared.

    Null, empty and zero vectors, vectors with null, NaN or infinite components, and rows with a null id are
    left out, and so are vectors of another length than most rows have (of equally many the shorter).
    """
    vectors = rows.select(F.col(id_col).cast("long").alias("_key"), F.col(vector_col).cast("array<double>").alias("vector"))
    vectors = vectors.where(
        F.col("_key").isNotNull() & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    common = vectors.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return vectors.where(F.size("vector") == (common["d"] if common else 0))


def sample(vectors: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the ``n`` rows with the smallest hashed ids; the bound of what comes to the driver."""
    found = vectors.orderBy(F.xxhash64("_key"), "_key").limit(n).collect()
    return np.array([r["_key"] for r in found], np.int64), np.array([r["vector"] for r in found], float)


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of equally long lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither vanish nor overflow."""
    if not len(x):
        return x
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))
