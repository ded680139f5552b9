"""Embedding tables as matrices: which vectors take part, and their rows out of Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column, limit: float = float("inf")) -> Column:
    """True where a vector isn't null and all its components are numbers below `limit` in size."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < limit)), F.lit(False))


def common_length(rows: DataFrame, vector: str = "embedding") -> int:
    """The length that most finite vectors have, of equally frequent ones the largest; 0 without any."""
    sizes = rows.filter(finite(F.col(vector))).groupBy(F.size(vector).alias("n")).agg(F.count("*").alias("rows"))
    most = sizes.orderBy(F.desc("rows"), F.desc("n")).first()
    return most["n"] if most else 0


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a batch as rows in double precision; none is null and all have `dims` components."""
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dims)
