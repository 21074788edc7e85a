"""Vector columns as matrices and as integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: An entry of a vector is turned into floor(STEPS * entry).
STEPS = 256


def matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Rows of equal length, without nulls."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), dtype=kind)


def listed(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column of the rows of a matrix."""
    return pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1), type=kind), x.shape[1]).cast(pa.list_(kind))


def common_length(vectors: DataFrame, vector: str) -> int:
    """The length that most vectors have, the smaller one of equals; 0 without any vector that has entries."""
    found = (vectors.select(F.size(vector).alias("_d")).filter("_d > 0").groupBy("_d").agg(F.count("*").alias("_n"))
             .orderBy(F.desc("_n"), "_d").first())
    return found["_d"] if found else 0


def integers(vector: Column) -> Column:
    """floor(STEPS * entry) of each entry, as longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS))


def takes_part(vector: Column, dim: int, limit: float) -> Column:
    """Not null, of the common length, every entry finite and STEPS times it below the limit."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) * STEPS >= limit))
    return F.lit(dim > 0) & vector.isNotNull() & (F.size(vector) == dim) & ~bad
