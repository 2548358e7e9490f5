"""Vectors as whole numbers, for the operators that must be exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A component x becomes floor(SCALE * x), held within +-WIDEST: sums of products of 16,000 components then fit 64 bits.
SCALE, WIDEST = 256, 1 << 24


def finite(vector: str):
    """Whether a vector is there, without null components or numbers that are not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(vector).isNotNull() & fine


def integer_vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows of ``table`` whose vector is finite, with the whole numbers ``ints`` in the vector's place."""
    whole = F.transform(
        vector, lambda x: F.least(F.greatest(F.floor(x.cast("double") * SCALE), F.lit(-WIDEST)), F.lit(WIDEST)).cast("int")
    )
    return table.filter(finite(vector)).withColumn("ints", whole).drop(vector)


def int_matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column as 64-bit numbers, shorter ones with zeros at their end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out
