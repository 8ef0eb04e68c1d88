"""Vectors as exact integers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Integer components are below this in size, so that squared distances and products of vectors fit 64 bits.
LARGEST = 1 << 27


def integer_vectors(df: DataFrame, scale: int, id_col: str, vector_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_, kept columns, vector_): components as floor(scale * x), for rows whose vector is whole.

    Rows without a vector, with an empty one, or with a null or non-finite component are dropped,
    and so are those of another width than the row of least id.  Components of ``LARGEST / scale`` or
    more have no exact 64-bit results and are an error.
    """
    x = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    bad = F.exists("x_", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    whole = df.select(F.col(id_col).cast("long").alias("id_"), *keep, x.alias("x_")).where((F.size("x_") > 0) & ~bad)
    first = whole.orderBy(F.asc_nulls_last("id_"), F.size("x_")).select(F.size("x_")).first()
    large = F.exists("x_", lambda v: F.abs(v * scale) >= LARGEST)
    exact = F.transform("x_", lambda v: F.floor(v * scale))
    error = F.raise_error(F.lit(f"a component of {LARGEST // scale} or more")).cast("array<bigint>")
    return whole.where(F.size("x_") == F.lit(first[0] if first else 0)).select("id_", *keep, F.when(large, error).otherwise(exact).alias("vector_"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal widths as rows of 64-bit integers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // max(1, len(column)))
