"""What the operators on embeddings share: the table, and integer components in numpy."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Rows that are worked on at once in a task.
ROWS = 8192
#: Whole numbers up to here are exact as doubles.
EXACT = 2**53


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def finite(vector: F.Column) -> F.Column:
    """True where a vector of doubles is there and all its components are finite numbers."""
    good = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    return F.coalesce(good, F.lit(False))


def doubles(column: str = "embedding") -> F.Column:
    return F.col(column).cast("array<double>")


def whole(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) of doubles as 64-bit integers; what does not fit raises an error."""
    scaled = np.floor(256.0 * values)
    if scaled.size and np.abs(scaled).max() >= 2**62:
        raise OverflowError("a component is too large for 64-bit arithmetic")
    return scaled.astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices, as 64-bit integers.

    In doubles where every partial sum is exact there, else in 64 bits; a product that may not
    fit raises an error.
    """
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 2**63:
        raise OverflowError("components are too large for 64-bit inner products")
    return a @ b.T


def matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    """Rows of a list column without nulls as a matrix; short rows end in zeros, long are cut."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), dtype)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row[place < width], place[place < width]] = values[place < width]
    return out


def lists(values: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as a list column."""
    starts = np.arange(len(values) + 1, dtype=np.int32) * np.int32(values.shape[1])
    return pa.ListArray.from_arrays(starts, values.ravel())
