"""Ids of records and queries: numbers or strings, whichever a table has."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegralType


def kind(df: DataFrame, column: str = "id") -> str:
    """The type that ids of a column are taken as: bigint for whole numbers, string for all else."""
    return "bigint" if isinstance(df.schema[column].dataType, IntegralType) else "string"


def array(column: pa.Array | pa.ChunkedArray | list, of: str) -> np.ndarray:
    """Ids as a numpy array that sorts as Spark sorts them."""
    values = column if isinstance(column, list) else column.to_pylist() if of == "string" else column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return np.array(values, np.str_ if of == "string" else np.int64)


def empty(of: str) -> np.ndarray:
    return np.zeros(0, np.str_ if of == "string" else np.int64)


def arrow(of: str) -> pa.DataType:
    return pa.string() if of == "string" else pa.int64()
