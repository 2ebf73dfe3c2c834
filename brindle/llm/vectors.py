"""Array columns of numbers as packed doubles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import map_arrow


def matrix(column: pa.Array) -> list[np.ndarray | None]:
    """Each row's vector in double precision; None if it is null, empty or holds null or non-finite components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out: list[np.ndarray | None] = []
    flat = column.values
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # null components become NaN
    at = np.asarray(column.offsets)
    null = np.asarray(column.is_null())
    for i in range(len(column)):
        x = values[at[i] : at[i + 1]]
        out.append(None if null[i] or not len(x) or not np.isfinite(x).all() else x)
    return out


def plain(table: DataFrame) -> str:
    """Numbers that hold the components of ``table``'s embeddings exactly, in the fewest bytes."""
    kind = table.schema["embedding"].dataType
    return "<f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "<f8"


def packed(table: DataFrame, change, kind: str = "<f8") -> DataFrame:
    """(vec_id, dim, vector binary): ``change`` turns each usable vector into numbers, or None to leave it out."""

    def make(batch: pa.RecordBatch) -> dict:
        ids, dims, vectors = [], [], []
        for i, x in zip(batch.column("vec_id").to_pylist(), matrix(batch.column("embedding")), strict=True):
            y = None if x is None or i is None else change(x)
            if y is not None:
                ids.append(i)
                dims.append(len(y))
                vectors.append(np.ascontiguousarray(y, kind).tobytes())
        return {"vec_id": ids, "dim": dims, "vector": vectors}

    chosen = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return map_arrow(chosen, "vec_id long, dim int, vector binary", make, None)


def stacked(column: list[bytes], dim: int) -> np.ndarray:
    """Vectors of ``dim`` components as a matrix of doubles."""
    data = b"".join(column)
    return np.frombuffer(data, "<f4" if len(data) == 4 * dim * len(column) else "<f8").reshape(len(column), dim).astype(np.float64, copy=False)
