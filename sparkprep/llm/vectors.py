"""Rows of integer vectors: shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import reliable

SCALE = 256


def column(df: DataFrame, name: str) -> Column:
    """The column called ``name``, whatever characters the name holds."""
    return df[f"`{name.replace('`', '``')}`"]


def integer_vectors(rows: DataFrame, vec: Column, out: str = "x") -> DataFrame:
    """``rows`` whose vector is neither null nor empty and holds only finite entries,
    with ``out``: array<long> of floor(256 * entry), the entry as a double. Beyond the
    range of a long an entry stays at its end."""
    v = vec.cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return (rows.filter(vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(fine, F.lit(False)))
            .withColumn(out, F.transform(v, lambda c: F.floor(c * float(SCALE)).cast("long"))))


def of_common_length(rows: DataFrame, vec: str = "x") -> tuple[DataFrame, int]:
    """The rows whose vector has the most frequent length (of equally frequent ones
    the greatest), and that length; 0 for an empty table."""
    top = rows.groupBy(F.size(vec).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return (rows.filter(F.size(vec) == top.d), int(top.d)) if top else (rows, 0)


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The int64 matrix of an Arrow column of lists of ``d`` longs."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


__all__ = ["SCALE", "column", "integer_vectors", "matrix", "of_common_length", "reliable", "stored"]
