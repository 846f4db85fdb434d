"""Fitted cleaning applied to a stream.

The reference has no streaming operator. What carries over is the fit /
transform split of the cleaning steps: statistics are fitted once on a batch
(history) DataFrame, and the fitted transform is a set of row-local column
expressions, so it runs unchanged inside a Structured Streaming query
(``readStream`` -> transform -> ``writeStream``) with no state.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean as C
from ..session import scratch_path


@dataclass
class FittedCleaner:
    """Row-local cleaning fitted on a batch frame."""

    fills: dict = field(default_factory=dict)        # column -> constant
    casts: dict = field(default_factory=dict)        # column -> dtype name of clean.convert_type
    bounds: dict = field(default_factory=dict)       # column -> outlier bounds dict
    domains: dict = field(default_factory=dict)      # column -> one-hot domain

    @classmethod
    def fit(cls, df: DataFrame, fill: dict[str, str] | None = None, casts: dict[str, str] | None = None,
            outliers: dict[str, str] | None = None, onehot: list[str] | None = None) -> "FittedCleaner":
        f = cls(casts=dict(casts or {}))
        for c, method in (fill or {}).items():
            v = C.fit_fill_value(df, c, method)
            if v is not None:
                f.fills[c] = v
        filled = df
        for c, v in f.fills.items():
            filled = C.apply_fill(filled, c, v)
        for c, method in (outliers or {}).items():
            b = C.fit_outlier_bounds(filled, c, method)
            if b is not None:
                f.bounds[c] = b
        for c in onehot or []:
            f.domains[c] = C.fit_domain(df, c)
        return f

    def transform(self, df: DataFrame) -> DataFrame:
        """Apply fills, type casts, outlier filters and one-hot columns (no actions)."""
        out = df
        for c, v in self.fills.items():
            out = C.apply_fill(out, c, v)
        for c, dt in self.casts.items():
            out = out.withColumn(c, C.type_expr(out, c, dt))
        keep: Column | None = None
        for c, b in self.bounds.items():
            cond = C.inlier_expr(c, b)
            keep = cond if keep is None else keep & cond
        if keep is not None:
            out = out.filter(keep)
        for c, dom in self.domains.items():
            out = C.onehot(out, c, dom)
        return out


def parquet_stream(spark: SparkSession, directory: str, file_glob: str, schema) -> DataFrame:
    """A file stream over the parquet files of a directory that match ``file_glob``."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
            .option("maxFilesPerTrigger", 1).parquet(directory))


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream to completion (availableNow) into parquet files of the shared
    folder; return them as a batch frame."""
    spark = stream.sparkSession
    path = scratch_path(spark, f"stream-{name}-out")
    q = (stream.writeStream.format("parquet").option("path", path).outputMode("append")
         .option("checkpointLocation", scratch_path(spark, f"stream-{name}"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
