"""Embedding whitening: blockwise QR, Householder bidiagonal form, dqds, twisted factorisations.

Entries become integers (floor of 256 times the entry). The fit list holds each
distinct integer vector once, so copies don't weigh. Tasks reduce their centred
rows, a block at a time, to a d x d triangle; triangles are stacked and reduced
again, ``FAN`` at a time, until one is left. Only that triangle (d is the vectors'
length) reaches the driver, where it is brought to bidiagonal form; dqds finds
its singular values, twisted factorisations the directions of the largest ones.
Covariances are never formed: no entry is squared before it is centred.

Defined results: rows whose vector is null or empty, holds null or non-finite
entries, or has another length than most vectors have are left out; a direction
without variance to working precision has no whitened value and is left out, so
an empty table, or one distinct vector, gives an empty result; repeated rows each
give their rows; the sign of a direction makes its largest entry positive; a
``deviation`` beyond a long is null; further columns are kept, but for those of the
result's own names, which it replaces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import qd, vectors
from .common import arrow_map

COMPONENTS = 4
FAN = 32
OUTPUTS = ("component", "n", "deviation", "whitened", "explained", "identity_error")


@dataclass
class Whitening:
    """Exact sums of the fit list, and directions scaled to unit variance (d x k)."""

    d: int
    n: int
    sums: list[int]
    directions: np.ndarray
    explained: list[float]
    identity_error: float = 0.0

    def __post_init__(self):
        whole = [s // self.n for s in self.sums]
        self.pivot = np.array(whole, object)
        self.fraction = np.array([float(Fraction(s, self.n) - w) for s, w in zip(self.sums, whole, strict=True)])

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n as doubles: the whole part is taken off in integers."""
        if max(int(x.max()), -int(x.min()), int(np.abs(self.pivot).max())) < 1 << 61:
            return (x - self.pivot.astype(np.int64)).astype(float) - self.fraction
        return (x.astype(object) - self.pivot).astype(float) - self.fraction

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) squared, exact; None beyond a long."""
        most = self.n * max(int(x.max()), -int(x.min())) + max(map(abs, self.sums))
        if self.d * most * most < 1 << 63:
            y = self.n * x - np.array(self.sums, np.int64)
            return (y * y).sum(axis=1).tolist()
        y = self.n * x.astype(object) - np.array(self.sums, object)
        return [s if s < 1 << 63 else None for s in (y * y).sum(axis=1).tolist()]

    def values(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.directions


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Exact number of rows and sum of each dimension: halves of 32 bits, added as decimals."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = vectors.matrix(batch.column("x"), d)
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(high), pa.array(low)],
                                             names=["pos", "n", "high", "low"])

    big = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    rows = arrow_map(fit, run, "pos int, n long, high long, low long").groupBy("pos").agg(F.sum("n").alias("n"), big("high"), big("low")).collect()
    rows.sort(key=lambda r: r.pos)
    return (int(rows[0].n) if rows else 0), [(int(r.high) << 32) + int(r.low) for r in rows]


def _triangle(block: np.ndarray) -> np.ndarray:
    """The d x d triangle of a QR factorisation; rows of zeros stand for missing ones."""
    r = np.linalg.qr(block, mode="r")
    d = block.shape[1]
    return r if len(r) == d else np.vstack([r, np.zeros((d - len(r), d))])


def _reduced(fit: DataFrame, centre: Whitening) -> np.ndarray:
    """The triangle of all centred rows of the fit list."""
    d = centre.d

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            if batch.num_rows:
                r = _triangle(np.vstack([r, centre.centred(vectors.matrix(batch.column("x"), d))]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel()], pa.list_(pa.float64()))], names=["r"])

    def of_triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for batch in batches:
            for one in batch.column("r"):
                r = _triangle(np.vstack([r, np.array(one.values).reshape(d, d)]))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([r.ravel()], pa.list_(pa.float64()))], names=["r"])

    parts = vectors.stored(arrow_map(fit, of_rows, "r array<double>"), "triangles")
    while (left := parts.count()) > 1:
        parts = vectors.stored(arrow_map(parts.repartition(math.ceil(left / FAN)), of_triangles, "r array<double>"), "triangles")
    return np.array(parts.first().r).reshape(d, d)


def fit(rows: DataFrame, d: int, k: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct vectors ``x`` of ``rows``; None without rows."""
    if not d:
        return None
    distinct = vectors.stored(rows.select("x").distinct(), "distinct-vectors")
    n, sums = _sums(distinct, d)
    if not n:
        return None
    centre = Whitening(d, n, sums, np.zeros((d, 0)), [])
    squares, directions = qd.leading(_reduced(distinct, centre), k)
    kept = directions.shape[1]
    for j in range(kept):
        if directions[np.argmax(np.abs(directions[:, j])), j] < 0:
            directions[:, j] *= -1.0
    total = math.fsum(squares)
    found = Whitening(d, n, sums, directions / np.sqrt(squares[:kept] / n), [float(s / total) for s in squares[:kept]])
    found.identity_error = _identity_error(distinct, found)
    return found


def _identity_error(distinct: DataFrame, found: Whitening) -> float:
    """Largest entry of the whitened fit list's covariance minus the identity, as measured over its rows."""
    k = found.directions.shape[1]
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = found.values(vectors.matrix(batch.column("x"), found.d)) if batch.num_rows else np.zeros((0, k))
            yield pa.RecordBatch.from_arrays([pa.array(w[:, j]) for j in range(k)], names=[f"w{j}" for j in range(k)])

    w = arrow_map(distinct, run, ", ".join(f"w{j} double" for j in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = w.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def whitened(df: DataFrame, vec_col: str = "embedding", k: int = COMPONENTS, id_col: str | None = None) -> DataFrame:
    """A row for each row of ``df`` (or its column ``id_col`` alone) and each of the first
    ``k`` components: the caller's columns with ``component``, ``n``, ``deviation``,
    ``whitened``, ``explained`` and ``identity_error``."""
    keep = [c for c in (df.columns if id_col is None else [id_col]) if c not in OUTPUTS]
    named = df.select(*(vectors.column(df, c).alias(f"k{i}") for i, c in enumerate(keep)), vectors.column(df, vec_col).alias("v"))
    rows, d = vectors.of_common_length(vectors.integer_vectors(named, F.col("v")).drop("v"))
    found = fit(rows, d, k)
    fields = rows.schema.fields[:-1]
    schema = T.StructType([*fields, T.StructField("deviation", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
    if found is None or not found.directions.shape[1]:
        out, n, explained, error = df.sparkSession.createDataFrame([], schema), 0, [0.0], 0.0
    else:
        n, explained, error = found.n, found.explained, found.identity_error

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = vectors.matrix(batch.column("x"), found.d)
                    w = found.values(x)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.deviations(x), pa.int64()), lists], schema=None,
                                                     names=[*batch.schema.names[:-1], "deviation", "w"])

        out = arrow_map(rows, run, schema)
    shares = F.array(*map(F.lit, explained))
    return (out.select(*(f.name for f in fields), "deviation", F.posexplode("w").alias("p", "whitened"))
            .select(*(F.col(f.name) for f in fields), (F.col("p") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                    F.element_at(shares, F.col("p") + 1).alias("explained"), F.lit(error).alias("identity_error"))
            .toDF(*keep, *OUTPUTS))
