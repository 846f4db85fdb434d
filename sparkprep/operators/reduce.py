"""Dimension reduction: PCA on CENTRED data (Spark's PCA does not centre in
``transform``), explained-variance ratios and reconstruction error."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import quoted
from . import prep


def pca(df: DataFrame, cols: list[str], k: int = 2, scale: bool = False) -> tuple[DataFrame, list[float], list[list[float]]]:
    """Returns (projections with ``pc`` array, variance ratios, components)."""
    if k > len(cols):
        raise ValueError("n_components must be <= number of features")
    fit = prep.fit_scaler(df, cols)
    if not scale:
        fit = {c: (m, 1.0) for c, (m, _) in fit.items()}
    d = prep.apply_scaler(df, fit)
    v = d.withColumn("_x", array_to_vector(F.array(*[quoted(c).cast("double") for c in cols])))
    model = PCA(k=k, inputCol="_x", outputCol="_pc").fit(v)
    out = model.transform(v).withColumn("pc", vector_to_array("_pc")).drop("_x", "_pc")
    comps = model.pc.toArray().T.tolist()
    return out, [float(x) for x in model.explainedVariance], comps


def variance_ratio(df: DataFrame, cols: list[str], k: int | None = None, scale: bool = False) -> DataFrame:
    k = k or len(cols)
    _, ratios, _ = pca(df, cols, k, scale)
    return df.sparkSession.createDataFrame([(i + 1, r) for i, r in enumerate(ratios)], "component int, ratio double")


def reconstruction_error(df: DataFrame, cols: list[str], k: int, scale: bool = True) -> DataFrame:
    """Mean squared residual per value after projecting on ``k`` components."""
    out, _, comps = pca(df, cols, k, scale)
    z = [quoted(c) for c in cols]  # ``out`` holds the centred (and scaled) values
    rec = [sum(F.col("pc")[j] * F.lit(comps[j][i]) for j in range(k)) for i in range(len(cols))]
    sq = sum((zi - ri) * (zi - ri) for zi, ri in zip(z, rec))
    return out.agg((F.avg(sq) / len(cols)).alias("reconstruction_error"))
