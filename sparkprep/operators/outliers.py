"""Outlier detection, summaries and chart data (the data, not the picture)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import named, quoted, rnd
from ..sources.ingest import column_kind
from . import scan
from .clean import fit_outlier_bounds, outlier_expr


def detect_outliers(df: DataFrame, col: str, method: str = "IQR", approx: bool = False) -> DataFrame:
    """One summary row: method, total_outliers, outlier_percentage (of ALL rows), bounds."""
    b = fit_outlier_bounds(df, col, method, approx)
    if b is None:
        return df.agg(F.count(F.lit(1)).alias("_n")).select(
            F.lit(col).alias("column"), F.lit(method).alias("method"), F.lit(0).cast("long").alias("total_outliers"),
            F.lit(0.0).alias("outlier_percentage"), F.lit(None).cast("double").alias("lower"),
            F.lit(None).cast("double").alias("upper"))
    flag = outlier_expr(col, b)
    lo = b.get("lower", None)
    hi = b.get("upper", None)
    if method == "Z-score":
        lo = b["mean"] - b["threshold"] * b["std"]
        hi = b["mean"] + b["threshold"] * b["std"]
    return df.agg(F.count_if(flag).alias("k"), F.count(F.lit(1)).alias("n")).select(
        F.lit(col).alias("column"), F.lit(method).alias("method"), F.col("k").alias("total_outliers"),
        F.when(F.col("n") > 0, F.col("k") * 100.0 / F.col("n")).otherwise(0.0).alias("outlier_percentage"),
        F.lit(lo).cast("double").alias("lower"), F.lit(hi).cast("double").alias("upper"))


def flag_outliers(df: DataFrame, col: str, method: str = "IQR", flag_col: str = "is_outlier") -> DataFrame:
    """Add a boolean flag column (NULL values are not outliers)."""
    b = fit_outlier_bounds(df, col, method)
    if b is None:
        return df.withColumn(flag_col, F.lit(False))
    return df.withColumn(flag_col, F.coalesce(outlier_expr(col, b), F.lit(False)))


def split_outliers(df: DataFrame, col: str, method: str = "IQR") -> tuple[DataFrame, DataFrame]:
    """(outliers, normal) — the membership split of the chart code, via one flag."""
    f = flag_outliers(df, col, method, "_o")
    return f.filter("_o").drop("_o"), f.filter(~F.col("_o")).drop("_o")


def outlier_sample(df: DataFrame, col: str, order_by: list[str], method: str = "IQR", k: int = 10) -> DataFrame:
    """The first ``k`` outlier values in row order (TakeOrderedAndProject)."""
    b = fit_outlier_bounds(df, col, method)
    if b is None:
        return df.limit(0).select(*named([*order_by, col]))
    return df.filter(outlier_expr(col, b)).orderBy(*named(order_by)).limit(k).select(*named([*order_by, col]))


def outlier_overview(df: DataFrame, cols: list[str] | None = None, digits: int = 2) -> DataFrame:
    """IQR outlier count and % for every numeric column: two passes in total."""
    cols = [c for c in (cols or df.columns) if column_kind(df.schema[c].dataType) == "numeric"]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, total_outliers long, outlier_percentage double")
    qs = scan.quantile_values(df, cols, [0.25, 0.75])  # bounded: two numbers per column
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        q = qs[c]
        if q is None:
            aggs.append(F.lit(0).cast("long").alias(f"k{i}"))
            continue
        iqr = q[1] - q[0]
        x = quoted(c)
        aggs.append(F.count_if((x < F.lit(q[0] - 1.5 * iqr)) | (x > F.lit(q[1] + 1.5 * iqr))).alias(f"k{i}"))
    wide = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column"), quoted(f"k{i}").alias("total_outliers"),
                        F.when(F.col("_n") > 0, rnd(quoted(f"k{i}") * 100.0 / F.col("_n"), digits))
                        .otherwise(0.0).alias("outlier_percentage")) for i, c in enumerate(cols)]
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def histogram(df: DataFrame, col: str, bins: int = 30, digits: int = 4) -> DataFrame:
    """Equal-width bins over [min, max] (last bin closed): bin, lo, hi, count, density."""
    c = quoted(col).cast("double")
    r = df.agg(F.min(quoted(c)).alias("mn"), F.max(quoted(c)).alias("mx"), F.count(quoted(c)).alias("n")).first()
    if r["n"] == 0:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, count long, density double")
    mn, mx, n = r["mn"], r["mx"], r["n"]
    if mx == mn:
        mn, mx = mn - 0.5, mx + 0.5
    width = (mx - mn) / bins
    b = F.least(F.floor((c - F.lit(mn)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    h = df.filter(c.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return h.select(
        "bin", rnd(F.lit(mn) + F.col("bin") * F.lit(width), digits).alias("lo"),
        rnd(F.lit(mn) + (F.col("bin") + 1) * F.lit(width), digits).alias("hi"), "count",
        rnd(F.col("count") / F.lit(n * width), 8).alias("density"))


def box_stats(df: DataFrame, col: str, digits: int = 4) -> DataFrame:
    """Box-plot numbers: quartiles, whiskers (extreme values within 1.5 IQR), outlier count."""
    c = quoted(col).cast("double")
    q = scan.quantile_values(df, [col], [0.25, 0.5, 0.75])[col]
    if q is None:
        return df.sparkSession.createDataFrame([], "column string")
    iqr = q[2] - q[0]
    lo, hi = q[0] - 1.5 * iqr, q[2] + 1.5 * iqr
    inside = (c >= F.lit(lo)) & (c <= F.lit(hi))
    return df.agg(
        F.min(F.when(inside, c)).alias("wl"), F.max(F.when(inside, c)).alias("wh"),
        F.count_if(~inside).alias("n_out")).select(
        F.lit(col).alias("column"), F.lit(round(q[0], digits)).alias("q1"), F.lit(round(q[1], digits)).alias("median"),
        F.lit(round(q[2], digits)).alias("q3"), F.lit(round(iqr, digits)).alias("iqr"),
        rnd("wl", digits).alias("whisker_low"), rnd("wh", digits).alias("whisker_high"),
        F.col("n_out").alias("outliers"))


def index_scatter(df: DataFrame, col: str, order_by: list[str], method: str = "IQR") -> DataFrame:
    """(position, value, is_outlier) in row order — the scatter panel's data.

    Position is a global running count from the two-level scan, not a
    single-partition window.
    """
    from .scan import prefix_sums
    f = flag_outliers(df.select(*named([*order_by, col])), col, method, "is_outlier").withColumn("_one", F.lit(1))
    p = prefix_sums(f, order_by, ["_one"])
    return p.select((F.col("_one_cum") - 1).alias("position"), quoted(col), "is_outlier")


