"""Cleaning operators: duplicates, missing values, type fixes, encodings.

Design rules
* Every order-sensitive operator takes an explicit ``order_by`` (unique
  within the group) instead of an implicit row position.
* Fitted statistics (means, medians, modes, domains, bounds) are computed by a
  small aggregate action and applied as literals, so the fitted transform is
  row-local and also runs on a streaming DataFrame.
* Duplicate removal is an aggregation (``min_by``/``max_by`` of the row), so a
  duplicate group holding a third of all rows is combined map-side instead of
  being sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.ingest import is_numeric
from ..functions.scalar import named, quoted
from . import scan, sparse

KEEP_CHOICES = ("first", "last", "none")
FILL_METHODS = ("drop", "mean", "median", "mode", "forward_fill", "backward_fill")
TYPE_CHOICES = ("int", "float", "str", "category", "bool")
ENCODINGS = ("onehot", "onehot_vector", "label", "ordinal")
OUTLIER_METHODS = ("IQR", "Z-score", "percentile")

# The only text forms mapped by the bool conversion.
BOOL_TRUE_TEXT = ["True", "true", "1"]
BOOL_FALSE_TEXT = ["False", "false", "0"]


def _ord(order_by: list[str] | str) -> Column:
    if isinstance(order_by, str):
        order_by = [order_by]
    return F.struct(*[quoted(c) for c in order_by])


# ---------------------------------------------------------------- duplicates
def drop_duplicates(df: DataFrame, subset: list[str] | None = None, keep: str = "first",
                    order_by: list[str] | str | None = None) -> DataFrame:
    """Remove duplicate rows on ``subset`` (all columns when None); nulls equal nulls.

    keep='first'/'last' keeps the row with the smallest/largest ``order_by``;
    keep='none' drops every member of a duplicated group.
    """
    if keep not in KEEP_CHOICES:
        raise ValueError(f"keep must be one of {KEEP_CHOICES}")
    cols = df.columns
    subset = list(subset) if subset else list(cols)
    missing = [c for c in subset if c not in cols]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    others = [c for c in cols if c not in subset]
    if keep == "none":
        aggs = [F.count(F.lit(1)).alias("_n")]
        if others:
            aggs.append(F.first(F.struct(*named(others))).alias("_r"))
        g = df.groupBy(*named(subset)).agg(*aggs).filter(F.col("_n") == 1)
        return g.select(*[quoted(c) if c in subset else F.col("_r").getField(c).alias(c) for c in cols])
    if not others:
        return df.dropDuplicates(subset)
    if order_by is None:
        raise ValueError("order_by is required to choose the first/last row of a duplicate group")
    pick = F.min_by if keep == "first" else F.max_by
    g = df.groupBy(*named(subset)).agg(pick(F.struct(*named(others)), _ord(order_by)).alias("_r"))
    return g.select(*[quoted(c) if c in subset else F.col("_r").getField(c).alias(c) for c in cols])


# ---------------------------------------------------------------- missing
def fit_fill_value(df: DataFrame, col: str, method: str, approx: bool = False):
    """The scalar a mean / median / mode fill uses (None when not applicable)."""
    c = quoted(col)
    if method in ("mean", "median"):
        if not is_numeric(df, col):
            return None  # reference behaviour: silent no-op on text
        if method == "mean":
            return df.agg(F.avg(quoted(c))).first()[0]
        if approx:
            return df.agg(F.percentile_approx(c, 0.5, 100_000)).first()[0]
        q = scan.quantile_values(df, [col], [0.5])[col]
        return None if q is None else q[0]
    if method == "mode":
        return mode_value(df, col)
    raise ValueError(method)


def mode_value(df: DataFrame, col: str):
    """Most frequent non-null value, smallest on ties (distributed value histogram)."""
    h = scan.value_histogram(df, col, count_col="_n")
    r = h.orderBy(F.col("_n").desc(), quoted(col).asc()).first()
    return None if r is None else r[col]


def fill_missing(df: DataFrame, col: str, method: str, order_by: list[str] | str | None = None,
                 by: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Handle NULLs of one column: drop / mean / median / mode / forward_fill / backward_fill."""
    if col not in df.columns:
        raise ValueError(f"Column '{col}' not found")
    if method not in FILL_METHODS:
        raise ValueError(f"method must be one of {FILL_METHODS}")
    if method == "drop":
        return df.filter(quoted(col).isNotNull())
    if method in ("forward_fill", "backward_fill"):
        if order_by is None:
            raise ValueError("order_by is required for forward/backward fill")
        order = [order_by] if isinstance(order_by, str) else list(order_by)
        direction = "forward" if method == "forward_fill" else "backward"
        out = scan.carry_fill(df, col, order, by, direction)
        return out.select(*named(df.columns))
    value = fit_fill_value(df, col, method, approx)
    return apply_fill(df, col, value)


def apply_fill(df: DataFrame, col: str, value) -> DataFrame:
    """Row-local half of a fitted fill (works on streams)."""
    if value is None:
        return df
    return df.withColumn(col, F.coalesce(quoted(col), F.lit(value)))


# ---------------------------------------------------------------- types
def convert_type(df: DataFrame, col: str, dtype: str) -> DataFrame:
    """int (round half to even, unparsable -> NULL) / float / str / category / bool."""
    if dtype not in TYPE_CHOICES:
        raise ValueError(f"dtype must be one of {TYPE_CHOICES}")
    return df.withColumn(col, type_expr(df, col, dtype))


def type_expr(df: DataFrame, col: str, dtype: str) -> Column:
    c = quoted(col)
    src = df.schema[col].dataType
    if dtype == "int":
        d = c.cast("double") if isinstance(src, (T.NumericType, T.BooleanType)) else c.try_cast("double")
        return F.bround(d, 0).try_cast("long")
    if dtype == "float":
        d = c.cast("double") if isinstance(src, (T.NumericType, T.BooleanType)) else c.try_cast("double")
        return F.nanvl(d, F.lit(None).cast("double"))  # the texts of NaN are missing values, as at ingest
    if dtype in ("str", "category"):
        return c.cast("string")
    # bool
    if isinstance(src, T.StringType):
        return (F.when(c.isin(*BOOL_TRUE_TEXT), F.lit(True))
                .when(c.isin(*BOOL_FALSE_TEXT), F.lit(False))
                .otherwise(F.lit(None).cast("boolean")))
    if isinstance(src, T.BooleanType):
        return c
    return F.when(c.isNull(), F.lit(None).cast("boolean")).otherwise(c != 0)


# ---------------------------------------------------------------- encodings
def fit_domain(df: DataFrame, col: str, max_domain: int = 1000) -> list:
    """Sorted distinct non-null values, refused above ``max_domain`` values."""
    d = df.select(quoted(col)).filter(quoted(col).isNotNull()).distinct().limit(max_domain + 1).collect()
    if len(d) > max_domain:
        raise ValueError(f"column '{col}' has more than {max_domain} distinct values; "
                         f"use encode(..., 'onehot_vector') or encode(..., 'label')")
    return sorted(r[0] for r in d)


def onehot(df: DataFrame, col: str, domain: list, prefix: str | None = None) -> DataFrame:
    """Row-local one-hot for a fitted domain: 0/1 ints, NULL -> all 0, source dropped."""
    prefix = prefix or col
    c = quoted(col)
    new = [F.coalesce((c == F.lit(v)).cast("int"), F.lit(0)).alias(f"{prefix}_{v}") for v in domain]
    return df.select(*[quoted(x) for x in df.columns if x != col], *new)


def encode(df: DataFrame, col: str, method: str = "onehot", max_domain: int = 1000) -> DataFrame:
    """onehot (a column per value, as many as a table may have) / onehot_vector (one sparse
    vector column, for any number of values) / label (0-based code of the sorted text) /
    ordinal (same, as double)."""
    if method not in ENCODINGS:
        raise ValueError(f"method must be one of {ENCODINGS}")
    if is_numeric(df, col) or isinstance(df.schema[col].dataType, T.BooleanType):
        raise ValueError(f"Column '{col}' is numeric and cannot be encoded as categorical.")
    if method == "onehot":
        return onehot(df, col, fit_domain(df, col, max_domain))
    if method == "onehot_vector":
        return sparse.onehot_vector(df, col).drop(quoted(col))
    codes = label_codes(df, col)
    out_t = "long" if method == "label" else "double"
    j = df.join(codes, on=col, how="left")
    return j.select(*[F.col("_code").cast(out_t).alias(col) if x == col else quoted(x) for x in df.columns])


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """(value, _code) for every distinct value, computed without a single-task sort."""
    txt = df.select(quoted(col).cast("string").alias(col))
    return scan.dense_codes(txt, col, "_code")


# ---------------------------------------------------------------- outliers
def fit_outlier_bounds(df: DataFrame, col: str, method: str = "IQR", approx: bool = False) -> dict | None:
    """Bounds dict for IQR / Z-score / percentile, or None (not numeric / zero std)."""
    if method not in OUTLIER_METHODS:
        raise ValueError(f"method must be one of {OUTLIER_METHODS}")
    if not is_numeric(df, col):
        return None
    c = quoted(col).cast("double")
    if method == "Z-score":
        r = df.agg(F.avg(quoted(c)).alias("m"), F.stddev_samp(quoted(c)).alias("s"), F.count(quoted(c)).alias("n")).first()
        if r["s"] is None or r["s"] == 0:
            return None
        return {"method": method, "mean": r["m"], "std": r["s"], "threshold": 3.0}
    probs = [0.25, 0.75] if method == "IQR" else [0.05, 0.95]
    if approx:
        q = df.agg(F.percentile_approx(c, probs, 100_000)).first()[0]
    else:
        q = scan.quantile_values(df, [col], probs)[col]
    if q is None:
        return None
    if method == "IQR":
        iqr = q[1] - q[0]
        return {"method": method, "Q1": q[0], "Q3": q[1], "IQR": iqr,
                "lower": q[0] - 1.5 * iqr, "upper": q[1] + 1.5 * iqr}
    return {"method": method, "lower": q[0], "upper": q[1]}


def inlier_expr(col: str, b: dict) -> Column:
    c = quoted(col)
    if b["method"] == "Z-score":
        return F.abs((c - F.lit(b["mean"])) / F.lit(b["std"])) <= F.lit(b["threshold"])
    return (c >= F.lit(b["lower"])) & (c <= F.lit(b["upper"]))


def outlier_expr(col: str, b: dict) -> Column:
    c = quoted(col)
    if b["method"] == "Z-score":
        return F.abs((c - F.lit(b["mean"])) / F.lit(b["std"])) > F.lit(b["threshold"])
    return (c < F.lit(b["lower"])) | (c > F.lit(b["upper"]))


def remove_outliers(df: DataFrame, col: str, method: str = "IQR", keep_nulls: bool = False,
                    approx: bool = False) -> DataFrame:
    """Keep rows inside the bounds (inclusive). Non-numeric column / zero std: unchanged.

    As in the reference, NULL rows fail the bound test and are dropped unless
    ``keep_nulls``.
    """
    b = fit_outlier_bounds(df, col, method, approx)
    if b is None:
        return df
    keep = inlier_expr(col, b)
    if keep_nulls:
        keep = keep | quoted(col).isNull()
    return df.filter(keep)
