"""Feature preparation for models: impute, scale, split, folds.

* Imputation and scaling are fit with one aggregate pass and applied as
  literal expressions (row-local; also valid on a stream).
* Scaling uses the POPULATION standard deviation (zero std -> 1), fit on the
  training rows only.
* Splits are exact per class and deterministic: rows are ordered inside their
  class by ``md5(salt || key)``. Instead of sorting a whole class (a hot class
  could hold a third of all rows), rows are counted per class and hash bucket
  of three hex digits, and those of the bucket that holds the cutoff per bucket of
  three more; running counts over at most 4096 buckets a class find the cutoff
  bucket of six digits, and only the rows of that one bucket are ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import named, quoted
from ..sources.ingest import is_numeric
from . import scan
from .profile import top_values, value_counts_long

MISSING_TEXT = "missing"
HASH_DIGITS = 3  # of each of two levels of hash buckets


# ---------------------------------------------------------------- impute
def fit_impute(df: DataFrame, cols: list[str]) -> dict:
    """Numeric -> mean; text -> most frequent value (smallest on ties) or 'missing'."""
    num = [c for c in cols if is_numeric(df, c)]
    txt = [c for c in cols if c not in num]
    fill = {}
    if num:
        row = df.agg(*[F.avg(quoted(c)).alias(c) for c in num]).first().asDict()
        fill.update({c: v for c, v in row.items() if v is not None})
    if txt:
        modes = {r["name"]: r["value"] for r in top_values(value_counts_long(df, txt), 1).collect()}  # one per column
        fill.update({c: modes.get(c, MISSING_TEXT) for c in txt})
    return fill


def apply_impute(df: DataFrame, fill: dict) -> DataFrame:
    return df.select(*[F.coalesce(quoted(c), F.lit(fill[c])).alias(c) if c in fill else quoted(c) for c in df.columns])


def impute(df: DataFrame, cols: list[str]) -> DataFrame:
    return apply_impute(df, fit_impute(df, cols))


# ---------------------------------------------------------------- scale
def fit_scaler(df: DataFrame, cols: list[str]) -> dict:
    """{col: (mean, population std or 1 when zero)} from one aggregate."""
    aggs = []
    for c in cols:
        aggs += [F.avg(quoted(c)).alias(f"m_{c}"), F.stddev_pop(quoted(c)).alias(f"s_{c}")]
    r = df.agg(*aggs).first().asDict()
    out = {}
    for c in cols:
        s = r[f"s_{c}"]
        out[c] = (r[f"m_{c}"] or 0.0, s if s not in (None, 0.0) else 1.0)
    return out


def apply_scaler(df: DataFrame, scaler: dict, suffix: str = "") -> DataFrame:
    """(x - mean) / std as literal expressions; replaces the columns unless ``suffix``."""
    scaled = {c: (quoted(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scaler.items()}
    if suffix:
        return df.select("*", *[e.alias(c + suffix) for c, e in scaled.items()])
    return df.select(*[scaled[c].alias(c) if c in scaled else quoted(c) for c in df.columns])


def standard_scale(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None) -> DataFrame:
    return apply_scaler(df, fit_scaler(fit_on if fit_on is not None else df, cols))


# ---------------------------------------------------------------- splits
def _hash(key: str, salt: str) -> Column:
    return F.md5(F.concat(F.lit(str(salt)), quoted(key).cast("string")))


def _cutoff(counts: DataFrame, bucket: str, *more: str) -> DataFrame:
    """(_cls, _cut, _before, _want, more...): per class, the first bucket whose running count
    reaches ``_want``, and the rows before it."""
    w = Window.partitionBy("_cls").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.withColumn("_cum", F.sum("_n").over(w)).filter((F.col("_cum") >= F.col("_want")) & (F.col("_want") > 0))
    first = F.min_by(F.struct(F.col(bucket).alias("_cut"), (F.col("_cum") - F.col("_n")).alias("_before"), "_want", *more), F.col(bucket))
    return reached.groupBy("_cls").agg(first.alias("c")).select("_cls", "c.*")


def stratified_split(df: DataFrame, key: str, label: str | None, test_size: float = 0.2,
                     salt: str = "42", out_col: str = "split") -> DataFrame:
    """Add ``split`` = test/train; per class, test gets round(test_size * n_class)
    rows: those with the smallest (md5(salt || key), key)."""
    strat = label if label else None
    cls = quoted(strat) if strat else F.lit(0)
    at = lambda level: F.conv(F.substring("_h", 1 + level * HASH_DIGITS, HASH_DIGITS), 16, 10).cast("int")
    d = df.withColumn("_cls", cls).withColumn("_h", _hash(key, salt)).withColumn("_b0", at(0)).withColumn("_b1", at(1))
    total = d.groupBy("_cls", "_b0").agg(F.count(F.lit(1)).alias("_n"))
    total = total.withColumn("_want", F.floor(F.sum("_n").over(Window.partitionBy("_cls")) * F.lit(test_size) + 0.5))
    # the cutoff bucket of every class: first bucket whose running count reaches the test size
    top = _cutoff(total, "_b0")
    low = d.join(F.broadcast(top), "_cls").filter(F.col("_b0") == F.col("_cut"))  # one row per class
    low = low.groupBy("_cls", "_b1").agg(F.count(F.lit(1)).alias("_n"), F.first("_cut").alias("_c0"), F.first("_before").alias("_past"),
                                         (F.first("_want") - F.first("_before")).alias("_want"))
    cut = _cutoff(low, "_b1", "_c0", "_past").select("_cls", (F.col("_c0") * 16 ** HASH_DIGITS + F.col("_cut")).alias("_cb"),
                                                     F.col("_before").alias("_before"), F.col("_want").alias("_w"))
    j = d.withColumn("_b", F.col("_b0") * 16 ** HASH_DIGITS + F.col("_b1")).join(F.broadcast(cut), "_cls", "left")
    inside = j.filter(F.col("_b") == F.col("_cb"))
    rest = j.filter(F.col("_cb").isNull() | (F.col("_b") != F.col("_cb")))
    wr = Window.partitionBy("_cls").orderBy("_h", quoted(key))
    inside = inside.withColumn(out_col, F.when(F.row_number().over(wr) <= F.col("_w") - F.col("_before"), "test")
                               .otherwise("train"))
    rest = rest.withColumn(out_col, F.when(F.col("_cb").isNotNull() & (F.col("_b") < F.col("_cb")), "test")
                           .otherwise("train"))
    return inside.unionByName(rest).select(*named(df.columns), out_col)


def assign_folds(df: DataFrame, key: str, label: str | None, k: int = 5, salt: str = "42",
                 out_col: str = "fold") -> DataFrame:
    """Stratified k-fold: fold = (position of the row inside its class, in
    md5 order) mod k. Positions come from the two-level running count."""
    d = df.withColumn("_cls", quoted(label) if label else F.lit(0)).withColumn("_h", _hash(key, salt)) \
        .withColumn("_one", F.lit(1))
    p = scan.prefix_sums(d, ["_h", key], ["_one"], partition_cols=["_cls"])
    return p.withColumn(out_col, ((F.col("_one_cum") - 1) % k).cast("int")).select(*named(df.columns), out_col)


def shuffle_split(df: DataFrame, key: str, label: str | None, n_splits: int = 5, test_size: float = 0.2,
                  salt: str = "42") -> DataFrame:
    """Repeated stratified splits with salts ``salt-0..n``: (split_id, key, split)."""
    parts = [stratified_split(df.select(quoted(key), *([label] if label else [])), key, label, test_size, f"{salt}-{i}")
             .select(F.lit(i).alias("split_id"), key, "split") for i in range(n_splits)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def legacy_prepare(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows with NULLs, keep numeric columns, scale (population std)."""
    num = [c for c in cols if is_numeric(df, c)]
    d = df.select(*named(num)).na.drop()
    return standard_scale(d, num)
