"""Column profiling: describe, dataset info, feature type / quality / profile.

Plan shape (never one job per column):

* one wide aggregate over every column (counts, moments, exact quartiles,
  first non-null text, date range) -> one row, exploded to one row per column;
* one long value histogram ``(name, value) -> n`` built from a single
  ``explode`` + ``groupBy`` with map-side partial aggregation; it serves
  distinct counts, mode / top-k (``row_number <= k`` becomes a per-partition
  group limit before the shuffle) and IQR outlier counts (joined with the
  per-column bounds, one row per column).

Exact quartiles come from ``scan.quantile_values`` (selection by brackets: a few
aggregates of all columns, hardly any shuffle); ``approx=True`` takes the sketch's
values as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import named, quoted, rnd
from ..sources.ingest import column_kind
from . import scan

QUARTILES = [0.25, 0.5, 0.75]

# Labels and thresholds of the feature profiler.
TYPE_NUMERIC = "Numeric"
TYPE_CATEGORICAL = "Categorical"
TYPE_DATETIME = "Date/Time"
MISSING_RULES = [  # (null % strictly above, penalty, issue)
    (80, 50, "Very high missing data"),
    (50, 30, "High missing data"),
    (20, 15, "Moderate missing data"),
    (5, 5, "Some missing data"),
]
LEVEL_RULES = [(85, "High quality"), (70, "Good quality"), (50, "Fair quality")]
LEVEL_FALLBACK = "Poor quality"
NO_ISSUE = "Good quality"


def _pct(q: Column, probs: list[float], approx: bool) -> Column:
    if approx:
        return F.percentile_approx(q, probs, 10_000).cast("array<double>")
    return F.percentile(q, F.array(*[F.lit(p) for p in probs]))


def _first_value(c: Column, order_by: list[str] | None) -> Column:
    """First non-null value in row order (min value when no order is given)."""
    if order_by:
        return F.min_by(c, F.when(c.isNotNull(), F.struct(*[quoted(o) for o in order_by])))
    return F.min(quoted(c))


def column_stats(df: DataFrame, cols: list[str] | None = None, order_by: list[str] | None = None,
                 approx: bool = False) -> DataFrame:
    """One row per column from one wide aggregate; exact quartiles from ``scan.quantile_values``.

    Columns: pos, name, kind, integral, total, non_null, min, max, mean, std,
    q25, median, q75, first_text, dmin, dmax.
    """
    cols = cols or df.columns
    inline_q = approx  # approximate quartiles have bounded sketches; exact ones come from the value histogram
    aggs = [F.count(F.lit(1)).alias("_total")]
    for i, c in enumerate(cols):
        dt = df.schema[c].dataType
        kind = column_kind(dt)
        col = quoted(c)
        aggs.append(F.count(quoted(col)).alias(f"nn{i}"))
        if kind == "numeric":
            d = col.cast("double")
            aggs += [F.min(d).alias(f"mn{i}"), F.max(d).alias(f"mx{i}"), F.avg(d).alias(f"av{i}"),
                     F.stddev_samp(d).alias(f"sd{i}")]
            if inline_q:
                aggs.append(_pct(d, QUARTILES, approx).alias(f"q{i}"))
        elif kind == "datetime":
            aggs += [F.min(quoted(col)).cast("string").alias(f"dmn{i}"), F.max(quoted(col)).cast("string").alias(f"dmx{i}"),
                     F.min(quoted(col)).cast("timestamp").alias(f"tmn{i}"), F.max(quoted(col)).cast("timestamp").alias(f"tmx{i}")]
        elif kind == "categorical":
            aggs.append(_first_value(col, order_by).alias(f"ft{i}"))
    wide = df.agg(*aggs)

    null_d = F.lit(None).cast("double")
    null_s = F.lit(None).cast("string")
    null_t = F.lit(None).cast("timestamp")
    structs = []
    for i, c in enumerate(cols):
        dt = df.schema[c].dataType
        kind = column_kind(dt)
        num = kind == "numeric"
        dtm = kind == "datetime"
        structs.append(F.struct(
            F.lit(i).alias("pos"), F.lit(c).alias("name"), F.lit(kind).alias("kind"),
            F.lit(isinstance(dt, T.IntegralType)).alias("integral"),
            F.col("_total").alias("total"), quoted(f"nn{i}").alias("non_null"),
            (quoted(f"mn{i}") if num else null_d).alias("min"),
            (quoted(f"mx{i}") if num else null_d).alias("max"),
            (quoted(f"av{i}") if num else null_d).alias("mean"),
            (quoted(f"sd{i}") if num else null_d).alias("std"),
            (quoted(f"q{i}")[0] if num and inline_q else null_d).alias("q25"),
            (quoted(f"q{i}")[1] if num and inline_q else null_d).alias("median"),
            (quoted(f"q{i}")[2] if num and inline_q else null_d).alias("q75"),
            (quoted(f"ft{i}").cast("string") if kind == "categorical" else null_s).alias("first_text"),
            (quoted(f"dmn{i}") if dtm else null_s).alias("dmin"),
            (quoted(f"dmx{i}") if dtm else null_s).alias("dmax"),
            (quoted(f"tmn{i}") if dtm else null_t).alias("tmin"),
            (quoted(f"tmx{i}") if dtm else null_t).alias("tmax"),
        ))
    stats = wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    num_cols = [c for c in cols if column_kind(df.schema[c].dataType) == "numeric"]
    if inline_q or not num_cols:
        return stats
    # exact quartiles: three numbers per column
    found = scan.quantile_values(df, num_cols, QUARTILES)
    quartiles = {a: F.coalesce(*[F.when(F.col("name") == c, F.lit(q[i])) for c, q in found.items() if q], null_d)
                 for i, a in enumerate(("q25", "median", "q75"))}
    return stats.withColumns(quartiles).select(*stats.columns)


def value_counts_long(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(name, value, num, n): per-column value histogram from one shuffle.

    ``value`` is the text form (exact distinctness), ``num`` the double form of
    numeric columns (for range tests). Nulls are excluded.
    """
    cols = cols or df.columns
    structs = []
    for c in cols:
        dt = df.schema[c].dataType
        num = quoted(c).cast("double") if isinstance(dt, T.NumericType) else F.lit(None).cast("double")
        structs.append(F.struct(F.lit(c).alias("name"), quoted(c).cast("string").alias("value"),
                                num.alias("num")))
    long = df.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    return (long.filter(F.col("value").isNotNull())
            .groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"), F.first("num").alias("num")))


def top_values(hist: DataFrame, k: int = 5) -> DataFrame:
    """Top-k values per column by count (ties: smaller number, then text)."""
    w = Window.partitionBy("name").orderBy(F.col("n").desc(), F.col("num").asc_nulls_last(),
                                           F.col("value").asc())
    return hist.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= k)


def _feature_type_expr(nunique: Column) -> Column:
    ratio = F.try_divide(nunique, F.col("total"))
    numeric_type = (F.when((ratio > 0.95) & (nunique > 50), F.lit(TYPE_CATEGORICAL))
                    .when(F.col("integral") & (nunique < 20), F.lit(TYPE_CATEGORICAL))
                    .otherwise(F.lit(TYPE_NUMERIC)))
    text_date = F.try_to_timestamp(F.col("first_text")).isNotNull()
    return (F.when(F.col("kind") == "numeric", numeric_type)
            .when(F.col("kind") == "datetime", F.lit(TYPE_DATETIME))
            .when((F.col("kind") == "categorical") & text_date, F.lit(TYPE_DATETIME))
            .otherwise(F.lit(TYPE_CATEGORICAL)))


def _quality_exprs(ftype: Column, nunique: Column, outliers: Column) -> tuple[Column, Column]:
    total = F.col("total")
    null_pct = F.when(total > 0, (total - F.col("non_null")) * 100.0 / total).otherwise(F.lit(0.0))
    miss_pen = F.lit(0)
    miss_issue = F.lit(None).cast("string")
    for thr, pen, text in reversed(MISSING_RULES):
        miss_pen = F.when(null_pct > thr, F.lit(pen)).otherwise(miss_pen)
        miss_issue = F.when(null_pct > thr, F.lit(text)).otherwise(miss_issue)
    is_cat = ftype == TYPE_CATEGORICAL
    is_num = ftype == TYPE_NUMERIC
    cat_pen = (F.when(nunique == 1, 40).when(nunique == total, 35)
               .when(nunique > total * 0.95, 20).otherwise(0))
    cat_issue = (F.when(nunique == 1, "Single value only").when(nunique == total, "All values unique")
                 .when(nunique > total * 0.95, "Very high cardinality"))
    iqr = F.col("q75") - F.col("q25")
    out_pct = F.try_divide(outliers * 100.0, total)
    const_pen = F.when(nunique == 1, 45).otherwise(0)
    const_issue = F.when(nunique == 1, F.lit("Constant value"))
    out_pen = F.when(iqr > 0, F.when(out_pct > 10, 15).when(out_pct > 5, 8).otherwise(0)).otherwise(0)
    out_issue = F.when(iqr > 0, F.when(out_pct > 10, "Many outliers detected")
                       .when(out_pct > 5, "Some outliers detected"))
    raw = (F.lit(100) - miss_pen
           - F.when(is_cat, cat_pen).otherwise(0)
           - F.when(is_num, const_pen + out_pen).otherwise(0))
    issues = F.filter(F.array(miss_issue,
                              F.when(is_cat, cat_issue),
                              F.when(is_num, const_issue),
                              F.when(is_num, out_issue)), lambda x: x.isNotNull())
    level = F.lit(LEVEL_FALLBACK)
    for thr, text in reversed(LEVEL_RULES):
        level = F.when(raw > thr, F.lit(text)).otherwise(level)
    issues = F.when(F.size(issues) == 0, F.array(F.lit(NO_ISSUE))) \
        .otherwise(F.concat(F.array(level), issues))
    score = F.greatest(F.lit(0), F.least(F.lit(100), raw))
    return score, issues


def _value_tallies(hist: DataFrame, stats: DataFrame) -> DataFrame:
    """Distinct values and IQR outliers per column, from one pass over the histogram (bounds: 1 row per column)."""
    b = stats.filter(F.col("kind") == "numeric").select(
        "name", (F.col("q25") - 1.5 * (F.col("q75") - F.col("q25"))).alias("lo"),
        (F.col("q75") + 1.5 * (F.col("q75") - F.col("q25"))).alias("hi"))
    j = hist.join(F.broadcast(b), "name", "left")  # b has one row per column of the schema
    return j.groupBy("name").agg(
        F.count(F.lit(1)).alias("nunique"),
        F.sum(F.when((F.col("num") < F.col("lo")) | (F.col("num") > F.col("hi")), F.col("n"))
              .otherwise(0)).alias("outliers"))


def profile_frame(df: DataFrame, cols: list[str] | None = None, order_by: list[str] | None = None,
                  approx: bool = False, top: int = 5) -> DataFrame:
    """Per-column profile with every intermediate field (used by the views below); with
    ``top`` also the most frequent values, from a second histogram."""
    cols = cols or [c for c in df.columns if c not in (order_by or [])] or df.columns
    hist = value_counts_long(df, cols)
    stats = column_stats(df, cols, order_by, approx)
    p = stats.join(_value_tallies(hist, stats), "name", "left")
    if top:
        top_agg = top_values(hist, top).groupBy("name").agg(
            F.array_sort(F.collect_list(F.struct("rk", "value", "n"))).alias("top"))
        p = p.join(top_agg, "name", "left")
    p = (p.withColumn("nunique", F.coalesce("nunique", F.lit(0)))
         .withColumn("outliers", F.coalesce("outliers", F.lit(0))))
    ftype = _feature_type_expr(F.col("nunique"))
    p = p.withColumn("type", ftype)
    score, issues = _quality_exprs(F.col("type"), F.col("nunique"), F.col("outliers"))
    total = F.col("total")
    null_pct = F.when(total > 0, (total - F.col("non_null")) * 100.0 / total).otherwise(F.lit(0.0))
    p = p.withColumn("quality_score", score.cast("int")).withColumn("issues", issues) \
        .withColumn("null_pct", null_pct)
    base = F.least(F.lit(100.0), F.col("quality_score") * (1 - F.col("null_pct") / 100.0))
    bonus = (F.when((F.col("type") == TYPE_CATEGORICAL) & (F.col("nunique") > 1)
                    & (F.col("nunique") < total * 0.8), 10)
             .when((F.col("type") == TYPE_NUMERIC) & (F.col("nunique") > 10), 15).otherwise(0))
    return p.withColumn("importance", rnd(F.least(F.lit(100.0), base + bonus), 1))


def feature_profile(df: DataFrame, cols: list[str] | None = None, order_by: list[str] | None = None,
                    approx: bool = False) -> DataFrame:
    """Feature table sorted by importance (desc), then column position."""
    p = profile_frame(df, cols, order_by, approx, top=0)
    return p.select(
        F.col("name"), F.col("type"), F.col("total").alias("total_count"),
        F.col("non_null").alias("non_null_count"),
        (F.col("total") - F.col("non_null")).alias("null_count"),
        rnd("null_pct", 2).alias("null_percentage"),
        F.col("nunique").alias("unique_count"), F.col("quality_score"),
        F.array_join("issues", "; ").alias("quality_issues"), F.col("importance"),
        F.col("pos"),
    ).orderBy(F.col("importance").desc(), F.col("pos")).drop("pos")


def feature_types(df: DataFrame, cols=None, order_by=None) -> DataFrame:
    return profile_frame(df, cols, order_by, top=0).select("name", "type", F.col("nunique").alias("unique_count"))


def feature_quality(df: DataFrame, cols=None, order_by=None) -> DataFrame:
    p = profile_frame(df, cols, order_by, top=0)
    return p.select("name", "type", "quality_score", F.array_join("issues", "; ").alias("quality_issues"))


def stats_numeric(df: DataFrame, cols=None, digits: int = 4, approx: bool = False) -> DataFrame:
    """min, max, mean, median, std, q25, q75 of numeric columns (one pass)."""
    cols = [c for c in (cols or df.columns) if column_kind(df.schema[c].dataType) == "numeric"]
    s = column_stats(df, cols, None, approx)
    return s.select("name", *[rnd(c, digits).alias(c) for c in
                              ["min", "max", "mean", "median", "std", "q25", "q75"]])


def stats_categorical(df: DataFrame, cols=None, k: int = 5) -> DataFrame:
    """unique_values, most_frequent (+count), top-k 'value:count:pct' list (pct of all rows, 2 dp)."""
    cols = cols or df.columns
    n_rows = max(df.count(), 1)  # scalar action: denominator of the percentages
    hist = value_counts_long(df, cols)
    card = hist.groupBy("name").agg(F.count(F.lit(1)).alias("unique_values"))
    agg = top_values(hist, k).groupBy("name").agg(
        F.array_sort(F.collect_list(F.struct("rk", "value", "n"))).alias("top"))
    item = lambda x: F.concat_ws(":", x["value"], x["n"].cast("string"),
                                 rnd(x["n"] * 100.0 / F.lit(n_rows), 2).cast("string"))
    return card.join(agg, "name", "left").select(
        "name", "unique_values",
        F.col("top")[0]["value"].alias("most_frequent"),
        F.coalesce(F.col("top")[0]["n"], F.lit(0)).alias("most_frequent_count"),
        F.array_join(F.transform("top", item), "|").alias("top_values"))


def stats_date(df: DataFrame, cols=None) -> DataFrame:
    """earliest, latest, whole days between (text columns parsed leniently)."""
    cols = cols or df.columns
    out = []
    for c in cols:
        kind = column_kind(df.schema[c].dataType)
        if kind == "datetime":
            out.append((c, quoted(c).cast("timestamp")))
        elif kind == "categorical":
            out.append((c, F.try_to_timestamp(quoted(c))))
    aggs = []
    for i, (c, e) in enumerate(out):
        aggs += [F.min(e).alias(f"a{i}"), F.max(e).alias(f"b{i}"), F.count(e).alias(f"n{i}")]
    wide = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("name"), quoted(f"a{i}").alias("t0"), quoted(f"b{i}").alias("t1"),
                        quoted(f"n{i}").alias("n")) for i, (c, _) in enumerate(out)]
    long = wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*").filter(F.col("n") > 0)
    secs = F.unix_timestamp("t1") - F.unix_timestamp("t0")
    return long.select(
        "name",
        F.date_format("t0", "yyyy-MM-dd HH:mm:ss").alias("earliest"),
        F.date_format("t1", "yyyy-MM-dd HH:mm:ss").alias("latest"),
        F.when(F.col("n") > 1, F.floor(secs / 86400)).otherwise(F.lit(0)).cast("long").alias("range_days"))


def describe(df: DataFrame, cols: list[str] | None = None, digits: int = 4, approx: bool = False) -> DataFrame:
    """pandas ``describe()`` of numeric columns, one row per column."""
    cols = [c for c in (cols or df.columns) if column_kind(df.schema[c].dataType) == "numeric"]
    s = column_stats(df, cols, None, approx)
    return s.select(F.col("name").alias("column"), F.col("non_null").alias("count"),
                    *[rnd(c, digits).alias(a) for c, a in
                      [("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "p25"),
                       ("median", "p50"), ("q75", "p75"), ("max", "max")]])


def missing_by_column(df: DataFrame) -> DataFrame:
    """Columns with at least one missing value: count and % of rows (2 dp)."""
    aggs = [F.count(F.lit(1)).alias("_t")] + [F.count_if(quoted(c).isNull()).alias(f"m{i}")
                                               for i, c in enumerate(df.columns)]
    wide = df.agg(*aggs)
    structs = [F.struct(F.lit(c).alias("column"), quoted(f"m{i}").alias("missing_count"), F.col("_t").alias("t"))
               for i, c in enumerate(df.columns)]
    long = wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    return long.filter(F.col("missing_count") > 0).select(
        "column", "missing_count", rnd(F.col("missing_count") * 100.0 / F.col("t"), 2).alias("missing_percentage"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of identical rows (nulls equal)."""
    g = df.groupBy(*named(df.columns)).agg(F.count(F.lit(1)).alias("c"))
    return g.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def dataset_info(df: DataFrame) -> DataFrame:
    """rows, columns, type counts, total missing, missing % of cells, duplicates.

    One shuffle: rows are grouped by their full content (nulls equal), which
    gives the row count, the duplicate count and the missing cells together.
    """
    kinds = {c: column_kind(df.schema[c].dataType) for c in df.columns}
    n_cols = len(df.columns)
    row_missing = F.lit(0)
    for c in df.columns:
        row_missing = row_missing + quoted(c).isNull().cast("int")
    g = df.groupBy(*named(df.columns)).agg(F.count(F.lit(1)).alias("_c")).withColumn("_m", row_missing)
    out = g.agg(F.coalesce(F.sum("_c"), F.lit(0)).cast("long").alias("rows"),
                F.coalesce(F.sum(F.col("_c") * F.col("_m")), F.lit(0)).cast("long").alias("total_missing"),
                F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))
    cells = F.col("rows") * n_cols
    return out.select(
        "rows", F.lit(n_cols).alias("columns"),
        F.lit(sum(1 for k in kinds.values() if k == "numeric")).alias("numeric_columns"),
        F.lit(sum(1 for k in kinds.values() if k == "categorical")).alias("categorical_columns"),
        F.lit(sum(1 for k in kinds.values() if k == "datetime")).alias("datetime_columns"),
        "total_missing",
        F.when(cells > 0, rnd(F.col("total_missing") * 100.0 / cells, 2)).otherwise(F.lit(0.0))
        .alias("missing_percentage"),
        "duplicate_rows")


def nunique(df: DataFrame, cols: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct non-null values per column (one histogram shuffle, or HLL)."""
    cols = cols or df.columns
    if approx:
        wide = df.agg(*[F.approx_count_distinct(quoted(c)).alias(f"u{i}") for i, c in enumerate(cols)])
        structs = [F.struct(F.lit(c).alias("name"), quoted(f"u{i}").alias("nunique")) for i, c in enumerate(cols)]
        return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")
    hist = value_counts_long(df, cols)
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "name string")
    card = hist.groupBy("name").agg(F.count(F.lit(1)).alias("nunique"))
    return names.join(card, "name", "left").select("name", F.coalesce("nunique", F.lit(0)).alias("nunique"))


def problem_type(df: DataFrame, target: str) -> DataFrame:
    """classification / regression from the target's type and cardinality."""
    numeric = column_kind(df.schema[target].dataType) == "numeric"
    t = df.select(quoted(target)).filter(quoted(target).isNotNull())
    s = t.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(quoted(target)).alias("u"))
    if not numeric:
        kind = F.lit("classification")
    else:
        kind = (F.when(F.col("n") == 0, "classification")
                .when((F.col("u") <= 10) | (F.col("u") / F.col("n") < 0.05), "classification")
                .otherwise("regression"))
    return s.select(F.lit(target).alias("column"), kind.alias("problem_type"))


def column_info(df: DataFrame, order_by: list[str], cols: list[str] | None = None) -> DataFrame:
    """Training-page column table: dtype, missing, nunique, numeric flag,
    target-candidate flag, first three non-null samples in row order, task."""
    cols = cols or [c for c in df.columns if c not in order_by]
    ordv = F.struct(*[quoted(o) for o in order_by])
    hist = value_counts_long(df, cols)
    card = hist.groupBy("name").agg(F.count(F.lit(1)).alias("u"))
    # three first non-null values per column: partial top-k per group before the shuffle
    structs = [F.struct(F.lit(c).alias("name"), quoted(c).cast("string").alias("value")) for c in cols]
    long = df.select(ordv.alias("o"), F.explode(F.array(*structs)).alias("s")) \
        .select("o", "s.*").filter(F.col("value").isNotNull())
    w = Window.partitionBy("name").orderBy("o")
    samples = (long.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= 3)
               .groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "value"))),
                                                             lambda x: x["value"]), ", ").alias("sample_values")))
    nn = df.agg(F.count(F.lit(1)).alias("t"), *[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(cols)])
    nn_long = nn.select(F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("name"),
                                                      F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                                                      F.lit(column_kind(df.schema[c].dataType) == "numeric")
                                                      .alias("is_numeric"),
                                                      quoted(f"n{i}").alias("nn"), F.col("t").alias("t"))
                                            for i, c in enumerate(cols)])).alias("s")).select("s.*")
    j = nn_long.join(card, "name", "left").join(samples, "name", "left") \
        .withColumn("u", F.coalesce("u", F.lit(0)))
    task = (F.when(F.col("nn") == 0, "classification")
            .when(F.col("is_numeric") & ~((F.col("u") <= 10) | (F.col("u") / F.col("nn") < 0.05)), "regression")
            .otherwise("classification"))
    return j.select(
        "name", "dtype", (F.col("t") - F.col("nn")).alias("missing_count"),
        rnd((F.col("t") - F.col("nn")) * 100.0 / F.col("t"), 2).alias("missing_percentage"),
        F.col("u").alias("unique_values"), "is_numeric", (F.col("nn") > 0).alias("is_target_candidate"),
        F.coalesce("sample_values", F.lit("")).alias("sample_values"),
        F.when(F.col("nn") > 0, task).alias("recommended_task"))


# Name fragments of the name-based type guess, checked in this order.
NAME_NUMERIC = ["id", "count", "qty", "price", "amount", "freq", "avg", "sum", "total", "days", "hours",
                "minutes", "score", "rate", "percent"]
NAME_DATETIME = ["date", "time", "created", "updated", "modified", "timestamp"]
NAME_CATEGORICAL = ["name", "title", "description", "category", "type", "status"]


def infer_type_by_name(name: Column) -> Column:
    """numeric / datetime / categorical guessed from a column NAME (substring rules)."""
    low = F.lower(name)
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))
    return (F.when(has(NAME_NUMERIC), F.lit("numeric")).when(has(NAME_DATETIME), F.lit("datetime"))
            .otherwise(F.lit("categorical")))


# Colour bands of the quality score (at least).
QUALITY_BANDS = [(80, "good"), (60, "warning")]
QUALITY_BAND_FALLBACK = "poor"


def quality_band(score: Column) -> Column:
    out = F.lit(QUALITY_BAND_FALLBACK)
    for thr, name in reversed(QUALITY_BANDS):
        out = F.when(score >= thr, F.lit(name)).otherwise(out)
    return out
