"""Profiling queries (G9-G19, G24, P2, P5, P12, P17) with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from .registry import query
from .tables import DOC_LABELS_SQL, DOCLABEL_COLS, EVENTS_COLS, LINEITEM_COLS, doc_labels, t


def _col_sql(src: str, i: int, name: str, kind: str, integral: bool, first_sql: str | None) -> str:
    num = kind == "numeric"
    q = lambda p: f"quantile_cont({name}, {p})" if num else "NULL::DOUBLE"
    first = first_sql or (f"min({name})" if kind == "categorical" else "NULL")
    return f"""
  SELECT {i} AS pos, '{name}' AS name, '{kind}' AS kind, {str(integral).upper()} AS integral,
         (SELECT count(*) FROM {src}) AS total, count({name}) AS non_null,
         count(DISTINCT {name}) AS nunique, {q(0.25)} AS q25, {q(0.75)} AS q75,
         CAST({first} AS VARCHAR) AS first_text,
         {"(SELECT count(*) FROM " + src + " s2, (SELECT quantile_cont(" + name + ", 0.25) a, quantile_cont("
          + name + ", 0.75) b FROM " + src + ") qq WHERE s2." + name + " < qq.a - 1.5 * (qq.b - qq.a) OR s2."
          + name + " > qq.b + 1.5 * (qq.b - qq.a))" if num else "0"} AS outliers
  FROM {src}"""


def profile_sql(src: str, cols, order_col: str | None = None) -> str:
    """SQL of the per-column profile (type, quality, importance)."""
    parts = []
    for i, (c, kind, integral) in enumerate(cols):
        first = f"arg_min({c}, {order_col}) FILTER (WHERE {c} IS NOT NULL)" if (order_col and kind == "categorical") else None
        parts.append(_col_sql(src, i, c, kind, integral, first))
    union = " UNION ALL ".join(parts)
    return f"""
WITH s AS ({union}),
ty AS (
  SELECT *, CASE
     WHEN kind = 'numeric' THEN CASE
        WHEN nunique::DOUBLE / total > 0.95 AND nunique > 50 THEN 'Categorical'
        WHEN integral AND nunique < 20 THEN 'Categorical' ELSE 'Numeric' END
     WHEN kind = 'datetime' THEN 'Date/Time'
     WHEN kind = 'categorical' AND try_cast(first_text AS TIMESTAMP) IS NOT NULL THEN 'Date/Time'
     ELSE 'Categorical' END AS type,
   CASE WHEN total > 0 THEN (total - non_null) * 100.0 / total ELSE 0.0 END AS null_pct
  FROM s),
sc AS (
  SELECT *,
    CASE WHEN null_pct > 80 THEN 50 WHEN null_pct > 50 THEN 30 WHEN null_pct > 20 THEN 15
         WHEN null_pct > 5 THEN 5 ELSE 0 END AS miss_pen,
    CASE WHEN null_pct > 80 THEN 'Very high missing data' WHEN null_pct > 50 THEN 'High missing data'
         WHEN null_pct > 20 THEN 'Moderate missing data' WHEN null_pct > 5 THEN 'Some missing data' END AS miss_issue,
    CASE WHEN type = 'Categorical' THEN CASE WHEN nunique = 1 THEN 40 WHEN nunique = total THEN 35
         WHEN nunique > total * 0.95 THEN 20 ELSE 0 END ELSE 0 END AS cat_pen,
    CASE WHEN type = 'Categorical' THEN CASE WHEN nunique = 1 THEN 'Single value only'
         WHEN nunique = total THEN 'All values unique' WHEN nunique > total * 0.95 THEN 'Very high cardinality' END END AS cat_issue,
    CASE WHEN type = 'Numeric' AND nunique = 1 THEN 45 ELSE 0 END AS const_pen,
    CASE WHEN type = 'Numeric' AND nunique = 1 THEN 'Constant value' END AS const_issue,
    CASE WHEN type = 'Numeric' AND q75 - q25 > 0 THEN CASE WHEN outliers * 100.0 / total > 10 THEN 15
         WHEN outliers * 100.0 / total > 5 THEN 8 ELSE 0 END ELSE 0 END AS out_pen,
    CASE WHEN type = 'Numeric' AND q75 - q25 > 0 THEN CASE WHEN outliers * 100.0 / total > 10 THEN 'Many outliers detected'
         WHEN outliers * 100.0 / total > 5 THEN 'Some outliers detected' END END AS out_issue
  FROM ty),
fin AS (
  SELECT *, 100 - miss_pen - cat_pen - const_pen - out_pen AS raw,
    concat_ws('; ', miss_issue, cat_issue, const_issue, out_issue) AS issue_text
  FROM sc)
SELECT name, type, total AS total_count, non_null AS non_null_count, (total - non_null) AS null_count,
  round(null_pct, 2) AS null_percentage, nunique AS unique_count,
  CAST(greatest(0, least(100, raw)) AS INTEGER) AS quality_score,
  CASE WHEN issue_text = '' THEN 'Good quality'
       ELSE (CASE WHEN raw > 85 THEN 'High quality' WHEN raw > 70 THEN 'Good quality'
                  WHEN raw > 50 THEN 'Fair quality' ELSE 'Poor quality' END) || '; ' || issue_text END AS quality_issues,
  round(least(100.0, least(100.0, greatest(0, least(100, raw)) * (1 - null_pct / 100.0))
        + CASE WHEN type = 'Categorical' AND nunique > 1 AND nunique < total * 0.8 THEN 10
               WHEN type = 'Numeric' AND nunique > 10 THEN 15 ELSE 0 END), 1) AS importance
FROM fin"""


@query("feature_profile", profile_sql("lineitem", LINEITEM_COLS))
def q_feature_profile(spark, sf):
    """Feature table of lineitem sorted by importance."""
    return P.feature_profile(t(spark, sf, "lineitem"))


@query("feature_profile_nulls", profile_sql(DOC_LABELS_SQL, DOCLABEL_COLS))
def q_feature_profile_nulls(spark, sf):
    """G19 on documents LEFT JOIN labels (natural NULLs, id-like keys)."""
    return P.feature_profile(doc_labels(spark, sf))


@query("feature_profile_ordered", profile_sql("events", [c for c in EVENTS_COLS if c[0] != "event_id"], "event_id"))
def q_feature_profile_ordered(spark, sf):
    """G14/G19 with row order (first non-null text decides Date/Time)."""
    return P.feature_profile(t(spark, sf, "events"), order_by=["event_id"])


@query("feature_type", f"SELECT name, type, unique_count FROM ({profile_sql('lineitem', LINEITEM_COLS)})")
def q_feature_type(spark, sf):
    """Numeric / Categorical / Date/Time per column."""
    return P.feature_types(t(spark, sf, "lineitem"))


@query("feature_quality", f"SELECT name, type, quality_score, quality_issues FROM ({profile_sql(DOC_LABELS_SQL, DOCLABEL_COLS)})")
def q_feature_quality(spark, sf):
    """Quality score and issue list."""
    return P.feature_quality(doc_labels(spark, sf))


def _num_stats_sql(src, cols):
    parts = [f"""SELECT '{c}' AS name, round(min({c})::DOUBLE, 4) AS min, round(max({c})::DOUBLE, 4) AS max,
      round(avg({c}), 4) AS mean, round(quantile_cont({c}, 0.5), 4) AS median, round(stddev_samp({c}), 4) AS std,
      round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.75), 4) AS q75 FROM {src}"""
             for c, k, _ in cols if k == "numeric"]
    return " UNION ALL ".join(parts)


@query("stats_numeric", _num_stats_sql("lineitem", LINEITEM_COLS))
def q_stats_numeric(spark, sf):
    """Numeric statistics of every numeric column (one pass)."""
    return P.stats_numeric(t(spark, sf, "lineitem"))


def _cat_stats_sql(src, cols):
    parts = []
    for c in cols:
        parts.append(f"""SELECT '{c}' AS name, (SELECT count(DISTINCT {c}) FROM {src}) AS unique_values,
  (SELECT v FROM top WHERE rk = 1) AS most_frequent, coalesce((SELECT n FROM top WHERE rk = 1), 0) AS most_frequent_count,
  (SELECT string_agg(v || ':' || n || ':' || CAST(round(n * 100.0 / (SELECT count(*) FROM {src}), 2) AS VARCHAR), '|' ORDER BY rk) FROM top) AS top_values
  FROM (SELECT 1) z""")
    # each part needs its own 'top' CTE; wrap them
    wrapped = []
    for c, part in zip(cols, parts):
        wrapped.append(f"""(WITH top AS (SELECT v, n, row_number() OVER (ORDER BY n DESC, v) AS rk FROM
  (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {src} WHERE {c} IS NOT NULL GROUP BY 1) h QUALIFY rk <= 5)
  {part})""")
    return " UNION ALL ".join(wrapped)


@query("stats_categorical", _cat_stats_sql("customer", ["c_mktsegment", "c_nationkey"]).replace(
    "ORDER BY n DESC, v)", "ORDER BY n DESC, TRY_CAST(v AS DOUBLE) NULLS LAST, v)"))
def q_stats_categorical(spark, sf):
    """Distinct count, mode and top-5 values with % of all rows."""
    return P.stats_categorical(t(spark, sf, "customer"), ["c_mktsegment", "c_nationkey"])


@query("stats_date", """
SELECT 'o_orderdate' AS name, strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS earliest,
  strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS latest,
  CAST(CASE WHEN count(o_orderdate) > 1 THEN floor(epoch(max(o_orderdate)) / 86400 - epoch(min(o_orderdate)) / 86400) ELSE 0 END AS BIGINT) AS range_days
FROM orders""")
def q_stats_date(spark, sf):
    """Earliest / latest / whole days between."""
    return P.stats_date(t(spark, sf, "orders"), ["o_orderdate"])


def _describe_sql(src, cols):
    parts = [f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std,
      round(min({c})::DOUBLE, 4) AS min, round(quantile_cont({c}, 0.25), 4) AS p25, round(quantile_cont({c}, 0.5), 4) AS p50,
      round(quantile_cont({c}, 0.75), 4) AS p75, round(max({c})::DOUBLE, 4) AS max FROM {src}"""
             for c, k, _ in cols if k == "numeric"]
    return " UNION ALL ".join(parts)


@query("describe", _describe_sql("lineitem", LINEITEM_COLS))
def q_describe(spark, sf):
    """describe() of every numeric column (columns selected by dtype)."""
    return P.describe(t(spark, sf, "lineitem"))


@query("describe_nulls", _describe_sql(DOC_LABELS_SQL, DOCLABEL_COLS))
def q_describe_nulls(spark, sf):
    """G9 with NULLs (documents LEFT JOIN labels)."""
    return P.describe(doc_labels(spark, sf))


def _info_sql(src, cols):
    names = [c for c, _, _ in cols]
    miss = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in names)
    n = len(cols)
    kinds = [k for _, k, _ in cols]
    return f"""
SELECT CAST(count(*) AS BIGINT) AS rows, {n} AS columns, {kinds.count('numeric')} AS numeric_columns,
  {kinds.count('categorical')} AS categorical_columns, {kinds.count('datetime')} AS datetime_columns,
  CAST({miss} AS BIGINT) AS total_missing,
  CASE WHEN count(*) > 0 THEN round(({miss}) * 100.0 / (count(*) * {n}), 2) ELSE 0.0 END AS missing_percentage,
  (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM {src} GROUP BY ALL_COLS) g) AS duplicate_rows
FROM {src}""".replace("GROUP BY ALL_COLS", "GROUP BY " + ", ".join(names))


@query("dataset_info", _info_sql(DOC_LABELS_SQL, DOCLABEL_COLS))
def q_dataset_info(spark, sf):
    """Rows, columns, type counts, missing cells and duplicate rows."""
    return P.dataset_info(doc_labels(spark, sf))


@query("dataset_info_dups", _info_sql("(SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem)",
                                      [("l_returnflag", "categorical", False), ("l_linestatus", "categorical", False),
                                       ("l_quantity", "numeric", False)]))
def q_dataset_info_dups(spark, sf):
    """G10/G11 on a projection with many duplicate rows."""
    return P.dataset_info(t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


@query("missing_by_column", """
SELECT "column", missing_count, round(missing_count * 100.0 / t, 2) AS missing_percentage FROM (
  SELECT 'quality' AS "column", count(*) FILTER (WHERE quality IS NULL) AS missing_count, count(*) AS t FROM """ + DOC_LABELS_SQL + """ x
  UNION ALL SELECT 'toxic', count(*) FILTER (WHERE toxic IS NULL), count(*) FROM """ + DOC_LABELS_SQL + """ y
) WHERE missing_count > 0""")
def q_missing_by_column(spark, sf):
    """Per-column missing count and % (columns with any missing)."""
    return P.missing_by_column(doc_labels(spark, sf))


@query("duplicate_rows", """
SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_rows FROM
 (SELECT count(*) AS c FROM lineitem GROUP BY l_returnflag, l_linestatus, l_quantity, l_discount)""")
def q_duplicate_rows(spark, sf):
    """Rows beyond the first of each identical group."""
    return P.duplicate_rows(t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount"))


@query("nunique", " UNION ALL ".join(
    f"SELECT '{c}' AS name, count(DISTINCT {c}) AS nunique FROM lineitem" for c, _, _ in LINEITEM_COLS))
def q_nunique(spark, sf):
    """Distinct non-null values per column."""
    return P.nunique(t(spark, sf, "lineitem"))


@query("problem_type", """
SELECT 'quality' AS "column", CASE WHEN count(quality) = 0 THEN 'classification'
  WHEN count(DISTINCT quality) <= 10 OR count(DISTINCT quality) / count(quality) < 0.05 THEN 'classification'
  ELSE 'regression' END AS problem_type FROM """ + DOC_LABELS_SQL + """ x""")
def q_problem_type(spark, sf):
    """Classification vs regression from the target column."""
    return P.problem_type(doc_labels(spark, sf), "quality")


@query("problem_type_regression", """
SELECT 'o_totalprice' AS "column", CASE WHEN count(DISTINCT o_totalprice) <= 10
  OR count(DISTINCT o_totalprice) / count(o_totalprice) < 0.05 THEN 'classification' ELSE 'regression' END AS problem_type FROM orders""")
def q_problem_type_regression(spark, sf):
    """G13 on a continuous numeric target."""
    return P.problem_type(t(spark, sf, "orders"), "o_totalprice")


def _column_info_sql():
    cols = [("user_id", "bigint", True), ("event_type", "string", False), ("value", "double", True),
            ("props", "string", False)]
    parts = []
    for c, dt, isnum in cols:
        task = ("CASE WHEN count(DISTINCT {c}) <= 10 OR count(DISTINCT {c}) / count({c}) < 0.05 THEN 'classification' "
                "ELSE 'regression' END").format(c=c) if isnum else "'classification'"
        parts.append(f"""SELECT '{c}' AS name, '{dt}' AS dtype, CAST(count(*) - count({c}) AS BIGINT) AS missing_count,
  round((count(*) - count({c})) * 100.0 / count(*), 2) AS missing_percentage, count(DISTINCT {c}) AS unique_values,
  {str(isnum).upper()} AS is_numeric, count({c}) > 0 AS is_target_candidate,
  coalesce((SELECT string_agg(v, ', ' ORDER BY event_id) FROM (SELECT CAST({c} AS VARCHAR) AS v, event_id FROM events
     WHERE {c} IS NOT NULL ORDER BY event_id LIMIT 3)), '') AS sample_values,
  CASE WHEN count({c}) > 0 THEN {task} END AS recommended_task FROM events""")
    return " UNION ALL ".join(parts)


@query("column_info", _column_info_sql())
def q_column_info(spark, sf):
    """Training column table with three first samples in row order."""
    e = t(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props")
    return P.column_info(e, ["event_id"])


def _name_type_sql(col: str) -> str:
    n = f"lower({col})"
    num = " OR ".join(f"contains({n}, '{w}')" for w in P.NAME_NUMERIC)
    dt = " OR ".join(f"contains({n}, '{w}')" for w in P.NAME_DATETIME)
    return f"CASE WHEN {num} THEN 'numeric' WHEN {dt} THEN 'datetime' ELSE 'categorical' END"


@query("profile_name_types", f"""SELECT name, type, quality_score,
  CASE WHEN quality_score >= 80 THEN 'good' WHEN quality_score >= 60 THEN 'warning' ELSE 'poor' END AS quality_band,
  {_name_type_sql('name')} AS name_type FROM ({profile_sql(DOC_LABELS_SQL, DOCLABEL_COLS)})""")
def q_profile_name_types(spark, sf):
    """Quality colour band and the name-based type guess next to the profiled type."""
    p = P.profile_frame(doc_labels(spark, sf), top=0)
    return p.select("name", "type", "quality_score", P.quality_band(F.col("quality_score")).alias("quality_band"),
                    P.infer_type_by_name(F.col("name")).alias("name_type"))
