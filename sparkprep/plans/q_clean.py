"""Cleaning and outlier queries (C1-C26, P4, P6, P7, J4) with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import rnd
from ..operators import clean as C
from ..operators import outliers as O
from .registry import query
from .tables import EVENTS_GAPPY_SQL, events_gappy, events_text, t

LI_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LI_REST = [c for c in LI_ALL if c not in ("l_orderkey", "l_linenumber")]


def _docs(spark, sf):
    return t(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")


# ------------------------------------------------------------------ duplicates
@query("dedup_first", """
SELECT doc_id, lang, source, n_chars FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1""")
def q_dedup_first(spark, sf):
    """Keep the first document of every identical text."""
    return C.drop_duplicates(_docs(spark, sf), ["text"], "first", "doc_id").drop("text")


@query("dedup_last", """
SELECT doc_id, lang, source, n_chars FROM documents
QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) = 1""")
def q_dedup_last(spark, sf):
    """Keep the last document of every identical text."""
    return C.drop_duplicates(_docs(spark, sf), ["text"], "last", "doc_id").drop("text")


@query("dedup_none", """
SELECT doc_id, lang, source, n_chars FROM documents
QUALIFY count(*) OVER (PARTITION BY text) = 1""")
def q_dedup_none(spark, sf):
    """Drop every member of a duplicated text group."""
    return C.drop_duplicates(_docs(spark, sf), ["text"], "none").drop("text")


@query("dedup_subset", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CAST(l_shipdate AS VARCHAR) AS l_shipdate FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(LI_REST)}) = 1""")
def q_dedup_subset(spark, sf):
    """C4: duplicates on (l_orderkey, l_linenumber), first by the remaining columns."""
    li = t(spark, sf, "lineitem")
    out = C.drop_duplicates(li, ["l_orderkey", "l_linenumber"], "first", LI_REST)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                      F.col("l_shipdate").cast("string").alias("l_shipdate"))


@query("dedup_subset_none", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1""")
def q_dedup_subset_none(spark, sf):
    """C4 with keep=none on a column subset."""
    li = t(spark, sf, "lineitem")
    return C.drop_duplicates(li, ["l_orderkey", "l_linenumber"], "none").select("l_orderkey", "l_linenumber", "l_partkey")


@query("dedup_all_columns", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def q_dedup_all_columns(spark, sf):
    """C1 on all columns of a projection with many identical rows."""
    return C.drop_duplicates(t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity"))


@query("dedup_all_none", """
SELECT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem
GROUP BY ALL HAVING count(*) = 1""")
def q_dedup_all_none(spark, sf):
    """C3 on all columns of a projection."""
    return C.drop_duplicates(t(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount"),
                             keep="none")


# ------------------------------------------------------------------ missing values
@query("missing_drop", f"SELECT event_id, value FROM {EVENTS_GAPPY_SQL} g WHERE value IS NOT NULL")
def q_missing_drop(spark, sf):
    """Drop rows whose value is NULL."""
    return C.fill_missing(events_gappy(spark, sf), "value", "drop").select("event_id", "value")


@query("missing_mean", f"""
SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM {EVENTS_GAPPY_SQL} a)), 4) AS value FROM {EVENTS_GAPPY_SQL} g""")
def q_missing_mean(spark, sf):
    """Fill NULL with the column mean."""
    out = C.fill_missing(events_gappy(spark, sf), "value", "mean")
    return out.select("event_id", rnd("value", 4).alias("value"))


@query("missing_median", f"""
SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM {EVENTS_GAPPY_SQL} a)), 4) AS value FROM {EVENTS_GAPPY_SQL} g""")
def q_missing_median(spark, sf):
    """Fill NULL with the exact (interpolated) median."""
    out = C.fill_missing(events_gappy(spark, sf), "value", "median")
    return out.select("event_id", rnd("value", 4).alias("value"))


@query("missing_mode", """
WITH dl AS (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
m AS (SELECT quality FROM dl WHERE quality IS NOT NULL GROUP BY quality ORDER BY count(*) DESC, quality LIMIT 1)
SELECT doc_id, coalesce(quality, (SELECT quality FROM m)) AS quality FROM dl""")
def q_missing_mode(spark, sf):
    """Fill NULL with the most frequent value (smallest on ties)."""
    d = t(spark, sf, "documents").select("doc_id").join(t(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return C.fill_missing(d, "quality", "mode").select("doc_id", "quality")


@query("missing_mode_text", """
WITH g AS (SELECT event_id, CASE WHEN value > 100 THEN NULL ELSE event_type END AS event_type FROM events),
m AS (SELECT event_type FROM g WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 1)
SELECT event_id, coalesce(event_type, (SELECT event_type FROM m)) AS event_type FROM g""")
def q_missing_mode_text(spark, sf):
    """C8 on a text column."""
    e = t(spark, sf, "events").select("event_id", F.when(F.col("value") > 100, F.lit(None))
                                      .otherwise(F.col("event_type")).alias("event_type"))
    return C.fill_missing(e, "event_type", "mode")


@query("missing_ffill", f"""
SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
FROM {EVENTS_GAPPY_SQL} g""")
def q_missing_ffill(spark, sf):
    """Forward fill in (ts, event_id) order over the whole table (two-level scan)."""
    out = C.fill_missing(events_gappy(spark, sf), "value", "forward_fill", ["ts", "event_id"])
    return out.select("event_id", "value")


@query("missing_bfill", f"""
SELECT event_id, first_value(value IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value
FROM {EVENTS_GAPPY_SQL} g""")
def q_missing_bfill(spark, sf):
    """Backward fill in (ts, event_id) order."""
    out = C.fill_missing(events_gappy(spark, sf), "value", "backward_fill", ["ts", "event_id"])
    return out.select("event_id", "value")


@query("missing_ffill_keyed", f"""
SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM {EVENTS_GAPPY_SQL} g""")
def q_missing_ffill_keyed(spark, sf):
    """C9 per user (hot users are split over order buckets)."""
    out = C.fill_missing(events_gappy(spark, sf), "value", "forward_fill", ["ts", "event_id"], by=["user_id"])
    return out.select("event_id", "value")


@query("missing_bfill_keyed", f"""
SELECT event_id, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM {EVENTS_GAPPY_SQL} g""")
def q_missing_bfill_keyed(spark, sf):
    """C10 per user."""
    out = C.fill_missing(events_gappy(spark, sf), "value", "backward_fill", ["ts", "event_id"], by=["user_id"])
    return out.select("event_id", "value")


# ------------------------------------------------------------------ types
TEXT_SQL = ("(SELECT event_id, event_type, CAST(value AS VARCHAR) AS value_text, "
            "json_extract_string(props, '$.k') AS k_text FROM events)")


@query("to_int", f"""
SELECT event_id, CAST(round_even(try_cast(value_text AS DOUBLE), 0) AS BIGINT) AS value_text,
  CAST(round_even(try_cast(event_type AS DOUBLE), 0) AS BIGINT) AS event_type FROM {TEXT_SQL} x""")
def q_to_int(spark, sf):
    """C11: text -> int, half to even, unparsable -> NULL."""
    e = events_text(spark, sf)
    e = C.convert_type(C.convert_type(e, "value_text", "int"), "event_type", "int")
    return e.select("event_id", "value_text", "event_type")


@query("to_int_numeric", """
SELECT o_orderkey, CAST(round_even(o_totalprice / 1000.0, 0) AS BIGINT) AS o_totalprice FROM orders""")
def q_to_int_numeric(spark, sf):
    """C11 from a double column (banker's rounding of price / 1000)."""
    o = t(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000.0).alias("o_totalprice"))
    return C.convert_type(o, "o_totalprice", "int")


@query("to_float", f"SELECT event_id, try_cast(k_text AS DOUBLE) AS k_text, try_cast(event_type AS DOUBLE) AS event_type FROM {TEXT_SQL} x")
def q_to_float(spark, sf):
    """Text -> double, unparsable -> NULL."""
    e = events_text(spark, sf)
    e = C.convert_type(C.convert_type(e, "k_text", "float"), "event_type", "float")
    return e.select("event_id", "k_text", "event_type")


@query("to_str", "SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, CAST(value AS VARCHAR) AS value FROM events")
def q_to_str(spark, sf):
    """Numbers -> text (NULL stays NULL)."""
    e = t(spark, sf, "events").select("event_id", "user_id", "value")
    return C.convert_type(C.convert_type(e, "user_id", "str"), "value", "category")


@query("to_bool", f"""
SELECT event_id, CASE WHEN k_text IN ('True', 'true', '1') THEN TRUE WHEN k_text IN ('False', 'false', '0') THEN FALSE END AS k_text,
  user_id <> 0 AS user_id FROM (SELECT x.*, e.user_id FROM {TEXT_SQL} x JOIN events e USING (event_id))""")
def q_to_bool(spark, sf):
    """C14: text booleans (only six spellings map) and numeric != 0."""
    e = events_text(spark, sf).join(t(spark, sf, "events").select("event_id", "user_id"), "event_id")
    e = C.convert_type(C.convert_type(e, "k_text", "bool"), "user_id", "bool")
    return e.select("event_id", "k_text", "user_id")


# ------------------------------------------------------------------ encodings
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("encode_onehot", "SELECT c_custkey, c_nationkey, " + ", ".join(
    f"CAST(coalesce(c_mktsegment = '{s}', FALSE) AS INTEGER) AS \"c_mktsegment_{s}\"" for s in SEGMENTS) + " FROM customer")
def q_encode_onehot(spark, sf):
    """One-hot columns <col>_<value> in value order appended, source dropped."""
    c = t(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return C.encode(c, "c_mktsegment", "onehot")


@query("encode_label", "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS BIGINT) AS p_type FROM part")
def q_encode_label(spark, sf):
    """C17/M3/M4: 0-based code of the sorted text."""
    return C.encode(t(spark, sf, "part").select("p_partkey", "p_type"), "p_type", "label")


@query("encode_label_wide", "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_name) - 1 AS BIGINT) AS p_name FROM part")
def q_encode_label_wide(spark, sf):
    """C17 on a wider domain (distributed dense codes, no driver-side domain)."""
    return C.encode(t(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "label")


@query("encode_ordinal", "SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS DOUBLE) AS p_brand FROM part")
def q_encode_ordinal(spark, sf):
    """Same codes as double."""
    return C.encode(t(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", "ordinal")


# ------------------------------------------------------------------ outliers
IQR_B = "(SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)"
Z_B = "(SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)"
PCT_B = "(SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM events)"


@query("outlier_remove_iqr", f"""
SELECT event_id, value FROM events, {IQR_B} b WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)""")
def q_outlier_remove_iqr(spark, sf):
    """Keep rows within [Q1 - 1.5 IQR, Q3 + 1.5 IQR]."""
    return C.remove_outliers(t(spark, sf, "events"), "value", "IQR").select("event_id", "value")


@query("outlier_remove_z", f"SELECT event_id, value FROM events, {Z_B} b WHERE abs((value - m) / s) <= 3")
def q_outlier_remove_z(spark, sf):
    """C20: keep |z| <= 3 (sample std)."""
    return C.remove_outliers(t(spark, sf, "events"), "value", "Z-score").select("event_id", "value")


@query("outlier_remove_pct", f"SELECT event_id, value FROM events, {PCT_B} b WHERE value >= lo AND value <= hi")
def q_outlier_remove_pct(spark, sf):
    """Keep the 5th-95th percentile band."""
    return C.remove_outliers(t(spark, sf, "events"), "value", "percentile").select("event_id", "value")


@query("outlier_remove_nulls", f"""
SELECT event_id, value FROM {EVENTS_GAPPY_SQL} g, (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
  FROM {EVENTS_GAPPY_SQL} h) b WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)""")
def q_outlier_remove_nulls(spark, sf):
    """C19 with NULLs: NULL rows fail the bound test and are dropped."""
    return C.remove_outliers(events_gappy(spark, sf), "value", "IQR").select("event_id", "value")


@query("outlier_removal_report", f"""
SELECT (SELECT count(*) FROM events) AS rows_before, count(*) AS rows_after,
  (SELECT count(*) FROM events) - count(*) AS rows_removed
FROM events, {IQR_B} b WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)""")
def q_outlier_removal_report(spark, sf):
    """Rows before / after / removed."""
    e = t(spark, sf, "events")
    b = C.fit_outlier_bounds(e, "value", "IQR")
    return e.agg(F.count(F.lit(1)).alias("rows_before"),
                 F.count_if(C.inlier_expr("value", b)).alias("rows_after")).select(
        "rows_before", "rows_after", (F.col("rows_before") - F.col("rows_after")).alias("rows_removed"))


def _detect_sql(method, cond, lo, hi, src):
    return f"""
SELECT 'value' AS "column", '{method}' AS method, count(*) FILTER (WHERE {cond}) AS total_outliers,
  count(*) FILTER (WHERE {cond}) * 100.0 / count(*) AS outlier_percentage, {lo} AS lower, {hi} AS upper
FROM events, {src} b GROUP BY ALL"""


@query("outlier_detect_iqr", "SELECT \"column\", method, total_outliers, round(outlier_percentage, 6) AS outlier_percentage, "
       "round(lower, 6) AS lower, round(upper, 6) AS upper FROM (" + _detect_sql(
           "IQR", "value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)",
           "q1 - 1.5 * (q3 - q1)", "q3 + 1.5 * (q3 - q1)", IQR_B) + ")")
def q_outlier_detect_iqr(spark, sf):
    """IQR outlier count, % of all rows, bounds."""
    d = O.detect_outliers(t(spark, sf, "events"), "value", "IQR")
    return d.select("column", "method", "total_outliers", *[rnd(c, 6).alias(c) for c in
                                                             ("outlier_percentage", "lower", "upper")])


@query("outlier_detect_z", "SELECT \"column\", method, total_outliers, round(outlier_percentage, 6) AS outlier_percentage, "
       "round(lower, 6) AS lower, round(upper, 6) AS upper FROM (" + _detect_sql(
           "Z-score", "abs((value - m) / s) > 3", "m - 3 * s", "m + 3 * s", Z_B) + ")")
def q_outlier_detect_z(spark, sf):
    """Z-score outliers (|z| > 3)."""
    d = O.detect_outliers(t(spark, sf, "events"), "value", "Z-score")
    return d.select("column", "method", "total_outliers", *[rnd(c, 6).alias(c) for c in
                                                             ("outlier_percentage", "lower", "upper")])


@query("outlier_detect_pct", "SELECT \"column\", method, total_outliers, round(outlier_percentage, 6) AS outlier_percentage, "
       "round(lower, 6) AS lower, round(upper, 6) AS upper FROM (" + _detect_sql(
           "percentile", "value < lo OR value > hi", "lo", "hi", PCT_B) + ")")
def q_outlier_detect_pct(spark, sf):
    """Outside the 5th-95th percentile band."""
    d = O.detect_outliers(t(spark, sf, "events"), "value", "percentile")
    return d.select("column", "method", "total_outliers", *[rnd(c, 6).alias(c) for c in
                                                             ("outlier_percentage", "lower", "upper")])


@query("outlier_sample", f"""
SELECT event_id, value FROM events, {IQR_B} b WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)
ORDER BY event_id LIMIT 10""")
def q_outlier_sample(spark, sf):
    """First ten outlier values in row order (a top-k report)."""
    return O.outlier_sample(t(spark, sf, "events"), "value", ["event_id"])


OVERVIEW_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _overview_sql():
    cols = [("lineitem", c) for c in OVERVIEW_COLS]
    parts = []
    for tb, c in cols:
        parts.append(f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS total_outliers,
  round(count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) * 100.0 / count(*), 2) AS outlier_percentage
  FROM {tb}, (SELECT quantile_cont({c}, 0.25) q1, quantile_cont({c}, 0.75) q3 FROM {tb}) b""")
    return " UNION ALL ".join(parts)


@query("outlier_overview", _overview_sql())
def q_outlier_overview(spark, sf):
    """IQR outliers of every numeric column in two passes."""
    return O.outlier_overview(t(spark, sf, "lineitem").select(*OVERVIEW_COLS))


@query("outlier_histogram", """
WITH s AS (SELECT min(value) AS mn, max(value) AS mx, count(value) AS n FROM events),
b AS (SELECT least(CAST(floor((value - mn) / ((mx - mn) / 30)) AS INTEGER), 29) AS bin FROM events, s)
SELECT bin, round(mn + bin * ((mx - mn) / 30), 4) AS lo, round(mn + (bin + 1) * ((mx - mn) / 30), 4) AS hi,
  count(*) AS count, round(count(*) / (n * ((mx - mn) / 30)), 8) AS density FROM b, s GROUP BY bin, mn, mx, n""")
def q_outlier_histogram(spark, sf):
    """30-bin density histogram data."""
    return O.histogram(t(spark, sf, "events"), "value", 30)


@query("box_stats", f"""
WITH q AS (SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.5) md, quantile_cont(value, 0.75) q3 FROM events)
SELECT 'value' AS "column", round(q1, 4) AS q1, round(md, 4) AS median, round(q3, 4) AS q3, round(q3 - q1, 4) AS iqr,
  round(min(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_low,
  round(max(value) FILTER (WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)), 4) AS whisker_high,
  count(*) FILTER (WHERE NOT (value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1))) AS outliers
FROM events, q GROUP BY q1, md, q3""")
def q_box_stats(spark, sf):
    """Box-plot statistics."""
    return O.box_stats(t(spark, sf, "events"), "value")


@query("outlier_split", f"""
SELECT event_id, coalesce(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1), FALSE) AS is_outlier
FROM events, {IQR_B} b""")
def q_outlier_split(spark, sf):
    """Outlier / normal membership flag."""
    return O.flag_outliers(t(spark, sf, "events").select("event_id", "value"), "value").select("event_id", "is_outlier")


@query("outlier_scatter", f"""
SELECT CAST(row_number() OVER (ORDER BY event_id) - 1 AS BIGINT) AS position, value,
  coalesce(value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1), FALSE) AS is_outlier FROM events, {IQR_B} b""")
def q_outlier_scatter(spark, sf):
    """Index scatter data (global positions from the two-level scan)."""
    return O.index_scatter(t(spark, sf, "events"), "value", ["event_id"])
