"""Source / sink queries (S1-S15): scans, CSV round trip, versions, operation lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import rnd
from ..operators import clean as C
from ..session import scratch_path
from ..sources import ingest as I
from ..sources import records as R
from ..sources import versions as V
from .oplist import run_operations
from .registry import query
from .tables import EVENTS_GAPPY_SQL, events_gappy, t


@query("scan", """SELECT l_orderkey, l_quantity, l_extendedprice FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1998-01-01 00:00:00' AND l_quantity > 45""")
def q_scan(spark, sf):
    """Parquet scan with both filters pushed to the reader and a 3-column projection."""
    pred = (F.col("l_shipdate") >= F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")) & (F.col("l_quantity") > 45)
    return I.scan_table(spark, sf, "lineitem", ["l_orderkey", "l_quantity", "l_extendedprice"], pred,
                        ["l_shipdate", "l_quantity"])


@query("csv_roundtrip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_csv_roundtrip(spark, sf):
    """Write customer as ';'-separated CSV, probe the format, read it back."""
    path = scratch_path(spark, "csv-roundtrip")
    src = t(spark, sf, "customer")
    src.write.option("header", True).option("sep", ";").csv(path)
    back = I.read_csv_tolerant(spark, path)
    return back.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name",
                       F.col("c_nationkey").cast("int").alias("c_nationkey"),
                       F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")


_TEXT_OR_NULL = "CASE WHEN text NOT IN (" + ", ".join("'" + x + "'" for x in R.NA_TEXTS) + ") THEN text END"


@query("csv_quoted", f"SELECT doc_id, source, {_TEXT_OR_NULL} AS text, length({_TEXT_OR_NULL}) AS n FROM documents")
def q_csv_quoted(spark, sf):
    """Write all documents as quoted CSV, line ends inside quotes, and read them back."""
    path = I.write_table(t(spark, sf, "documents").select("doc_id", "source", "text"), scratch_path(spark, "csv-quoted"), "csv")
    return I.read_csv_tolerant(spark, path).withColumn("n", F.length("text").cast("long"))


@query("schema_peek", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 5")
def q_schema_peek(spark, sf):
    """S3: the first five rows (a bounded preview)."""
    return I.schema_peek(t(spark, sf, "orders"), ["o_orderkey"], 5)


def _versions_root(spark):
    return scratch_path(spark, "versions")


_V1 = "(SELECT * FROM customer)"
_V2 = "(SELECT * FROM customer WHERE c_acctbal >= 0)"


@query("version_history", f"""
SELECT * FROM (VALUES
  (4, 'Restored from version 1', (SELECT count(*) FROM {_V1} a), 5, 'current'),
  (3, 'Manual snapshot', (SELECT count(*) FROM {_V2} b), 5, 'previous'),
  (2, 'Dropped negative balances', (SELECT count(*) FROM {_V2} c), 5, 'previous'),
  (1, 'Initial version', (SELECT count(*) FROM {_V1} d), 5, 'previous'))
  v(version, changes, rows, columns, status)""")
def q_version_history(spark, sf):
    """Save, new version, snapshot, restore; list versions newest first."""
    root = _versions_root(spark)
    cust = t(spark, sf, "customer")
    V.save_version(cust, root, "customer")
    V.save_version(cust.filter(F.col("c_acctbal") >= 0), root, "customer", "Dropped negative balances")
    V.snapshot(spark, root, "customer")
    V.restore_version(spark, root, "customer", 1)
    lv = V.list_versions(spark, root, "customer")
    return lv.select("version", "changes", "rows", "columns", "status")


@query("read_version", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal >= 0 GROUP BY 1")
def q_read_version(spark, sf):
    """Time travel to version 1 of a branch (loaded as working set) and aggregate it."""
    root = _versions_root(spark)
    cust = t(spark, sf, "customer")
    V.save_version(cust, root, "customer")
    V.save_version(cust.filter(F.col("c_acctbal") >= 0), root, "customer", "Dropped negative balances")
    V.branch(spark, root, "customer", 2, "customer_work")
    v = V.read_version(spark, root, "customer_work", 1)
    return v.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("update_version", """SELECT 1 AS version, 'current' AS status, count(*) AS rows FROM customer WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 2, 'previous', count(*) FROM customer""")
def q_update_version(spark, sf):
    """Replacing version 1 writes a new directory and makes version 1 current again."""
    root = _versions_root(spark)
    cust = t(spark, sf, "customer")
    V.save_version(cust, root, "customer")
    V.save_version(cust, root, "customer", "copy")
    V.update_version(cust.filter(F.col("c_mktsegment") == "BUILDING"), root, "customer", 1, "edited")
    return V.list_versions(spark, root, "customer").select("version", "status", "rows")


def _ops():
    return [
        {"function": "handle_missing", "columns": ["value"], "method": "mean"},
        {"function": "fix_data_types", "columns": ["user_id"], "dtype": "str"},
        {"function": "remove_outliers", "columns": ["value"], "method": "IQR"},
        {"function": "encode_categorical", "columns": ["event_type"], "method": "label"},
        {"function": "handle_missing", "columns": ["no_such_column"], "method": "drop"},
    ]


_OPS_SQL = f"""WITH g AS {EVENTS_GAPPY_SQL},
f AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, event_type,
             coalesce(value, (SELECT avg(value) FROM g)) AS value FROM g),
q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM f),
o AS (SELECT f.* FROM f, q WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1))"""


@query("operation_list", _OPS_SQL + """
SELECT event_id, user_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS BIGINT) AS event_type, round(value, 4) AS value FROM o""")
def q_operation_list(spark, sf):
    """P10/F2: an ordered list of cleaning steps (a bad step is reported and skipped)."""
    df = events_gappy(spark, sf).select("event_id", "user_id", "event_type", "value")
    out, _report = run_operations(df, _ops(), ["event_id"], count_rows=False)
    return out.select("event_id", "user_id", "event_type", rnd("value", 4).alias("value"))


@query("operation_report", _OPS_SQL + """
SELECT * FROM (VALUES (1, 'handle_missing', 'value', 'ok', ''),
 (2, 'fix_data_types', 'user_id', 'ok', ''), (3, 'remove_outliers', 'value', 'ok', ''),
 (4, 'encode_categorical', 'event_type', 'ok', ''),
 (5, 'handle_missing', 'no_such_column', 'warning', 'columns not found: no_such_column')) r(step, function, columns, status, message)
UNION ALL SELECT 0, 'shape', '', 'ok',
  'rows ' || (SELECT count(*) FROM events) || ' -> ' || (SELECT count(*) FROM o) || '; columns 4 -> 4'""")
def q_operation_report(spark, sf):
    """P10: shapes before and after, and the per-step report of the operation list over events."""
    df = events_gappy(spark, sf).select("event_id", "user_id", "event_type", "value")
    _out, report = run_operations(df, _ops(), ["event_id"])
    return report


@query("drop_dataset", "SELECT 'customer' AS dataset, count(*) AS rows_before, TRUE AS dropped FROM customer")
def q_drop_dataset(spark, sf):
    """A dataset disappears from the listing after it is dropped."""
    root = _versions_root(spark)
    cust = t(spark, sf, "customer")
    V.save_version(cust, root, "customer")
    before = V.read_version(spark, root, "customer").count()
    V.drop_dataset(spark, root, "customer")
    gone = V.list_datasets(spark, root).filter(F.col("dataset") == "customer").count() == 0
    return spark.createDataFrame([("customer", before, gone)], "dataset string, rows_before long, dropped boolean")


@query("remove_outliers_version", """SELECT 2 AS version, 'Removed outliers from value (IQR)' AS changes, count(*) AS rows
FROM events, (SELECT quantile_cont(value, 0.25) q1, quantile_cont(value, 0.75) q3 FROM events) b
WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)""")
def q_remove_outliers_version(spark, sf):
    """Removing outliers saves a new version when rows were removed."""
    root = _versions_root(spark)
    ev = t(spark, sf, "events")
    V.save_version(ev, root, "events")
    cleaned = C.remove_outliers(ev, "value", "IQR")
    V.save_version(cleaned, root, "events", "Removed outliers from value (IQR)")
    return V.list_versions(spark, root, "events").filter(F.col("version") == 2).select("version", "changes", "rows")
