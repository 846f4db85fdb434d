"""Ordered list of cleaning operations applied to one lazy DataFrame.

Each operation is a dict ``{"function": name, "columns": [...], ...}``; the
names dispatch to the DataFrame -> DataFrame functions of ``operators``. A
failing step (unknown column, wrong type) is recorded in the report and the
remaining steps still run. Only the fitted statistics of individual steps are
small actions; the whole list compiles into one plan that runs at the write.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import clean as C
from ..operators import groupby as G


def _dedup(df, op, order_by):
    method = op.get("method", "all_columns")
    cols = op.get("columns") or None
    if method == "selected_columns" and not cols:
        raise ValueError("No columns selected for duplicate check")
    if method not in ("all_columns", "selected_columns"):
        raise ValueError(f"Invalid method '{method}'")
    return C.drop_duplicates(df, cols if method == "selected_columns" else None, op.get("keep", "first"), order_by)


def _each_column(fn: Callable) -> Callable:
    def run(df, op, order_by):
        for c in op.get("columns", []):
            df = fn(df, c, op, order_by)
        return df
    return run


OPERATIONS: dict[str, Callable] = {
    "delete_duplicates": _dedup,
    "handle_missing": _each_column(lambda df, c, op, o: C.fill_missing(df, c, op.get("method", "drop"), o)),
    "fix_data_types": _each_column(lambda df, c, op, o: C.convert_type(df, c, op.get("dtype", "str"))),
    "encode_categorical": _each_column(lambda df, c, op, o: C.encode(df, c, op.get("method", "onehot"))),
    "remove_outliers": _each_column(lambda df, c, op, o: C.remove_outliers(df, c, op.get("method", "IQR"))),
    "group_by": lambda df, op, o: G.group_aggregate(df, op["columns"][0], op["aggregate_column"],
                                                    op.get("method", "list"), o),
}


def run_operations(df: DataFrame, operations: list[dict], order_by: list[str] | None = None,
                   count_rows: bool = True) -> tuple[DataFrame, DataFrame]:
    """Apply ``operations`` in order; returns (result, report).

    The report has one row per step (step, function, columns, status, message)
    plus the shape before and after when ``count_rows``.
    """
    spark = df.sparkSession
    rows = []
    out = df
    for i, op in enumerate(operations, start=1):
        name = op.get("function")
        cols = ",".join(op.get("columns", []) or [])
        fn = OPERATIONS.get(name)
        if fn is None:
            rows.append((i, name, cols, "warning", f"unknown function '{name}'"))
            continue
        missing = [c for c in op.get("columns", []) or [] if c not in out.columns]
        if missing and name != "delete_duplicates":
            rows.append((i, name, cols, "warning", f"columns not found: {', '.join(missing)}"))
            continue
        try:
            out = fn(out, op, order_by)
            rows.append((i, name, cols, "ok", ""))
        except Exception as e:  # a bad step is reported, the pipeline continues
            rows.append((i, name, cols, "warning", str(e).splitlines()[0][:300]))
    if count_rows:
        before, after = df.count(), out.count()
        rows.append((0, "shape", "", "ok",
                     f"rows {before} -> {after}; columns {len(df.columns)} -> {len(out.columns)}"))
    report = spark.createDataFrame(rows, "step int, function string, columns string, status string, message string")
    return out, report.orderBy(F.col("step"))
