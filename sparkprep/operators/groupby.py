"""Group-by aggregation of one column, carrying the other columns along.

The reference groups, then merges a second group-by of the other columns
back on the key. Here scalar methods and the carried columns are one
``groupBy.agg`` (the left join on the key is folded away, ``min_by`` / ``max_by``
combine map-side). Text lists are built in two levels — partial ordered texts
per (key, order bucket), then one concatenation per key — so a key holding a
third of all rows is not gathered and sorted in one task; ``unique_list``
first reduces (key, value) pairs to their first position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import named, quoted
from ..sources.ingest import is_numeric
from . import scan

METHODS = ("list", "unique_list", "count", "sum", "mean", "first", "last")
LIST_SEPARATOR = ", "


def _ord(order_by) -> Column:
    if isinstance(order_by, str):
        order_by = [order_by]
    return F.struct(*[quoted(c) for c in order_by])


def first_non_null(c: str, order_by) -> Column:
    """First non-null value of ``c`` in ``order_by`` order (partial-aggregatable)."""
    return F.min_by(quoted(c), F.when(quoted(c).isNotNull(), _ord(order_by)))


def last_non_null(c: str, order_by) -> Column:
    return F.max_by(quoted(c), F.when(quoted(c).isNotNull(), _ord(order_by)))


def ordered_list(value: Column, order: Column, sep: str = LIST_SEPARATOR, distinct: bool = False) -> Column:
    """Join the non-null values of a group as text in ``order`` order."""
    items = F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.cast("string").alias("v"))))
    vals = F.transform(F.array_sort(items), lambda x: x["v"])
    if distinct:
        vals = F.array_distinct(vals)  # keeps the first occurrence
    return F.array_join(vals, sep)


def two_level_list(rows: DataFrame, key: str, value: str, order_by: list[str], out_name: str,
                   n_buckets: int | None = None, sep: str = LIST_SEPARATOR) -> DataFrame:
    """(key, joined text) built in two levels so a hot key is not sorted in one task.

    Rows are range-bucketed on the leading order column; every (key, bucket)
    builds its ordered partial text in parallel, then each key concatenates its
    <= n_buckets partial texts in bucket order.
    """
    nb = scan.choose_buckets(rows, n_buckets)
    if nb <= 1:
        return rows.groupBy(quoted(key)).agg(ordered_list(quoted(value), _ord(order_by), sep).alias(out_name))
    b = scan.add_order_bucket(rows.filter(quoted(value).isNotNull()), order_by, n_buckets=nb)
    parts = b.groupBy(quoted(key), scan.BUCKET_COL).agg(ordered_list(quoted(value), _ord(order_by), sep).alias("_part"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(scan.BUCKET_COL, "_part"))),
                                     lambda x: x["_part"]), sep)
    return parts.groupBy(quoted(key)).agg(whole.alias(out_name))


def group_aggregate(df: DataFrame, key: str, col: str, method: str = "list", order_by=None,
                    carry: bool = True, sort: bool = False, n_buckets: int | None = None) -> DataFrame:
    """Group by ``key`` (NULL keys dropped), aggregate ``col`` with ``method``.

    Output: key, ``<col>_<method>``, then every other column's first non-null
    value in ``order_by`` order (when ``carry``).
    """
    if method not in METHODS:
        raise ValueError(f"Unsupported aggregation method: {method}")
    for c in (key, col):
        if c not in df.columns:
            raise ValueError(f"Column '{c}' not found in DataFrame")
    if method in ("sum", "mean") and not is_numeric(df, col):
        raise ValueError(f"Cannot aggregate non-numeric column '{col}' with {method}")
    needs_order = method in ("list", "unique_list", "first", "last") or carry
    others = [c for c in df.columns if c not in (key, col)] if carry else []
    if needs_order and order_by is None and (method in ("list", "unique_list", "first", "last") or others):
        raise ValueError("order_by is required for row-order dependent aggregation")
    src = df.filter(quoted(key).isNotNull())
    out_name = f"{col}_{method}"
    v = quoted(col)
    carry_aggs = [first_non_null(c, order_by).alias(c) for c in others]

    if method in ("unique_list", "list"):
        order = [order_by] if isinstance(order_by, str) else list(order_by)
        if method == "unique_list":
            # (key, value) first-seen position, combined map-side before any list is built
            firsts = (src.filter(v.isNotNull()).groupBy(quoted(key), quoted(col))
                      .agg(F.min(_ord(order)).alias("_o")))
            firsts = firsts.select(quoted(key), quoted(col), *[F.col("_o").getField(c).alias(c) for c in order])
            lists = two_level_list(firsts, key, col, order, out_name, n_buckets)
        else:
            lists = two_level_list(src.select(quoted(key), quoted(col), *[c for c in order if c not in (key, col)]),
                                   key, col, order, out_name, n_buckets)
        if carry_aggs:
            rest = src.groupBy(quoted(key)).agg(*carry_aggs)
            out = rest.join(lists, key, "left").withColumn(out_name, F.coalesce(out_name, F.lit("")))
        else:
            keys = src.select(quoted(key)).distinct()
            out = keys.join(lists, key, "left").withColumn(out_name, F.coalesce(out_name, F.lit("")))
        out = out.select(quoted(key), out_name, *named(others))
    else:
        if method == "count":
            main = F.count(v)
        elif method == "sum":
            main = F.coalesce(F.sum(v), F.lit(0).cast(df.schema[col].dataType))
        elif method == "mean":
            main = F.avg(v)
        elif method == "first":
            main = first_non_null(col, order_by)
        else:
            main = last_non_null(col, order_by)
        out = src.groupBy(quoted(key)).agg(main.alias(out_name), *carry_aggs)
    return out.orderBy(quoted(key)) if sort else out


def baskets(df: DataFrame, key: str, item: str) -> DataFrame:
    """(key, items): the distinct items of each transaction as a sorted array."""
    return (df.filter(quoted(key).isNotNull() & quoted(item).isNotNull())
            .groupBy(quoted(key)).agg(F.array_sort(F.collect_set(quoted(item).cast("string"))).alias("items")))
