"""Previews, pages, deterministic samples, top-k and arg-max.

Every "first n" has an explicit order with a unique tiebreak. ``orderBy +
limit`` plans as TakeOrderedAndProject (each task keeps its own top n), and a
``row_number() <= k`` filter per group plans as a group limit applied before
the shuffle, so neither moves the whole table through one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import named, quoted


def preview(df: DataFrame, order_by: list[str], n: int = 20) -> DataFrame:
    """First ``n`` rows in ``order_by`` order."""
    return df.orderBy(*named(order_by)).limit(n)


def page(df: DataFrame, order_by: list[str], start: int = 0, length: int = 10) -> DataFrame:
    """Rows [start, start + length) in order, with the table's total row count."""
    total = df.count()  # scalar action
    return df.orderBy(*named(order_by)).offset(start).limit(length).withColumn("total", F.lit(total).cast("long"))


def sample_n(df: DataFrame, key: str, n: int, salt: str = "") -> DataFrame:
    """Deterministic fixed-size sample: the ``n`` rows with the smallest md5 of the key."""
    h = F.md5(F.concat(F.lit(salt), quoted(key).cast("string")))
    return df.withColumn("_h", h).orderBy("_h", quoted(key)).limit(n).drop("_h")


def sample_fraction(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Bernoulli sample (no row count needed)."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def top_k(df: DataFrame, col: str, k: int, by: list[str] | None = None, tiebreak: str | None = None,
          descending: bool = True) -> DataFrame:
    """Top ``k`` rows by ``col`` (per group when ``by``)."""
    order = [quoted(col).desc() if descending else quoted(col).asc()]
    if tiebreak:
        order.append(quoted(tiebreak).asc())
    if not by:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*named(by)).orderBy(*order)
    return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= k).drop("_rk")


def argmax(df: DataFrame, key: str, value: str, tiebreak: str) -> DataFrame:
    """Row with the largest ``value`` per ``key`` (smallest ``tiebreak`` on ties)."""
    others = [c for c in df.columns if c != key]
    pick = F.max_by(F.struct(*named(others)), F.struct(quoted(value), -quoted(tiebreak)))
    return df.groupBy(quoted(key)).agg(pick.alias("_r")).select(quoted(key), "_r.*")


def search(df: DataFrame, cols: list[str], text: str) -> DataFrame:
    """Rows where any of ``cols`` contains ``text`` (case-insensitive)."""
    t = text.lower()
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.coalesce(F.lower(quoted(c)).contains(t), F.lit(False))
    return df.filter(cond)
