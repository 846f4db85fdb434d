"""Helpers shared by the operators of this subpackage.

Words are maximal runs of characters other than ASCII white space
(``[^\\x20\\x09-\\x0D]+``) in every operator that counts words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_root, scratch_path, ship_package

SPACE_CLASS = "[\\x20\\x09-\\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"

ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}

# Sizes below which a side may be broadcast (rows of a few dozen bytes each).
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Packed:
    """A caller's rows with names of our own: ``df`` has the column ``__row``, a struct of the
    caller's columns (those to ``keep``; all), and the columns used, so that no name of theirs
    meets one of ours."""

    def __init__(self, rows: DataFrame, keep: list[str] | None = None, **used: str):
        self.columns = rows.columns if keep is None else list(keep)
        named = lambda c: rows[f"`{c.replace('`', '``')}`"]
        whole = F.struct(*(named(c).alias(f"c{i}") for i, c in enumerate(self.columns))).alias("__row")
        self.df = rows.select(whole, *(named(c).alias(ours) for ours, c in used.items()))

    def unpacked(self, out: DataFrame, results: tuple[str, ...] = (), **changed: str) -> DataFrame:
        """The caller's columns and ``results``, which replace theirs of equal name; ``changed`` gives
        the new value (our column) of theirs."""
        new = {c: ours for ours, c in changed.items()}
        row = [(F.col(new[c]) if c in new else F.col("__row")[f"c{i}"]).alias(c) for i, c in enumerate(self.columns) if c not in results]
        return out.select(*row, *results)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times (also inside lambdas).

    A projected alias may be inlined by the optimizer into a lambda body and be
    evaluated again for every element; a lambda variable never is.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """array<string> of the words; empty for null and blank texts."""
    return let(F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS)),
               lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_CLASS)))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: computed once,
    lineage cut, and no copy on any single executor."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, fn, schema) -> DataFrame:
    """mapInArrow with this package on the workers, in batches of a few megabytes:
    the buffers of both sides and what Python makes of them stay small."""
    ship_package(df.sparkSession)
    for name, value in ARROW_BATCH.items():
        df.sparkSession.conf.set(name, value)
    return df.mapInArrow(fn, schema)


def reliable(df: DataFrame) -> DataFrame:
    """checkpoint() into the folder of ``spark.checkpoint.dir``."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting: beyond ``rows`` the plain
    (shuffled, skew-split) join runs instead. ``df`` must be cheap to count
    (a written table or a checkpoint)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def running_offsets(counts: DataFrame, by: list[str], bucket: str, n: str = "n",
                    offset: str = "offset", total: str = "total", fan: int = 4096) -> DataFrame:
    """Exclusive running sum of ``n`` over ``bucket`` within ``by``, in two
    levels, so that no task orders more than ``fan`` buckets, plus one row for
    each ``fan`` buckets of a key."""
    c = counts.withColumn("__hi", F.expr(f"{bucket} div {fan}"))
    top = c.groupBy(*by, "__hi").agg(F.sum(n).alias("__t"))
    w_top = Window.partitionBy(*by).orderBy("__hi")
    w_all = Window.partitionBy(*by)
    top = top.select(*by, "__hi",
                     (F.sum("__t").over(w_top.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__t")).alias("__base"),
                     F.sum("__t").over(w_all).alias(total))
    w_low = Window.partitionBy(*by, "__hi").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    low = c.withColumn("__low", F.sum(n).over(w_low) - F.col(n))
    return (low.join(top, [*by, "__hi"])
            .select(*by, bucket, n, (F.col("__base") + F.col("__low")).alias(offset), total))
