"""Proportional stratified interleaving.

Rows are put in a seeded random order within their stratum; the row of rank r
of a stratum with n rows has fractional rank (2r - 1) / 2n. All rows are
ordered by fractional rank (then stratum) and the order is cut into shards of
counts at most one apart, so every shard holds the mixture of the whole.

Both ranks are computed in two levels: a row's bucket (a range of the order)
comes from the row alone, bucket totals give offsets, and only the rows of one
bucket are ordered in a task. Many small strata share a few fractional ranks: a
bucket much larger than it should be is split by fractional rank and range of the
stratum, a third level. The text is read once, for its size and checksum,
and is never shuffled.

Defined results: a null text has size 1 and checksum 0; a null stratum is a
stratum of its own; a null id is ordered like the empty text; equal rows are
ordered by size and checksum and else are interchangeable; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.scan import BUCKET_COL, add_order_bucket
from .common import reliable, running_offsets

ROWS_PER_BUCKET = 500
# a bucket of so many times its rows is split
CROWDED = 4


def _cells(ranked: DataFrame, rows_per_bucket: int) -> DataFrame:
    """``ranked`` by (__g, __cf, __cs), cells in their order that no task need
    split, and ``offset``, the number of rows before a row's cell."""
    whole = reliable(running_offsets(ranked.groupBy("__g").agg(F.count("*").alias("n")), [], "__g").select("__g", "n", "offset"))
    placed = ranked.join(whole, "__g")
    crowded = F.col("n") > CROWDED * rows_per_bucket
    cells = placed.filter(~crowded).drop("n").withColumns({"__cf": F.lit(0.0), "__cs": F.lit(0)})
    if whole.filter(crowded).isEmpty():
        return cells
    tied = reliable(placed.filter(crowded).drop("n"))
    tied = (add_order_bucket(tied, ["__s"]).withColumn("__cf", F.col("__f")).withColumn("__cs", F.col(BUCKET_COL).cast("int")).drop(BUCKET_COL))
    w = Window.partitionBy("__g").orderBy("__cf", "__cs").rowsBetween(Window.unboundedPreceding, 0)
    before = (tied.groupBy("__g", "__cf", "__cs").agg(F.count("*").alias("n"))
              .select("__g", "__cf", "__cs", (F.sum("n").over(w) - F.col("n")).alias("__low")))
    tied = tied.join(before, ["__g", "__cf", "__cs"]).withColumn("offset", F.col("offset") + F.col("__low")).drop("__low")
    return cells.unionByName(tied)


def interleaved_shards(df: DataFrame, n_shards: int = 16, seed: str = "mix-1", stratum: str = "source",
                       id_col: str = "doc_id", text_col: str = "text",
                       rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """id, size, text_crc32, stratum, stratum_rank, position, shard, slot."""
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        F.col(id_col).alias("__id"),
        F.when(F.col(stratum).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(stratum).cast("string"))).alias("__s"),
        F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")).alias("__h"),
        (F.octet_length(text).cast("long") + 1).alias("__size"),
        F.crc32(text.cast("binary")).alias("__crc"))
    n = df.count()
    n_buckets = max(1, -(-n // rows_per_bucket))
    # the leading 32 bits of the hash are uniform: equal ranges hold about equally many rows
    rows = rows.withColumn("__b", F.expr(f"(conv(substr(__h, 1, 8), 16, 10) * {n_buckets}) div 4294967296"))
    counts = rows.groupBy("__s", "__b").agg(F.count("*").alias("n"))
    offs = reliable(running_offsets(counts, ["__s"], "__b"))
    w = Window.partitionBy("__s", "__b").orderBy("__h", "__id", "__crc", "__size")
    ranked = (rows.join(offs.select("__s", "__b", "offset", "total"), ["__s", "__b"])
              .withColumn("__r", F.col("offset") + F.row_number().over(w))
              .withColumn("__f", (2 * F.col("__r") - 1).cast("double") / (2 * F.col("total")).cast("double"))
              .withColumn("__g", F.floor(F.col("__f") * n_buckets))
              .select("__id", "__s", "__r", "__f", "__g", "__size", "__crc"))
    ranked = reliable(ranked)
    wg = Window.partitionBy("__g", "__cf", "__cs").orderBy("__f", "__s")
    out = (_cells(ranked, rows_per_bucket)
           .withColumn("__p", F.col("offset") + F.row_number().over(wg) - 1)
           .withColumn("__k", F.expr(f"(__p * {n_shards}) div {max(n, 1)}")))
    return out.select(
        F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"),
        F.when(F.col("__s") != "n", F.expr("substr(__s, 2)")).alias("stratum"), F.col("__r").alias("stratum_rank"),
        F.col("__p").alias("position"), F.col("__k").cast("int").alias("shard"),
        F.expr(f"__p - (__k * {n}L + {n_shards - 1}) div {n_shards}").alias("slot"))
