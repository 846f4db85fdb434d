"""Pairwise correlation matrices: Pearson, Spearman and Kendall tau-b.

* Pearson: one aggregate for all pairs, pairwise-complete rows, zero variance
  gives NULL (``try_divide``; plain ``corr`` raises under ANSI).
* Spearman: Pearson of average ranks; ranks come from value histograms and a
  two-level running count (no global sort of raw rows).
* Kendall tau-b: no pair enumeration. Discordant pairs are counted as
  inversions, in numpy inside buckets of bounded size of either column (a row
  goes to one bucket per column), and by Spark over the grid of bucket counts.
  There, with ``r`` the number of the y bucket, a pair (i, j) with x_i < x_j is
  discordant iff at the first bit where r_i and r_j differ, r_i has 1: for every
  bit level cells are grouped by the higher bits, and a running count of 1-bits
  in x order (two-level scan) gives the pairs. ``kendall_pair`` does so with all rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import quoted, rnd
from ..session import materialize, ship_package
from . import scan

METHODS = ("pearson", "spearman", "kendall")

# Strength bands of the correlation heat map (|r| at least).
BANDS = [(0.8, "very strong"), (0.6, "strong"), (0.4, "moderate"), (0.2, "weak")]
BAND_FALLBACK = "very weak"
BUCKET_ROWS = 200_000  # rows of a bucket whose discordant pairs one call counts


def _pearson_pairs(df: DataFrame, cols: list[str], digits: int | None) -> DataFrame:
    aggs = []
    pairs = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if j < i:
                continue
            x, y = quoted(a).cast("double"), quoted(b).cast("double")
            both = x.isNotNull() & y.isNotNull()
            xs, ys = F.when(both, x), F.when(both, y)
            r = F.try_divide(F.covar_samp(xs, ys), F.stddev_samp(xs) * F.stddev_samp(ys))
            aggs.append(r.alias(f"r{i}_{j}"))
            pairs.append((i, j, a, b))
    wide = df.agg(*aggs)
    structs = []
    for i, j, a, b in pairs:
        rv = quoted(f"r{i}_{j}")
        if digits is not None:
            rv = rnd(rv, digits)
        structs.append(F.struct(F.lit(a).alias("col_x"), F.lit(b).alias("col_y"), rv.alias("r")))
        if i != j:
            structs.append(F.struct(F.lit(b).alias("col_x"), F.lit(a).alias("col_y"), rv.alias("r")))
    return wide.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def pearson(df: DataFrame, cols: list[str], digits: int | None = 4) -> DataFrame:
    """Long matrix (col_x, col_y, r) over pairwise-complete rows."""
    if len(cols) < 2:
        raise ValueError("Please select at least 2 columns.")
    return _pearson_pairs(df, cols, digits)


def spearman(df: DataFrame, cols: list[str], digits: int | None = 4, order_key: str | None = None) -> DataFrame:
    """Pearson of average ranks.

    Columns without NULLs are ranked once each. Where a column has NULLs, ranks are
    taken within the pairwise-complete rows (as pandas does): the cells (pair, x, y,
    count) of all pairs are stacked and ranked in one plan, keyed by the pair.
    """
    if len(cols) < 2:
        raise ValueError("Please select at least 2 columns.")
    nulls = df.agg(*[F.count_if(quoted(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    if not any(nulls):
        ranked = df.select(*[quoted(c).alias(f"v{i}") for i, c in enumerate(cols)])
        for i in range(len(cols)):
            ranked = scan.average_rank(ranked, f"v{i}", f"r{i}")
        return _pearson_pairs(ranked.select(*[F.col(f"r{i}").alias(c) for i, c in enumerate(cols)]), cols, digits)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    both = [F.when(quoted(a).isNotNull() & quoted(b).isNotNull(), F.struct(F.lit(i).alias("pair"), quoted(a).cast("double").alias("x"), quoted(b).cast("double").alias("y")))
            for i, (a, b) in enumerate(pairs)]
    cells = df.select(F.explode(F.filter(F.array(*both), lambda s: s.isNotNull())).alias("s")).select("s.*")
    cells = materialize(cells.groupBy("pair", "x", "y").agg(F.count("*").alias("c")), "rank-cells")

    def ranks(side: str) -> DataFrame:
        h = cells.groupBy("pair", side).agg(F.sum("c").alias("n"))
        h = scan.prefix_sums(h, [side], ["n"], ["pair"])
        return h.select("pair", side, (F.col("n_cum") - F.col("n") + (F.col("n") + 1) / 2.0).alias(f"r{side}"))

    j = cells.join(ranks("x"), ["pair", "x"]).join(ranks("y"), ["pair", "y"])
    c, x, y = F.col("c"), F.col("rx"), F.col("ry")
    sums = j.groupBy("pair").agg(F.sum("c").alias("n"), F.sum(c * x * y).alias("xy"), F.sum(c * x * x).alias("xx"), F.sum(c * y * y).alias("yy"))
    square = F.col("n") * F.pow((F.col("n") + 1) / 2.0, 2)  # n times the squared mean rank
    r = F.try_divide(F.col("xy") - square, F.sqrt((F.col("xx") - square) * (F.col("yy") - square)))
    # pairs without rows, and of one value, have no coefficient
    every = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, a string, b string")
    out = every.join(sums.select("pair", (rnd(r, digits) if digits is not None else r).alias("r")), "pair", "left")
    return out.select(F.col("a").alias("col_x"), F.col("b").alias("col_y"), "r").unionByName(
        out.filter("a <> b").select(F.col("b").alias("col_x"), F.col("a").alias("col_y"), "r"))


def kendall_pair(df: DataFrame, x: str, y: str, distinct_y: int | None = None) -> DataFrame:
    """tau-b of one pair (one row: tau, n)."""
    d = df.select(quoted(x).alias("x"), quoted(y).alias("y")).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    if distinct_y is None:
        distinct_y = d.select("y").distinct().count()
    cells = d.groupBy("x", "y").agg(F.count(F.lit(1)).alias("c"))
    codes = scan.dense_codes(cells.select("y"), "y", "r")
    m = max(distinct_y - 1, 0)
    bits = max(1, math.ceil(math.log2(m + 1)))
    cr = cells.join(codes, "y")
    # one row per (bit level, higher-bit group, x): counts of rows with bit 1 / bit 0
    lv = cr.select("x", "c", "r", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("lvl"))
    bit = F.expr("shiftright(r, lvl) & 1")
    lv = lv.select("lvl", F.expr("shiftright(r, lvl + 1)").alias("g"), "x",
                   F.when(bit == 1, F.col("c")).otherwise(0).alias("ones"),
                   F.when(bit == 0, F.col("c")).otherwise(0).alias("zeros"))
    g = lv.groupBy("lvl", "g", "x").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    nb = scan.choose_buckets(g)
    g = scan.prefix_sums(g, ["x"], ["ones"], partition_cols=["lvl", "g"], inclusive=False, suffix="_before",
                         n_buckets=nb)
    disc = g.agg(F.coalesce(F.sum(F.col("zeros") * F.col("ones_before")), F.lit(0)).alias("d"))
    ties = cells.agg(
        F.sum("c").alias("n"),
        F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("n3"))
    tx = cells.groupBy("x").agg(F.sum("c").alias("t")).agg(F.sum(F.col("t") * (F.col("t") - 1) / 2).alias("n1"))
    ty = cells.groupBy("y").agg(F.sum("c").alias("u")).agg(F.sum(F.col("u") * (F.col("u") - 1) / 2).alias("n2"))
    # four single-row aggregates stacked as (name, value) rows and pivoted to one row
    kv = (disc.select(F.lit("d").alias("k"), F.col("d").cast("double").alias("v"))
          .unionByName(ties.select(F.lit("n").alias("k"), F.col("n").cast("double").alias("v")))
          .unionByName(ties.select(F.lit("n3").alias("k"), F.col("n3").cast("double").alias("v")))
          .unionByName(tx.select(F.lit("n1").alias("k"), F.col("n1").cast("double").alias("v")))
          .unionByName(ty.select(F.lit("n2").alias("k"), F.col("n2").cast("double").alias("v"))))
    j = kv.agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(k) for k in ("d", "n", "n1", "n2", "n3")])
    n0 = F.col("n") * (F.col("n") - 1) / 2
    num = (n0 - F.col("n1") - F.col("n2") + F.col("n3")) - 2 * F.col("d")
    tau = F.try_divide(num, F.sqrt((n0 - F.col("n1")) * (n0 - F.col("n2"))))
    return j.select(tau.alias("tau"), F.col("n").cast("long").alias("n"))


def _inversions(first: np.ndarray, second: np.ndarray) -> int:
    """Pairs of rows with a lesser ``first`` and a greater ``second``, by the bits of the second's
    codes: in the order of the first, ones that come before zeros of the same higher bits."""
    if len(first) < 2:
        return 0
    codes = np.unique(second, return_inverse=True)[1].reshape(-1)
    codes = codes[np.lexsort((codes, first))]  # rows of one first by rising second: never an inversion
    found = 0
    for level in range(int(codes.max()).bit_length() - 1, -1, -1):
        group, one = codes >> (level + 1), (codes >> level) & 1
        ones = np.cumsum(one) - one
        starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        before = ones - np.repeat(ones[starts], np.diff(np.r_[starts, len(codes)]))
        found += int(before[one == 0].sum())
        codes = codes[np.argsort(codes >> level, kind="stable")]
    return found


def _ties(*columns: np.ndarray) -> int:
    """Pairs of rows that are equal in every column."""
    code = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        values, of = np.unique(c, return_inverse=True)
        code = np.unique(code * len(values) + of.reshape(-1), return_inverse=True)[1].reshape(-1)
    t = np.bincount(code)
    return int((t * (t - 1) // 2).sum())


def _bucketed(df: DataFrame, cols: list[str], n: int, bucket_rows: int) -> DataFrame:
    """The columns as doubles v0.. with buckets b0.. in value order, in the shared folder. Splitters are
    quantiles; a value that is one has an odd bucket of its own, so an even one, of what lies between
    two, holds few rows however often a value is repeated."""
    wide = df.select(*[quoted(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    parts = -(-n // bucket_rows)
    splits = [np.array([])] * len(cols)
    if parts > 1:
        found = wide.agg(*[F.percentile_approx(v, [k / parts for k in range(1, parts)], 20 * max(parts, 500)).alias(v) for v in wide.columns]).first()
        splits = [np.unique(np.array(q or [], dtype=float)) for q in found]

    def buckets(batches):
        for batch in batches:
            sides = []
            for v, s in zip(batch.columns, splits, strict=True):
                x = v.fill_null(0.0).to_numpy(zero_copy_only=False)
                place = np.searchsorted(s, x, "left") + np.searchsorted(s, x, "right")
                sides.append(pa.array(place.astype(np.int32), mask=np.asarray(v.is_null())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *sides], names=[*batch.schema.names, *[f"b{i}" for i in range(len(sides))]])

    schema = ", ".join([f"{v} double" for v in wide.columns] + [f"b{i} int" for i in range(len(cols))])
    return materialize(wide.mapInArrow(buckets, schema), "tau-rows")


def _bucket_sums(rows: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(pair, d, n1, n2, n3) of every even bucket: for pairs whose x it parts, the discordant and the tied
    pairs of its rows; for those whose y it parts, the discordant ones of different x buckets and the ties in y."""
    used = sorted({c for p in pairs for c in p})
    home = [F.when(F.col(f"b{c}") % 2 == 0, F.struct(F.lit(c).alias("c"), F.col(f"b{c}").alias("b"))) for c in used]
    dealt = rows.withColumn("_home", F.explode(F.array(*home))).filter("_home IS NOT NULL").select("_home.c", "_home.b", *rows.columns)

    def sums(table):
        c, out = table["c"][0].as_py(), []
        known = [np.asarray(table[f"v{i}"].is_valid()) for i in range(len(used))]
        of = lambda name, keep: table[name].to_numpy()[keep]
        for pid, (x, y) in enumerate(pairs):
            if c not in (x, y):
                continue
            keep = known[x] & known[y]
            v, w = of(f"v{x}", keep), of(f"v{y}", keep)
            if not len(v):
                continue
            if c == x:
                out.append((pid, _inversions(v, w), _ties(v), 0, _ties(v, w)))
            else:
                out.append((pid, _inversions(of(f"b{x}", keep), w), 0, _ties(w), 0))
        return pa.table([pa.array(a, t) for a, t in zip(zip(*out, strict=True) if out else [[]] * 5, [pa.int32()] + [pa.int64()] * 4, strict=True)],
                        names=["pair", "d", "n1", "n2", "n3"])

    return dealt.groupBy("c", "b").applyInArrow(sums, "pair int, d long, n1 long, n2 long, n3 long")


def _grid_inversions(grid: DataFrame) -> DataFrame:
    """(pair, d): pairs of rows in cells (pair, bx, by, c) of lesser bx and greater by, by the bits of by."""
    bits = grid.groupBy("pair").agg(F.greatest(F.lit(1), F.ceil(F.log2(F.max("by") + 1))).cast("int").alias("_bits"))
    lv = grid.join(F.broadcast(bits), "pair").select("*", F.explode(F.sequence(F.lit(0), F.col("_bits") - 1)).alias("lvl"))
    bit = F.expr("shiftright(by, lvl) & 1")
    g = lv.groupBy("pair", "lvl", F.expr("shiftright(by, lvl + 1)").alias("g"), "bx").agg(
        F.sum(F.when(bit == 1, F.col("c")).otherwise(0)).alias("ones"), F.sum(F.when(bit == 0, F.col("c")).otherwise(0)).alias("zeros"))
    g = scan.prefix_sums(materialize(g, "tau-levels"), ["bx"], ["ones"], partition_cols=["pair", "lvl", "g"], inclusive=False, suffix="_before")
    return g.groupBy("pair").agg(F.sum((F.col("zeros") * F.col("ones_before")).cast("decimal(38,0)")).alias("d"))


def kendall(df: DataFrame, cols: list[str], digits: int | None = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Long tau-b matrix (col_x, col_y, r) over pairwise-complete rows.

    Each column's values are parted into buckets of about ``bucket_rows`` rows. A
    discordant pair of rows lies in one x bucket, or in two x buckets and one y bucket,
    or in two of either: the first two are counted inside the buckets, the last over
    the grid of bucket counts. tau-b is symmetric: of each pair the column of fewer
    values is y. A column has tau 1 with itself (none if constant).
    """
    if len(cols) < 2:
        raise ValueError("Please select at least 2 columns.")
    shape = df.agg(F.count("*").alias("n"), *[f.alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (
        ("n", F.approx_count_distinct(quoted(c))), ("a", F.min(quoted(c).cast("double"))), ("b", F.max(quoted(c).cast("double"))))]).first()
    own = [(c, c, 1.0 if shape[f"a{i}"] is not None and shape[f"a{i}"] < shape[f"b{i}"] else None) for i, c in enumerate(cols)]
    width = [shape[f"n{i}"] for i in range(len(cols))]
    pairs = [(i, j) if width[j] <= width[i] else (j, i) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    ship_package(df.sparkSession)
    rows = _bucketed(df, cols, shape["n"], bucket_rows)
    known = lambda x, y: F.col(f"v{x}").isNotNull() & F.col(f"v{y}").isNotNull()
    dealt = lambda cells: rows.select(F.explode(F.array(*cells)).alias("s")).filter("s IS NOT NULL").select("s.*")
    cells = dealt([F.when(known(x, y), F.struct(F.lit(p).alias("pair"), F.col(f"b{x}").alias("bx"), F.col(f"b{y}").alias("by"))) for p, (x, y) in enumerate(pairs)])
    grid = materialize(cells.groupBy("pair", "bx", "by").agg(F.count("*").alias("c")), "tau-grid")
    tied = lambda c: F.sum((c.cast("decimal(19,0)") * (c - 1).cast("decimal(19,0)") / 2).cast("decimal(38,0)"))
    none = F.lit(0).cast("decimal(38,0)")

    def part(sums: DataFrame, **given: str) -> DataFrame:
        """Rows (pair, d, n1, n2, n3) with the sums that a part gives."""
        return sums.select("pair", *[(F.col(given[k]).cast("decimal(38,0)") if k in given else none).alias(k) for k in ("d", "n1", "n2", "n3")])

    # an odd bucket is one value: its rows are tied in that column
    one = lambda by, k: (grid.filter(F.col(by) % 2 == 1).groupBy("pair", by).agg(F.sum("c").alias("c"))
                         .groupBy("pair").agg(tied(F.col("c")).alias(k)))
    both = grid.filter("bx % 2 = 1 AND by % 2 = 1").groupBy("pair").agg(tied(F.col("c")).alias("n3"))
    half = dealt([F.when((F.col(f"b{x}") % 2 == 1) & (F.col(f"b{y}") % 2 == 0), F.struct(F.lit(p).alias("pair"), F.col(f"b{x}").alias("bx"), F.col(f"v{y}").alias("y")))
                  for p, (x, y) in enumerate(pairs)])
    same = half.groupBy("pair", "bx", "y").agg(F.count("*").alias("c")).groupBy("pair").agg(tied(F.col("c")).alias("n3"))
    sums = part(_bucket_sums(rows, pairs), d="d", n1="n1", n2="n2", n3="n3")
    for more in (part(_grid_inversions(grid), d="d"), part(one("bx", "n1"), n1="n1"), part(one("by", "n2"), n2="n2"), part(both, n3="n3"), part(same, n3="n3")):
        sums = sums.unionByName(more)
    sums = sums.groupBy("pair").agg(*[F.sum(k).cast("double").alias(k) for k in ("d", "n1", "n2", "n3")])
    j = grid.groupBy("pair").agg(F.sum("c").cast("double").alias("n")).join(sums, "pair")  # one row per pair each
    n0 = F.col("n") * (F.col("n") - 1) / 2
    num = (n0 - F.col("n1") - F.col("n2") + F.col("n3")) - 2 * F.col("d")
    tau = F.try_divide(num, F.sqrt((n0 - F.col("n1")) * (n0 - F.col("n2"))))
    if digits is not None:
        tau = rnd(tau, digits)
    names = F.array(*[F.struct(F.lit(p).alias("pair"), F.lit(cols[x]).alias("a"), F.lit(cols[y]).alias("b")) for p, (x, y) in enumerate(pairs)])
    j = j.join(df.sparkSession.range(1).select(F.explode(names).alias("s")).select("s.*"), "pair")
    res = j.select("a", "b", tau.alias("r"))
    both_ways = res.select(F.col("a").alias("col_x"), F.col("b").alias("col_y"), "r").unionByName(
        res.select(F.col("b").alias("col_x"), F.col("a").alias("col_y"), "r"))
    return both_ways.unionByName(df.sparkSession.createDataFrame(own, "col_x string, col_y string, r double"))


def correlate(df: DataFrame, cols: list[str], method: str = "pearson", digits: int | None = 4) -> DataFrame:
    method = method.lower()
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    return {"pearson": pearson, "spearman": spearman, "kendall": kendall}[method](df, cols, digits)


def strength_bands(corr: DataFrame) -> DataFrame:
    """Add ``band`` (very strong ... very weak, or self) and ``sign``."""
    a = F.abs(F.col("r"))
    band = F.lit(BAND_FALLBACK)
    for thr, name in reversed(BANDS):
        band = F.when(a >= thr, F.lit(name)).otherwise(band)
    band = F.when(F.col("col_x") == F.col("col_y"), F.lit("self")).when(F.col("r").isNull(), F.lit(None)).otherwise(band)
    sign = F.when(F.col("r") > 0, "positive").when(F.col("r") < 0, "negative").otherwise("none")
    return corr.withColumn("band", band).withColumn("sign", sign)
