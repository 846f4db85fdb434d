"""Ordered-scan primitives that never pull all rows into one task.

pandas code relies on an implicit row order for running sums, forward/backward
fill and ranks. A global Spark window without ``partitionBy`` would move every
row through a single task, so these primitives use a two-level scan instead:

1. range-bucket the whole order key with splitters from a bounded row sample (the
   driver gets one key per bucket), so that many rows of one leading value, or of
   one day, are parted by the columns behind it. There are as many buckets as
   ``spark.sql.shuffle.partitions``, whatever the size of the input;
2. aggregate per segment = (partition keys, bucket) — small;
3. carry totals / last values across segments with a window over that small
   table (partitioned by the keys, so a hot key only contributes one row per
   bucket);
4. finish with a window partitioned by the segment, adding the carried value.

A key holding a third of all rows is therefore split over every bucket.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import named, quoted
from ..session import materialize

BUCKET_COL = "_sp_bucket"
SAMPLE_PER_BUCKET = 40
# size of the KLL sketches, thrice the rank error to expect of it, and tables of sketches that merge first
SKETCH_K, SKETCH_ERROR, SKETCH_GROUPS = 4000, 0.004, 256


def _splitters(df: DataFrame, cols: list[str], nb: int) -> list[tuple]:
    """At most ``nb - 1`` keys (tuples of the columns' values, some texts cut) that part
    the rows of ``df`` about evenly in the order of all ``cols``, nulls first.

    They are every ``SAMPLE_PER_BUCKET``-th of a row sample, sorted by Spark; the
    driver gets one key per bucket. A text or binary value is cut behind the first
    character that differs from the sampled row before, unless the two are equal:
    any value may part the rows, short ones do as well.
    """
    keys = [f"_k{i}" for i in range(len(cols))]
    named = df.select(*[quoted(c).alias(k) for c, k in zip(cols, keys, strict=True)])
    sample = named.orderBy(F.rand(7)).limit(SAMPLE_PER_BUCKET * nb)
    order = Window.orderBy(*[quoted(k).asc_nulls_first() for k in keys])  # over the bounded sample
    ranked = sample.withColumn("_r", F.row_number().over(order)).withColumn("_m", F.count("*").over(Window.partitionBy()))
    step = F.greatest(F.lit(1), F.floor(F.col("_m") / nb))
    shown = []
    for k in keys:
        value = quoted(k)
        if isinstance(named.schema[k].dataType, (T.StringType, T.BinaryType)):
            text = value.cast("string") if isinstance(named.schema[k].dataType, T.StringType) else F.hex(value)
            before = F.lag(text).over(order)
            last = F.coalesce(F.least(F.length(text), F.length(before)), F.lit(0))
            letters = lambda t: F.transform(F.sequence(F.lit(1), last), lambda i: F.substring(t, i, F.lit(1)))
            same = F.when(last > 0, F.array_position(F.zip_with(letters(text), letters(before), lambda x, y: x == y), False)).otherwise(1)
            first = F.when(text == before, F.length(text)).when(same == 0, last + 1).otherwise(same)
            # a position inside the value, in whole bytes for binary ones
            cut = F.when(before.isNull(), F.lit(1)).otherwise(first)
            value = F.substring(value, F.lit(1), cut) if isinstance(named.schema[k].dataType, T.StringType) else F.substring(value, F.lit(1), F.ceil(cut / 2).cast("int"))
        elif isinstance(named.schema[k].dataType, T.TimestampType):
            value = F.unix_micros(value)
        elif isinstance(named.schema[k].dataType, T.TimestampNTZType):
            value = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), value)
        elif isinstance(named.schema[k].dataType, T.DateType):
            value = F.unix_date(value)
        shown.append(value.alias(f"_v{len(shown)}"))
    rows = ranked.select("_r", step.alias("_s"), *shown).filter((F.col("_r") > 1) & ((F.col("_r") - 1) % F.col("_s") == 0)).orderBy("_r").collect()
    out: list[tuple] = []
    for r in rows:
        key = tuple(r)[2:]
        if not out or not all(map(_same, key, out[-1])):
            out.append(key)
    return out


def _same(a, b) -> bool:
    return a == b or (a != a and b != b)  # NaN is one value, as for Spark


def _comparable(df: DataFrame, col: str) -> Column:
    """The column as its splitters are given: dates and times as numbers."""
    dt, c = df.schema[col].dataType, quoted(col)
    if isinstance(dt, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)
    return F.unix_micros(c) if isinstance(dt, T.TimestampType) else F.unix_date(c) if isinstance(dt, T.DateType) else c


def _literal(value, dt: T.DataType) -> Column:
    """``value`` as a literal of its column's type, also of nested types."""
    if value is None:
        return F.lit(None).cast(dt)
    if isinstance(dt, T.ArrayType):
        return F.array(*[_literal(v, dt.elementType) for v in value]).cast(dt)
    if isinstance(dt, T.StructType):
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, dt.fields, strict=True)])
    return F.lit(value) if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)) else F.lit(bytes(value) if isinstance(dt, T.BinaryType) else value).cast(dt)


def _tree(df: DataFrame, cols: list[str], splits: list[tuple]) -> Column:
    """How many of the sorted ``splits`` are not above the row's key: a search tree of
    comparisons with the first column's values; within one value, of the next column's."""
    groups: list[tuple] = []  # (value, its places among the splits); null comes first
    for i, key in enumerate(splits):
        if groups and _same(groups[-1][0], key[0]):
            groups[-1][1].append(i)
        else:
            groups.append((key[0], [i]))
    c, dt = _comparable(df, cols[0]), df.schema[cols[0]].dataType

    def inside(at: list[int]) -> Column:
        """The count for rows whose first column is the value at these places."""
        if len(cols) == 1:
            return F.lit(at[-1] + 1)
        return F.lit(at[0]) + _tree(df, cols[1:], [splits[i][1:] for i in at])

    nulls = groups[0][1] if groups[0][0] is None else []
    known = groups[1:] if nulls else groups

    def search(lo: int, hi: int) -> Column:
        """For rows known to lie above known[lo - 1] and below known[hi]."""
        if lo == hi:
            return F.lit(known[lo - 1][1][-1] + 1 if lo else len(nulls))
        mid = (lo + hi) // 2
        v = _literal(known[mid][0], dt)
        return F.when(c < v, search(lo, mid)).when(c == v, inside(known[mid][1])).otherwise(search(mid + 1, hi))

    return F.when(c.isNull(), inside(nulls) if nulls else F.lit(0)).otherwise(search(0, len(known)))


def choose_buckets(df: DataFrame, n_buckets: int | None = None) -> int:
    """Number of order buckets: the caller's, else ``spark.sql.shuffle.partitions``."""
    if n_buckets is not None:
        return max(1, int(n_buckets))
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def add_order_bucket(df: DataFrame, order_cols: list[str], descending: bool = False,
                     n_buckets: int | None = None) -> DataFrame:
    """Add ``BUCKET_COL``: a range bucket of the whole order key.

    Buckets are monotone in the order of all ``order_cols`` (reversed when
    ``descending``); NULL comes first in an ascending order and last in a
    descending one (Spark's default). Rows of one leading value are parted by the
    columns behind it; only rows equal in all of them always share a bucket. Any
    orderable type will do.
    """
    nb = choose_buckets(df, n_buckets)
    splits = _splitters(df, order_cols, nb) if nb > 1 else []
    if not splits:
        return df.withColumn(BUCKET_COL, F.lit(0))
    bucket = _tree(df, order_cols, splits)
    return df.withColumn(BUCKET_COL, (-bucket if descending else bucket).cast("int"))


def _order_exprs(order_cols: list[str], descending: bool) -> list[Column]:
    if descending:
        return [quoted(c).desc_nulls_last() for c in order_cols]
    return [quoted(c).asc_nulls_first() for c in order_cols]


def prefix_sums(df: DataFrame, order_cols: list[str], sum_cols: list[str],
                partition_cols: list[str] | None = None, descending: bool = False,
                inclusive: bool = True, suffix: str = "_cum",
                n_buckets: int | None = None) -> DataFrame:
    """Running sums of ``sum_cols`` in ``order_cols`` order (optionally per key).

    ``order_cols`` must be unique within a key for a deterministic result.
    Adds ``<col><suffix>`` columns.
    """
    keys = list(partition_cols or [])
    nb = choose_buckets(df, n_buckets)
    frame_end = 0 if inclusive else -1
    if nb <= 1:
        # one bucket was asked for: a plain window
        w1 = Window.partitionBy(*named(keys)).orderBy(*_order_exprs(order_cols, descending)) \
            .rowsBetween(Window.unboundedPreceding, frame_end)
        out = df
        for c in sum_cols:
            out = out.withColumn(f"{c}{suffix}", F.coalesce(F.sum(quoted(c)).over(w1), F.lit(0)))
        return out
    b = add_order_bucket(df, order_cols, descending, nb)
    seg = keys + [BUCKET_COL]
    tot = b.groupBy(*named(seg)).agg(*[F.sum(quoted(c)).alias(f"_t_{c}") for c in sum_cols])
    w_prev = Window.partitionBy(*named(keys)).orderBy(BUCKET_COL).rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*named(seg), *[F.coalesce(F.sum(f"_t_{c}").over(w_prev), F.lit(0)).alias(f"_o_{c}")
                             for c in sum_cols])
    if not keys:
        off = F.broadcast(off)  # one row per bucket
    j = b.join(off, on=seg, how="left")
    w_in = Window.partitionBy(*named(seg)).orderBy(*_order_exprs(order_cols, descending)) \
        .rowsBetween(Window.unboundedPreceding, frame_end)
    for c in sum_cols:
        j = j.withColumn(f"{c}{suffix}", F.coalesce(F.sum(quoted(c)).over(w_in), F.lit(0)) + quoted(f"_o_{c}"))
    return j.drop(*[f"_o_{c}" for c in sum_cols], BUCKET_COL)


def carry_fill(df: DataFrame, value_col: str, order_cols: list[str],
               partition_cols: list[str] | None = None, direction: str = "forward",
               out_col: str | None = None, n_buckets: int | None = None) -> DataFrame:
    """Forward fill (last non-null before) or backward fill (next non-null after).

    Leading (forward) / trailing (backward) nulls stay null, as in pandas.
    """
    keys = list(partition_cols or [])
    out_col = out_col or value_col
    fwd = direction == "forward"
    v = quoted(value_col)
    nb = choose_buckets(df, n_buckets)
    if nb <= 1:
        w1 = Window.partitionBy(*named(keys)).orderBy(*_order_exprs(order_cols, not fwd)) \
            .rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out_col, F.last(v, ignorenulls=True).over(w1))
    b = add_order_bucket(df, order_cols, descending=not fwd, n_buckets=nb)
    seg = keys + [BUCKET_COL]
    ordv = F.struct(*[quoted(c) for c in order_cols])
    pick = F.when(v.isNotNull(), ordv)
    agg = F.max_by(v, pick) if fwd else F.min_by(v, pick)
    segs = b.groupBy(*named(seg)).agg(agg.alias("_seg_v"))
    w_prev = Window.partitionBy(*named(keys)).orderBy(BUCKET_COL if fwd else quoted(BUCKET_COL)) \
        .rowsBetween(Window.unboundedPreceding, -1)
    carried = segs.select(*named(seg), F.last("_seg_v", ignorenulls=True).over(w_prev).alias("_carry"))
    if not keys:
        carried = F.broadcast(carried)
    j = b.join(carried, on=seg, how="left")
    w_in = Window.partitionBy(*named(seg)).orderBy(*_order_exprs(order_cols, not fwd)) \
        .rowsBetween(Window.unboundedPreceding, 0)
    filled = F.coalesce(F.last(v, ignorenulls=True).over(w_in), F.col("_carry"))
    return j.withColumn(out_col, filled).drop("_carry", BUCKET_COL)


def value_histogram(df: DataFrame, col: str, partition_cols: list[str] | None = None,
                    count_col: str = "n") -> DataFrame:
    """(keys, value, n) for non-null values: ranks, ROC, PR and lift work on this."""
    keys = list(partition_cols or [])
    return df.filter(quoted(col).isNotNull()).groupBy(*named([*keys, col])).agg(F.count(F.lit(1)).alias(count_col))


def average_rank(df: DataFrame, col: str, out_col: str = "rank",
                 partition_cols: list[str] | None = None, n_buckets: int | None = None) -> DataFrame:
    """Attach the 1-based average rank of ``col`` (ties share the mean rank).

    Ranks come from the value histogram plus a two-level running count, so no
    global sort of raw rows is needed. NULL values get a NULL rank.
    """
    keys = list(partition_cols or [])
    h = value_histogram(df, col, keys, "_n")
    h = prefix_sums(h, [col], ["_n"], keys, n_buckets=n_buckets)
    h = h.select(*named([*keys, col]), (F.col("_n_cum") - F.col("_n") + (F.col("_n") + 1) / 2.0).alias(out_col))
    return df.join(h, on=keys + [col], how="left")


def dense_codes(df: DataFrame, col: str, out_col: str = "code", n_buckets: int | None = None) -> DataFrame:
    """(value, code): 0-based position of every distinct non-null value in sort order."""
    d = df.select(quoted(col)).filter(quoted(col).isNotNull()).distinct().withColumn("_one", F.lit(1))
    d = prefix_sums(d, [col], ["_one"], n_buckets=n_buckets)
    return d.select(quoted(col), (F.col("_one_cum") - 1).cast("long").alias(out_col))


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], n_buckets: int | None = None) -> DataFrame:
    """(name, p, value): exact linearly interpolated quantiles of several columns (``quantile_values``
    as a table; columns without a value have no rows). Results don't depend on ``n_buckets``."""
    found = quantile_values(df, cols, probs)
    rows = [(c, float(p), v) for c in cols for p, v in zip(probs, found[c] or [], strict=False)]
    return df.sparkSession.createDataFrame(rows, "name string, p double, value double")


def quantiles_from_hist(hist: DataFrame, probs: list[float], n_buckets: int = 1) -> DataFrame:
    """(name, p, value) from a value histogram (name, v, c) — the refine step.

    The per-(column, bucket) totals locate the bucket holding each target rank;
    only those buckets are sorted (all of them when ``n_buckets`` is 1).
    """
    if n_buckets > 1:  # read for the splitters and for the result
        hist = materialize(hist, "histogram")
    b = add_order_bucket(hist, ["v"], n_buckets=n_buckets) if n_buckets > 1 else hist.withColumn(BUCKET_COL, F.lit(0))
    seg = b.groupBy("name", BUCKET_COL).agg(F.sum("c").alias("t"))
    w_prev = Window.partitionBy("name").orderBy(BUCKET_COL).rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.select("name", BUCKET_COL, "t", F.coalesce(F.sum("t").over(w_prev), F.lit(0)).alias("off"),
                     F.sum("t").over(Window.partitionBy("name")).alias("n"))
    tg = seg.select("name", "n").distinct().select(
        "name", "n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
    tg = tg.withColumn("h", (F.col("n") - 1) * F.col("p")).withColumn("lo", F.floor("h")).withColumn("hi", F.ceil("h"))
    # (target, bucket) pairs whose rank range holds rank lo or rank hi: at most 2 per target
    holds = lambda r: (F.col("off") <= quoted(r)) & (quoted(r) < F.col("off") + F.col("t"))
    need = seg.join(tg, "name").filter(holds("lo") | holds("hi")) \
        .select("name", BUCKET_COL, "off", "p", "h", "lo", "hi")
    keys = need.select("name", BUCKET_COL, "off").distinct()  # <= 2 x probs rows per column
    rows = b.join(F.broadcast(keys), ["name", BUCKET_COL])
    w_in = Window.partitionBy("name", BUCKET_COL).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("last", F.col("off") + F.sum("c").over(w_in)).withColumn("first", F.col("last") - F.col("c"))
    pick = rows.join(F.broadcast(need.select("name", BUCKET_COL, "p", "h", "lo", "hi")), ["name", BUCKET_COL])
    inside = lambda r: (F.col("first") <= quoted(r)) & (quoted(r) < F.col("last"))
    g = pick.groupBy("name", "p").agg(F.max("h").alias("h"), F.max("lo").alias("lo"),
                                      F.max(F.when(inside("lo"), F.col("v"))).alias("v_lo"),
                                      F.max(F.when(inside("hi"), F.col("v"))).alias("v_hi"))
    return g.select("name", "p", (F.col("v_lo") + (F.col("h") - F.col("lo")) * (F.col("v_hi") - F.col("v_lo"))).alias("value"))


def quantile_values(df: DataFrame, cols: list[str], probs: list[float]) -> dict:
    """{col: [q(p) for p in probs]} (None for a column without values): exact quantiles.

    Same definition as ``percentile`` / pandas ``quantile``: with n values sorted
    ascending, h = (n - 1) p and the value is v[floor h] + (h - floor h) (v[ceil h] - v[floor h]).
    NULL and NaN are no values.

    Selection by brackets: one aggregate of all columns gives n and, from KLL sketches merged in
    two levels, an interval around each quantile that should hold both ranks but few rows; a
    second one counts the rows below the intervals; only values inside them (below one in a
    hundred) are shuffled, counted and ranked. An interval that misses its ranks is widened
    and looked at again. The driver sees a few numbers per column and quantile.
    """
    xs = [f"x{i}" for i in range(len(cols))]
    clean = df.select(*[F.nanvl(quoted(c).cast("double"), F.lit(None).cast("double")).alias(x) for c, x in zip(cols, xs, strict=True)])
    ps = [float(p) for p in probs]
    out: dict = dict.fromkeys(cols)
    if not ps or not cols:
        return out
    todo, width = [(i, j) for i in range(len(cols)) for j in range(len(ps))], SKETCH_ERROR
    found: dict[tuple[int, int], float] = {}
    while todo:
        asked = {i: [j for k, j in todo if k == i] for i in sorted({i for i, _ in todo})}
        ends = {i: [e for j in js for e in (max(0.0, ps[j] - width), min(1.0, ps[j] + width))] for i, js in asked.items()}
        parts = clean.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("part")).agg(
            *[f.alias(f"{n}{i}") for i in asked for n, f in (("n", F.count(xs[i])), ("a", F.min(xs[i])), ("b", F.max(xs[i])), ("s", F.kll_sketch_agg_double(xs[i], SKETCH_K)))])
        row = parts.agg(*[f.alias(f"{n}{i}") for i in asked for n, f in (("n", F.sum(f"n{i}")), ("a", F.min(f"a{i}")), ("b", F.max(f"b{i}")), ("s", F.kll_merge_agg_double(f"s{i}")))]).select(
            *[F.col(f"{n}{i}") for i in asked for n in ("n", "a", "b")],
            *[F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"s{i}", F.array(*map(F.lit, ends[i])))).alias(f"e{i}") for i in asked]).first()
        spans = []  # (i, j, low, high, first rank, second rank)
        for i, js in asked.items():
            n = row[f"n{i}"] or 0
            for m, j in enumerate(js if n else []):
                h = (n - 1) * ps[j]
                low = row[f"a{i}"] if ps[j] <= width else row[f"e{i}"][2 * m]
                high = row[f"b{i}"] if ps[j] >= 1 - width else row[f"e{i}"][2 * m + 1]
                spans.append((i, j, low, high, math.floor(h), math.ceil(h)))
        if not spans:
            break
        parts_of = lambda x, low, high: {"under": x < low, "low": x == low, "inside": (x > low) & (x < high), "high": (x == high) & F.lit(low < high)}
        tests = [parts_of(quoted(xs[i]), low, high) for i, _, low, high, *_ in spans]
        counts = clean.agg(*[F.count_if(test).alias(f"{name}{s}") for s, of in enumerate(tests) for name, test in of.items()]).first()
        picked: dict[tuple[int, int], float] = {}
        within: list[tuple[int, int, int]] = []  # (span, 0 or 1, rank among the values strictly inside)
        for s, (_, _, low, high, *ranks) in enumerate(spans):
            for k, rank in enumerate(ranks):
                at = rank - counts[f"under{s}"]
                if 0 <= at < counts[f"low{s}"]:
                    picked[s, k] = low
                elif 0 <= (at := at - counts[f"low{s}"]) < counts[f"inside{s}"]:
                    within.append((s, k, at))
                elif 0 <= (at := at - counts[f"inside{s}"]) < counts[f"high{s}"]:
                    picked[s, k] = high
        if within:  # the ends are counted already, however many rows share them
            asked_of = sorted({s for s, *_ in within})
            inside = [F.when(tests[s]["inside"], F.struct(F.lit(s).alias("s"), (quoted(xs[spans[s][0]]) + F.lit(0.0)).alias("v"))) for s in asked_of]
            rows = clean.filter(functools.reduce(operator.or_, [tests[s]["inside"] for s in asked_of])).select(F.explode(F.array(*inside)).alias("s")).filter("s IS NOT NULL")
            upto = Window.partitionBy("s").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
            held = rows.select("s.*").groupBy("s", "v").agg(F.count("*").alias("c")).withColumn("last", F.sum("c").over(upto)).withColumn("first", F.col("last") - F.col("c"))
            wanted = df.sparkSession.createDataFrame(within, "s int, k int, rank long")
            for r in held.join(F.broadcast(wanted), "s").filter("first <= rank AND rank < last").select("s", "k", "v").collect():  # two rows a span at most
                picked[r["s"], r["k"]] = r["v"]
        missed = []
        for s, (i, j, *_) in enumerate(spans):
            if (s, 0) in picked and (s, 1) in picked:
                lo, hi = picked[s, 0], picked[s, 1]
                h = (row[f"n{i}"] - 1) * ps[j]
                found[i, j] = lo if lo == hi else lo + (h - math.floor(h)) * (hi - lo)
            else:
                missed.append((i, j))
        todo, width = missed, width * 64
    for i, c in enumerate(cols):
        if (i, 0) in found:
            out[c] = [found[i, j] for j in range(len(ps))]
    return out
