"""Group-by (G1-G8, J1, A5) and correlation (G20-G23) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import rnd
from ..operators import correlate as R
from ..operators import groupby as G
from .registry import query
from .tables import t

ORD = ["o_orderdate", "o_orderkey"]


def _orders(spark, sf):
    return t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice",
                                         "o_orderstatus", "o_orderpriority")


@query("group_list", """
SELECT conv_id, string_agg(role, ', ' ORDER BY turn) AS role_list, min(turn) AS turn
FROM conversations GROUP BY conv_id""")
def q_group_list(spark, sf):
    """G1: roles of a conversation joined in turn order, other columns carried."""
    c = t(spark, sf, "conversations").select("conv_id", "turn", "role")
    return G.group_aggregate(c, "conv_id", "role", "list", ["turn"])


@query("group_unique_list", """
SELECT o_custkey, string_agg(o_orderpriority, ', ' ORDER BY o_orderdate, o_orderkey) AS o_orderpriority_unique_list
FROM (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey) = 1)
GROUP BY o_custkey""")
def q_group_unique_list(spark, sf):
    """Distinct priorities per customer in first-seen order."""
    o = _orders(spark, sf).select("o_custkey", "o_orderpriority", "o_orderdate", "o_orderkey")
    return G.group_aggregate(o, "o_custkey", "o_orderpriority", "unique_list", ORD, carry=False)


_CARRY = ("arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, "
          "CAST(arg_min(o_orderdate, (o_orderdate, o_orderkey)) AS VARCHAR) AS o_orderdate, "
          "arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus, "
          "arg_min(o_orderpriority, (o_orderdate, o_orderkey)) AS o_orderpriority")


def _carry_out(df, name):
    return df.select("o_custkey", name, "o_orderkey", F.col("o_orderdate").cast("string").alias("o_orderdate"),
                     "o_orderstatus", "o_orderpriority")


@query("group_count", f"SELECT o_custkey, count(o_totalprice) AS o_totalprice_count, {_CARRY} FROM orders GROUP BY o_custkey")
def q_group_count(spark, sf):
    """G3 + G8/J1: non-null count per customer, first non-null of every other column."""
    return _carry_out(G.group_aggregate(_orders(spark, sf), "o_custkey", "o_totalprice", "count", ORD),
                      "o_totalprice_count")


@query("group_sum", f"SELECT o_custkey, round(sum(o_totalprice), 2) AS o_totalprice_sum, {_CARRY} FROM orders GROUP BY o_custkey")
def q_group_sum(spark, sf):
    """Sum per customer (all-null group -> 0)."""
    out = G.group_aggregate(_orders(spark, sf), "o_custkey", "o_totalprice", "sum", ORD)
    return _carry_out(out.withColumn("o_totalprice_sum", rnd("o_totalprice_sum", 2)), "o_totalprice_sum")


@query("group_mean", f"SELECT o_custkey, round(avg(o_totalprice), 6) AS o_totalprice_mean, {_CARRY} FROM orders GROUP BY o_custkey")
def q_group_mean(spark, sf):
    """Mean per customer."""
    out = G.group_aggregate(_orders(spark, sf), "o_custkey", "o_totalprice", "mean", ORD)
    return _carry_out(out.withColumn("o_totalprice_mean", rnd("o_totalprice_mean", 6)), "o_totalprice_mean")


@query("group_first", f"""SELECT o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) FILTER (WHERE o_totalprice IS NOT NULL)
  AS o_totalprice_first, {_CARRY} FROM orders GROUP BY o_custkey""")
def q_group_first(spark, sf):
    """First non-null value in row order."""
    return _carry_out(G.group_aggregate(_orders(spark, sf), "o_custkey", "o_totalprice", "first", ORD),
                      "o_totalprice_first")


@query("group_last", f"""SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) FILTER (WHERE o_totalprice IS NOT NULL)
  AS o_totalprice_last, {_CARRY} FROM orders GROUP BY o_custkey""")
def q_group_last(spark, sf):
    """Last non-null value in row order."""
    return _carry_out(G.group_aggregate(_orders(spark, sf), "o_custkey", "o_totalprice", "last", ORD),
                      "o_totalprice_last")


@query("group_carry", """
WITH g AS (SELECT event_id, user_id, CASE WHEN event_type = 'click' THEN NULL ELSE value END AS value,
                  CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS event_type FROM events)
SELECT user_id, count(value) AS value_count,
  arg_min(event_id, event_id) FILTER (WHERE event_id IS NOT NULL) AS event_id,
  arg_min(event_type, event_id) FILTER (WHERE event_type IS NOT NULL) AS event_type
FROM g GROUP BY user_id""")
def q_group_carry(spark, sf):
    """Carried columns take the first NON-NULL value of each group."""
    e = t(spark, sf, "events")
    e = e.select("event_id", "user_id",
                 F.when(F.col("event_type") == "click", F.lit(None)).otherwise(F.col("value")).alias("value"),
                 F.when(F.col("event_type") == "view", F.lit(None)).otherwise(F.col("event_type")).alias("event_type"))
    return G.group_aggregate(e, "user_id", "value", "count", ["event_id"])


@query("group_list_numbers", """
SELECT l_orderkey, string_agg(CAST(l_quantity AS VARCHAR), ', ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS l_quantity_list
FROM lineitem GROUP BY l_orderkey""")
def q_group_list_numbers(spark, sf):
    """G1 on numbers: quantities of an order as text in line order."""
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return G.group_aggregate(li, "l_orderkey", "l_quantity", "list",
                             ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], carry=False)


@query("baskets", """
SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(p_type))), '|') AS items, count(DISTINCT p_type) AS n_items
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""")
def q_baskets(spark, sf):
    """A5: distinct part types of every order (basket building)."""
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    b = G.baskets(li.join(p, "l_partkey"), "l_orderkey", "p_type")
    return b.select("l_orderkey", F.array_join("items", "|").alias("items"), F.size("items").alias("n_items"))


# ------------------------------------------------------------------ correlation
CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pearson_sql(src, cols):
    parts = []
    for a in cols:
        for b in cols:
            parts.append(f"""SELECT '{a}' AS col_x, '{b}' AS col_y, round(covar_samp(x, y) / nullif(stddev_samp(x) * stddev_samp(y), 0), 4) AS r
  FROM (SELECT {a} AS x, {b} AS y FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""")
    return " UNION ALL ".join(parts)


@query("corr_pearson", _pearson_sql("lineitem", CORR_COLS))
def q_corr_pearson(spark, sf):
    """Pearson matrix (pairwise complete, 4 dp)."""
    return R.correlate(t(spark, sf, "lineitem"), CORR_COLS, "pearson")


@query("corr_pearson_nulls", _pearson_sql(
    "(SELECT d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)",
    ["n_chars", "quality", "toxic"]))
def q_corr_pearson_nulls(spark, sf):
    """G20 with NULLs (pairwise-complete rows)."""
    d = t(spark, sf, "documents").select("doc_id", "n_chars").join(t(spark, sf, "labels"), "doc_id", "left")
    return R.correlate(d, ["n_chars", "quality", "toxic"], "pearson")


def _rank_sql(c):
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


def _spearman_sql(src, cols):
    ranked = f"(SELECT {', '.join(_rank_sql(c) + ' AS ' + c for c in cols)} FROM {src})"
    return _pearson_sql(ranked, cols)


@query("corr_spearman", _spearman_sql("lineitem", CORR_COLS))
def q_corr_spearman(spark, sf):
    """Spearman = Pearson of average ranks."""
    return R.correlate(t(spark, sf, "lineitem"), CORR_COLS, "spearman")


def _kendall_sql(src, cols):
    """tau-b with the discordant pairs counted bit by bit of the rank of y: at each bit, rows without it
    stand behind the rows of equal higher bits that have it and a smaller x."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    cells = " UNION ALL ".join(f"SELECT {i} AS pair, '{a}' AS a, '{b}' AS b, {a}::DOUBLE AS x, {b}::DOUBLE AS y, count(*)::DOUBLE AS c FROM {src} "
                               f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY ALL" for i, (a, b) in enumerate(pairs))
    return f"""WITH cells AS ({cells}),
coded AS (SELECT *, dense_rank() OVER (PARTITION BY pair ORDER BY y) - 1 AS r FROM cells),
bits AS (SELECT pair, l, r >> (l + 1) AS g, x, sum(CASE WHEN (r >> l) & 1 = 1 THEN c ELSE 0 END) AS ones, sum(CASE WHEN (r >> l) & 1 = 0 THEN c ELSE 0 END) AS zeros
         FROM coded, range(24) t(l) GROUP BY ALL),
d AS (SELECT pair, sum(zeros * before) AS d FROM (
        SELECT pair, zeros, coalesce(sum(ones) OVER (PARTITION BY pair, l, g ORDER BY x GROUPS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM bits) GROUP BY pair),
n AS (SELECT pair, a, b, sum(c) AS n, sum(c * (c - 1) / 2) AS n3 FROM cells GROUP BY ALL),
tx AS (SELECT pair, sum(t * (t - 1) / 2) AS n1 FROM (SELECT pair, x, sum(c) AS t FROM cells GROUP BY ALL) GROUP BY pair),
ty AS (SELECT pair, sum(t * (t - 1) / 2) AS n2 FROM (SELECT pair, y, sum(c) AS t FROM cells GROUP BY ALL) GROUP BY pair),
tau AS (SELECT a, b, round((n * (n - 1) / 2 - n1 - n2 + n3 - 2 * d) / sqrt((n * (n - 1) / 2 - n1) * (n * (n - 1) / 2 - n2)), 4) AS r
        FROM n JOIN d USING (pair) JOIN tx USING (pair) JOIN ty USING (pair))
SELECT a AS col_x, b AS col_y, r FROM tau UNION ALL SELECT b, a, r FROM tau WHERE a <> b"""


@query("corr_kendall", _kendall_sql("lineitem", CORR_COLS))
def q_corr_kendall(spark, sf):
    """Kendall tau-b by inversion counting (no pair enumeration), columns of many values too."""
    return R.correlate(t(spark, sf, "lineitem"), CORR_COLS, "kendall")


@query("corr_bands", "SELECT col_x, col_y, r, CASE WHEN col_x = col_y THEN 'self' WHEN r IS NULL THEN NULL "
       "WHEN abs(r) >= 0.8 THEN 'very strong' WHEN abs(r) >= 0.6 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' "
       "WHEN abs(r) >= 0.2 THEN 'weak' ELSE 'very weak' END AS band, CASE WHEN r > 0 THEN 'positive' WHEN r < 0 "
       "THEN 'negative' ELSE 'none' END AS sign FROM (" + _pearson_sql("orders", ["o_totalprice", "o_custkey", "o_orderkey"]) + ")")
def q_corr_bands(spark, sf):
    """Strength band and sign of every coefficient."""
    return R.strength_bands(R.correlate(t(spark, sf, "orders"), ["o_totalprice", "o_custkey", "o_orderkey"], "pearson"))
