"""Projection / preview / sample / top-k queries (P1, P3, P8, P9, P11, P13-P15,
W5-W7) and the scalar-function suites (section 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import rnd
from ..functions import scalar as S
from ..operators import profile as P
from ..operators import sampling as SM
from .registry import query
from .q_profile import profile_sql
from .tables import LINEITEM_COLS, t


@query("project", "SELECT c_custkey, c_mktsegment FROM customer")
def q_project(spark, sf):
    """Column projection (ReadSchema holds two columns)."""
    return t(spark, sf, "customer").select("c_custkey", "c_mktsegment")


@query("drop_column", "SELECT c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def q_drop_column(spark, sf):
    """Drop a column."""
    return t(spark, sf, "customer").drop("c_mktsegment")


@query("preview", "SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20")
def q_preview(spark, sf):
    """First 20 rows in key order (TakeOrderedAndProject, NaN already NULL)."""
    return SM.preview(t(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], 20)


@query("page", """SELECT *, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 30""")
def q_page(spark, sf):
    """Rows [30, 40) in key order plus the total row count."""
    return SM.page(t(spark, sf, "orders"), ["o_orderkey"], 30, 10)


@query("sample_n", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 500")
def q_sample_n(spark, sf):
    """Deterministic fixed-size sample (md5 order of the key; the limit is the feature)."""
    return SM.sample_n(t(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500)


@query("top_k", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def q_top_k(spark, sf):
    """Top 20 by value (a top-k report)."""
    return SM.top_k(t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "o_totalprice", 20,
                    tiebreak="o_orderkey")


@query("top_k_per_group", """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3""")
def q_top_k_per_group(spark, sf):
    """Top 3 orders of every customer (group limit before the shuffle)."""
    return SM.top_k(t(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_totalprice", 3,
                    by=["o_custkey"], tiebreak="o_orderkey")


@query("argmax", """SELECT user_id, arg_max(event_id, (value, -event_id)) AS event_id, max(value) AS value
FROM events GROUP BY user_id""")
def q_argmax(spark, sf):
    """The highest-value event per user, first event wins ties (partial-aggregated max_by)."""
    e = t(spark, sf, "events")
    return SM.argmax(e, "user_id", "value", "event_id").select("user_id", "event_id", "value")


@query("filter_by_type", f"SELECT name, type, importance FROM ({profile_sql('lineitem', LINEITEM_COLS)}) WHERE type = 'Numeric'")
def q_filter_by_type(spark, sf):
    """The feature table filtered to one type."""
    p = P.feature_profile(t(spark, sf, "lineitem"))
    return p.filter(F.col("type") == "Numeric").select("name", "type", "importance")


@query("filter_stats", """SELECT "column", count, mean FROM (
  SELECT 'l_quantity' AS "column", count(l_quantity) AS count, round(avg(l_quantity), 4) AS mean FROM lineitem
  UNION ALL SELECT 'l_tax', count(l_tax), round(avg(l_tax), 4) FROM lineitem)""")
def q_filter_stats(spark, sf):
    """describe() filtered to chosen columns x chosen statistics."""
    d = P.describe(t(spark, sf, "lineitem"))
    return d.filter(F.col("column").isin("l_quantity", "l_tax")).select("column", "count", "mean")


@query("search_text", """SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'blue') OR contains(lower(p_brand), 'blue')""")
def q_search_text(spark, sf):
    """Case-insensitive substring search over name / description."""
    p = t(spark, sf, "part")
    return SM.search(p, ["p_name", "p_brand"], "Blue").select("p_partkey", "p_name")


# ------------------------------------------------------------------ scalar suites
@query("scalar_string", """SELECT c_custkey, 'seg_' || c_mktsegment AS prefixed, lower(c_name) AS lowered,
  contains(lower(c_name), '00') AS has_00,
  CASE WHEN length(c_name || '-' || c_mktsegment || '-' || c_name) > 28
       THEN substring(c_name || '-' || c_mktsegment || '-' || c_name, 1, 15) || '...' || right(c_name || '-' || c_mktsegment || '-' || c_name, 10)
       ELSE c_name || '-' || c_mktsegment || '-' || c_name END AS short_id,
  coalesce(CAST(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS VARCHAR), 'NULL') AS preview_text
FROM customer""")
def q_scalar_string(spark, sf):
    """2.7 string: concat prefix, lower/contains, id truncation, NULL marker."""
    c = t(spark, sf, "customer")
    long_id = F.concat_ws("-", "c_name", "c_mktsegment", "c_name")
    bal = F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.col("c_acctbal"))
    return c.select("c_custkey", F.concat(F.lit("seg_"), "c_mktsegment").alias("prefixed"),
                    F.lower("c_name").alias("lowered"), F.lower("c_name").contains("00").alias("has_00"),
                    S.truncate_id(long_id).alias("short_id"), S.null_text(bal).alias("preview_text"))


@query("scalar_date", """SELECT o_orderkey, strftime(o_orderdate, '%b %-d') AS month_day,
  strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso,
  CAST(floor((epoch(TIMESTAMP '2000-01-01 00:00:00') - epoch(o_orderdate)) / 86400) AS BIGINT) AS days_to_2000,
  try_cast(strftime(o_orderdate, '%Y-%m-%d') AS TIMESTAMP) IS NOT NULL AS parses
FROM orders""")
def q_scalar_date(spark, sf):
    """2.7 date: 'MMM d', ISO text, whole days between, lenient parse."""
    o = t(spark, sf, "orders")
    return o.select("o_orderkey", F.date_format("o_orderdate", "MMM d").alias("month_day"),
                    F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"),
                    S.whole_days_between(F.col("o_orderdate"), F.lit("2000-01-01 00:00:00").cast("timestamp"))
                    .cast("long").alias("days_to_2000"),
                    F.try_to_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd")).isNotNull().alias("parses"))


@query("scalar_math", """SELECT event_id, abs(value - 50) AS dist, round(sqrt(value), 6) AS root,
  CAST(round_even(value / 2, 0) AS BIGINT) AS half_even, greatest(0.0, least(100.0, value)) AS clamped,
  round(1.0 / (1.0 + value), 8) AS quality FROM events""")
def q_scalar_math(spark, sf):
    """2.7 math: abs, sqrt, half-even rounding, clamp, 1/(1+x)."""
    e = t(spark, sf, "events")
    return e.select("event_id", F.abs(F.col("value") - 50).alias("dist"), rnd(F.sqrt("value"), 6).alias("root"),
                    F.bround(F.col("value") / 2, 0).cast("long").alias("half_even"),
                    S.clamp(F.col("value"), 0.0, 100.0).alias("clamped"),
                    rnd(S.inverse_quality(F.col("value")), 8).alias("quality"))


@query("scalar_json", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  coalesce(json_extract_string(props, '$.missing'), 'default') AS missing,
  to_json({'event_type': event_type, 'k': CAST(json_extract_string(props, '$.k') AS INTEGER)})::VARCHAR AS doc FROM events""")
def q_scalar_json(spark, sf):
    """2.7 json: get with default, build a JSON document."""
    e = t(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    doc = F.to_json(F.struct(F.col("event_type").alias("event_type"), k.alias("k")))
    return e.select("event_id", k.alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("default"))
                    .alias("missing"), doc.alias("doc"))


@query("scalar_array", """SELECT conv_id, array_to_string(list_slice(list(role ORDER BY turn), 1, 2), ',') AS first_two,
  CAST(len(flatten(list([turn, turn]))) AS INTEGER) AS flat_len FROM conversations GROUP BY conv_id""")
def q_scalar_array(spark, sf):
    """2.7 array: slice of an ordered list, flatten of nested arrays."""
    c = t(spark, sf, "conversations")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("l"),
                                 F.collect_list(F.array("turn", "turn")).alias("nested"))
    return g.select("conv_id", F.array_join(F.slice(F.transform("l", lambda x: x["role"]), 1, 2), ",").alias("first_two"),
                    F.size(F.flatten("nested")).alias("flat_len"))
