"""Association-rule queries (A0-A4) over order baskets of part types."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import rnd
from ..operators import groupby as G
from ..operators import rules as AR
from .registry import query
from .tables import t

MIN_SUPPORT = 0.1
MIN_CONFIDENCE = 0.3


def type_baskets(spark, sf):
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    return G.baskets(li.join(p, "l_partkey"), "l_orderkey", "p_type")


# item sets of any size: a frequent set grows by frequent items behind its last one
_B = """b AS (SELECT DISTINCT l_orderkey AS id, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey),
n AS (SELECT count(DISTINCT id)::DOUBLE AS n FROM b),
i1 AS (SELECT item, list(id) AS ids FROM b GROUP BY item HAVING count(*) / (SELECT n FROM n) >= {ms}),
fs AS (SELECT [item] AS items, item AS last, ids FROM i1
       UNION ALL SELECT list_append(fs.items, i1.item), i1.item, list_intersect(fs.ids, i1.ids) FROM fs JOIN i1 ON i1.item > fs.last
       WHERE len(list_intersect(fs.ids, i1.ids)) / (SELECT n FROM n) >= {ms}),
fi AS (SELECT items, len(items) AS size, len(ids) AS freq, len(ids) / (SELECT n FROM n) AS support FROM fs)"""


@query("frequent_itemsets", "WITH RECURSIVE " + _B.format(ms=MIN_SUPPORT) + """
SELECT array_to_string(items, '|') AS items, CAST(size AS INTEGER) AS size, CAST(freq AS BIGINT) AS freq, round(support, 8) AS support FROM fi""")
def q_frequent_itemsets(spark, sf):
    """A2: frequent item sets (parallel FP-growth), any size."""
    fi = AR.frequent_itemsets(type_baskets(spark, sf), MIN_SUPPORT)
    return fi.select(F.array_join("items", "|").alias("items"), "size", "freq", rnd("support", 8).alias("support"))


@query("frequent_pairs", "WITH RECURSIVE " + _B.format(ms=MIN_SUPPORT) + """
SELECT array_to_string(items, '|') AS items, CAST(freq AS BIGINT) AS freq FROM fi WHERE size <= 2""")
def q_frequent_pairs(spark, sf):
    """A1: frequent single items and pairs (inclusive support threshold)."""
    fi = AR.frequent_itemsets(type_baskets(spark, sf), MIN_SUPPORT).filter(F.col("size") <= 2)
    return fi.select(F.array_join("items", "|").alias("items"), "freq")


_RULES_SQL = "WITH RECURSIVE " + _B.format(ms=MIN_SUPPORT) + """,
sp AS (SELECT items, support FROM fi),
r AS (SELECT a.items AS ante, list_filter(f.items, lambda x: NOT list_contains(a.items, x)) AS cons, f.support,
        f.support / a.support AS confidence, a.support AS sa
      FROM fi f JOIN sp a ON len(a.items) < len(f.items) AND len(list_filter(a.items, lambda x: list_contains(f.items, x))) = len(a.items)),
rr AS (SELECT r.*, c.support AS sc FROM r JOIN sp c ON c.items = r.cons)
SELECT array_to_string(ante, '|') AS antecedents, array_to_string(cons, '|') AS consequents, round(support, 8) AS support,
  round(confidence, 8) AS confidence, round(confidence / sc, 8) AS lift, round(support - sa * sc, 8) AS leverage,
  round(CASE WHEN confidence < 1 THEN (1 - sc) / (1 - confidence) END, 8) AS conviction
FROM rr WHERE confidence >= """ + str(MIN_CONFIDENCE)


def _rules(spark, sf):
    fi = AR.frequent_itemsets(type_baskets(spark, sf), MIN_SUPPORT)
    return AR.association_rules(fi, MIN_CONFIDENCE)


@query("association_rules", _RULES_SQL)
def q_association_rules(spark, sf):
    """A3: every antecedent/consequent split with support, confidence, lift, leverage, conviction."""
    r = _rules(spark, sf)
    return r.select(F.array_join("antecedents", "|").alias("antecedents"), F.array_join("consequents", "|").alias("consequents"),
                    *[rnd(c, 8).alias(c) for c in ("support", "confidence", "lift", "leverage", "conviction")])


@query("rule_summary", f"""SELECT least(50.0, greatest(1.0, max(lift))) AS max_lift, least(1.0, greatest(0.0, max(confidence))) AS max_confidence,
  round(least(50.0, greatest(1.0, avg(lift))), 8) AS avg_lift, count(*) AS rules_count FROM ({_RULES_SQL})""")
def q_rule_summary(spark, sf):
    """A4: rule summary with clipped lift / confidence."""
    s = AR.rule_summary(_rules(spark, sf).select(*[rnd(c, 8).alias(c) for c in ("lift", "confidence")]))
    return s.withColumn("avg_lift", rnd("avg_lift", 8))


@query("binarize_median", """
SELECT CAST(o_totalprice > (SELECT median(o_totalprice) FROM orders) AS INTEGER) AS o_totalprice_high,
  CAST(o_orderpriority = '1-URGENT' AS INTEGER) AS is_urgent,
  CAST(coalesce(o_orderstatus = 'F', FALSE) AS INTEGER) AS o_orderstatus_F, CAST(coalesce(o_orderstatus = 'O', FALSE) AS INTEGER) AS o_orderstatus_O,
  CAST(coalesce(o_orderstatus = 'P', FALSE) AS INTEGER) AS o_orderstatus_P,
  CAST(coalesce(o_orderpriority = '1-URGENT', FALSE) AS INTEGER) AS "o_orderpriority_1-URGENT",
  CAST(coalesce(o_orderpriority = '2-HIGH', FALSE) AS INTEGER) AS "o_orderpriority_2-HIGH",
  CAST(coalesce(o_orderpriority = '3-MEDIUM', FALSE) AS INTEGER) AS "o_orderpriority_3-MEDIUM",
  CAST(coalesce(o_orderpriority = '4-NOT SPECIFIED', FALSE) AS INTEGER) AS "o_orderpriority_4-NOT SPECIFIED",
  CAST(coalesce(o_orderpriority = '5-LOW', FALSE) AS INTEGER) AS "o_orderpriority_5-LOW"
FROM orders""")
def q_binarize_median(spark, sf):
    """0/1 passthrough; numeric > median -> _high; text with <= 5 values -> one-hot."""
    o = t(spark, sf, "orders").select("o_totalprice", "o_orderstatus", "o_orderpriority",
                                      (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("is_urgent"))
    return AR.binarize(o, ["o_totalprice", "is_urgent", "o_orderstatus", "o_orderpriority"])
