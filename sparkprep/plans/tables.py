"""Shared inputs of the registered queries, built from the given tables only.

Every derived input is a deterministic function of the table rows (no id
subsets, no sampling), written once in Spark and once in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import rnd
from ..sources.ingest import read_table

# Column kinds of the test tables used in generated oracle SQL:
# (name, kind, integral)
LINEITEM_COLS = [
    ("l_orderkey", "numeric", True), ("l_partkey", "numeric", True), ("l_suppkey", "numeric", True),
    ("l_linenumber", "numeric", True), ("l_quantity", "numeric", False),
    ("l_extendedprice", "numeric", False), ("l_discount", "numeric", False), ("l_tax", "numeric", False),
    ("l_returnflag", "categorical", False), ("l_linestatus", "categorical", False),
    ("l_shipdate", "datetime", False),
]
DOCLABEL_COLS = [
    ("doc_id", "numeric", True), ("lang", "categorical", False), ("source", "categorical", False),
    ("n_chars", "numeric", True), ("quality", "numeric", True), ("toxic", "numeric", True),
]
EVENTS_COLS = [
    ("event_id", "numeric", True), ("ts", "datetime", False), ("user_id", "numeric", True),
    ("event_type", "categorical", False), ("value", "numeric", False), ("props", "categorical", False),
]


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, sf, name)


def doc_labels(spark: SparkSession, sf: str) -> DataFrame:
    """documents LEFT JOIN labels: natural NULLs in quality / toxic."""
    d = t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.join(t(spark, sf, "labels"), "doc_id", "left")


DOC_LABELS_SQL = ("(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic "
                  "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")


def events_gappy(spark: SparkSession, sf: str) -> DataFrame:
    """events with ``value`` NULL on click rows (a value-derived gap pattern)."""
    e = t(spark, sf, "events")
    return e.withColumn("value", F.when(F.col("event_type") == "click", F.lit(None)).otherwise(F.col("value")))


EVENTS_GAPPY_SQL = ("(SELECT event_id, ts, user_id, event_type, "
                    "CASE WHEN event_type = 'click' THEN NULL ELSE value END AS value, props FROM events)")


def events_text(spark: SparkSession, sf: str) -> DataFrame:
    """events with value and props as text, for type conversion."""
    e = t(spark, sf, "events")
    return e.select("event_id", "event_type", F.col("value").cast("string").alias("value_text"),
                    F.get_json_object("props", "$.k").alias("k_text"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Binary score table from events: y_true = purchase, y_score = value / max(value), 4 dp."""
    e = t(spark, sf, "events")
    mx = e.agg(F.max("value")).first()[0] or 1.0  # scalar action
    return e.select("event_id", (F.col("event_type") == "purchase").cast("int").alias("y_true"),
                    rnd(F.col("value") / F.lit(float(mx)), 4).alias("y_score"))


SCORES_SQL = ("(SELECT event_id, CAST(event_type = 'purchase' AS INTEGER) AS y_true, "
              "round(value / (SELECT max(value) FROM events), 4) AS y_score FROM events)")
