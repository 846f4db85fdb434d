"""Streaming query: cleaning fitted on the events table, applied to a file stream of it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scalar import rnd
from ..streaming.stream import FittedCleaner, parquet_stream, run_to_table
from .registry import query
from .tables import EVENTS_GAPPY_SQL, events_gappy


@query("stream_clean", f"""
WITH g AS {EVENTS_GAPPY_SQL},
f AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, coalesce(value, (SELECT avg(value) FROM g)) AS value,
             event_type FROM g),
q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM f)
SELECT event_id, user_id, round(value, 4) AS value, CAST(coalesce(event_type = 'click', FALSE) AS INTEGER) AS event_type_click,
  CAST(coalesce(event_type = 'error', FALSE) AS INTEGER) AS event_type_error,
  CAST(coalesce(event_type = 'purchase', FALSE) AS INTEGER) AS event_type_purchase,
  CAST(coalesce(event_type = 'signup', FALSE) AS INTEGER) AS event_type_signup,
  CAST(coalesce(event_type = 'view', FALSE) AS INTEGER) AS event_type_view
FROM f, q WHERE value >= q1 - 1.5 * (q3 - q1) AND value <= q3 + 1.5 * (q3 - q1)""")
def q_stream_clean(spark, sf):
    """2.8: fill / cast / outlier filter / one-hot fitted on the batch table,
    applied row-locally to a Structured Streaming read of the same file."""
    batch = events_gappy(spark, sf).select("event_id", "user_id", "value", "event_type")
    cleaner = FittedCleaner.fit(batch, fill={"value": "mean"}, casts={"user_id": "str"},
                                outliers={"value": "IQR"}, onehot=["event_type"])
    raw = parquet_stream(spark, sf, "events.parquet", spark.read.parquet(f"{sf}/events.parquet").schema)
    gappy = raw.select("event_id", "user_id",
                       F.when(F.col("event_type") == "click", F.lit(None)).otherwise(F.col("value")).alias("value"),
                       "event_type")
    out = run_to_table(cleaner.transform(gappy), f"stream_clean_{uuid.uuid4().hex[:8]}")
    return out.withColumn("value", rnd("value", 4))
