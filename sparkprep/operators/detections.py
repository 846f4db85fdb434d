"""Post-processing of object detections as a batch job.

Input rows: ``(image_id, class_id, confidence, x1, y1, x2, y2)`` — one row per
raw box, as produced by any per-image detector (see
``sources.images.detect_images``). Everything below is a filter or a
partial-aggregated groupBy by image: images are independent, so the work
spreads over all tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import quoted, rnd

DEFAULT_THRESHOLD = 0.25
LOW_CONFIDENCE_SUFFIX = " (Low Confidence)"


def class_names_frame(spark: SparkSession, names: dict[int, str]) -> DataFrame:
    """(class_id, class_name) — the detector's label table (one row per class)."""
    return spark.createDataFrame(sorted(names.items()), "class_id int, class_name string")


def resolve_names(det: DataFrame, names: DataFrame) -> DataFrame:
    """Class name by id with the ``Class_<id>`` fallback. ``names`` is the caller's: Spark
    broadcasts it if it is small."""
    j = det.join(names, "class_id", "left")
    return j.withColumn("name", F.coalesce(F.col("class_name"), F.concat(F.lit("Class_"), F.col("class_id").cast("string")))) \
        .drop("class_name")


def to_xywh(det: DataFrame) -> DataFrame:
    """xyxy -> truncated integer (x, y, w, h)."""
    return det.select(
        "*", F.col("x1").cast("int").alias("x"), F.col("y1").cast("int").alias("y"),
        (F.col("x2") - F.col("x1")).cast("int").alias("w"), (F.col("y2") - F.col("y1")).cast("int").alias("h"))


def postprocess(det: DataFrame, names: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                order_col: str = "box_id") -> DataFrame:
    """Boxes above the threshold (strict); an image with none keeps its single
    best box, named with a low-confidence suffix. Confidence rounded to 3 dp.

    No window per image: kept boxes are a filter, and the fallback is one
    ``max_by`` per image (partial aggregation), so an image holding a third of
    all boxes is combined map-side. ``order_col`` breaks confidence ties (first
    box wins, as ``max`` does).
    """
    d = to_xywh(resolve_names(det, names))
    above = F.col("confidence") > F.lit(threshold)
    cols = ["image_id", order_col, "name", "confidence", "x", "y", "w", "h"]
    kept = d.filter(above).select(*cols)
    best = (d.groupBy("image_id")
            .agg(F.max(above.cast("int")).alias("_any"),
                 F.max_by(F.struct(*[c for c in cols if c != "image_id"]),
                          F.struct(F.col("confidence"), -quoted(order_col))).alias("_b"))
            .filter(F.col("_any") == 0).select("image_id", "_b.*")
            .withColumn("name", F.concat(F.col("name"), F.lit(LOW_CONFIDENCE_SUFFIX))))
    out = kept.unionByName(best.select(*cols))
    return out.withColumn("confidence", rnd("confidence", 3))


def summary(post: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """Per image: total objects and mean confidence (3 dp; 0 when none)."""
    s = post.groupBy("image_id").agg(F.count(F.lit(1)).alias("total_objects"),
                                     rnd(F.avg("confidence"), 3).alias("average_confidence"))
    if images is not None:
        s = images.select("image_id").distinct().join(s, "image_id", "left")
    return s.select("image_id", F.coalesce("total_objects", F.lit(0)).cast("long").alias("total_objects"),
                    F.coalesce("average_confidence", F.lit(0.0)).alias("average_confidence"))
