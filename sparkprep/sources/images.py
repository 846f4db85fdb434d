"""Image source and batch inference with a user-supplied detector.

``read_images`` is a ``binaryFile`` scan with the extension filter and the
size cap applied as pushed-down predicates. ``detect_images`` runs any
detector callable per image inside ``mapInPandas`` (Arrow batches); the model
is loaded once per task by ``load_model`` (e.g. from a shared path), never
collected to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted image extensions and the upload size cap.
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "gif", "webp"]
MAX_IMAGE_BYTES = 16 * 1024 * 1024

DETECTION_SCHEMA = ("image_id string, box_id int, class_id int, confidence double, "
                    "x1 double, y1 double, x2 double, y2 double")


def read_images(spark: SparkSession, path: str, max_bytes: int = MAX_IMAGE_BYTES) -> DataFrame:
    """(path, length, content) of accepted images under ``path`` (recursive)."""
    glob = "*.{" + ",".join(IMAGE_EXTENSIONS + [e.upper() for e in IMAGE_EXTENSIONS]) + "}"
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
          .option("recursiveFileLookup", "true").load(path))
    return df.filter(F.col("length") <= max_bytes).select("path", "length", "content")


def detect_images(images: DataFrame, load_model: Callable[[], Callable[[bytes], list[tuple]]]) -> DataFrame:
    """Run a detector over every image; one output row per raw box.

    ``load_model()`` returns ``detect(image_bytes) -> [(class_id, confidence,
    x1, y1, x2, y2), ...]``; it is called once per task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = load_model()
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                for i, b in enumerate(detect(bytes(content)) or []):
                    rows.append((path, i, int(b[0]), float(b[1]), float(b[2]), float(b[3]), float(b[4]), float(b[5])))
            yield pd.DataFrame(rows, columns=["image_id", "box_id", "class_id", "confidence", "x1", "y1", "x2", "y2"])

    return images.select("path", "content").mapInPandas(run, DETECTION_SCHEMA)
