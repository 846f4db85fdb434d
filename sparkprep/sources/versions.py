"""Numbered dataset versions: one parquet directory per version plus an
append-only manifest log.

Layout under ``root``::

    <root>/<dataset>/data-<id>/             parquet data of a version
    <root>/<dataset>/_manifest/<seq>.json   one entry per event

Entries are never rewritten: "current" is the version named by the latest
entry (highest ``seq``), every other version is "previous". Updating a version
writes a NEW directory and a new entry, so an interrupted job never leaves a
half-overwritten version behind.

Data are written first, under a name of their own; the entry is then created
whole under the next number, or not at all if another writer took that number.
A writer that comes second reads the manifest again, takes the next version number and
tries anew, so writers at one time get versions of their own. On HDFS the creation is
a rename that refuses an existing target, on a local or mounted file system a hard
link; an object store must offer one of these.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MANIFEST_SCHEMA = ("dataset string, version int, seq long, date string, user string, changes string, "
                   "rows long, columns int, path string")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def manifest(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """All manifest entries of a dataset (empty frame if none)."""
    path = f"{root}/{dataset}/_manifest"
    if not _exists(spark, path):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    return spark.read.schema(MANIFEST_SCHEMA).json(path)


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole content, unless it exists: atomic, one of many writers succeeds."""
    jvm = spark.sparkContext._jvm
    fs, target = _fs(spark, path)
    fs.mkdirs(target.getParent())
    part = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}.tmp")  # hidden from readers
    out = fs.create(part, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            local = lambda p: jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri())
            jvm.java.nio.file.Files.createLink(local(target), local(part))
        else:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
            options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # no overwriting
            context.rename(part, target, options)
        return True
    except Exception as e:
        if "FileAlreadyExistsException" in str(e):
            return False
        raise
    finally:
        if fs.exists(part):
            fs.delete(part, False)


def _commit(spark: SparkSession, root: str, dataset: str, entry: Callable[[int, int], dict]) -> dict:
    """Append ``entry(next sequence number, next version)`` under a number that no other writer has."""
    while True:
        last = manifest(spark, root, dataset).agg(F.max("seq").alias("seq"), F.max("version").alias("version")).first()  # one row per event
        seq = (last["seq"] or 0) + 1
        now = _dt.datetime.now(_dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        new = {"dataset": dataset, "seq": seq, "date": now, **entry(seq, (last["version"] or 0) + 1)}
        if _create(spark, f"{root}/{dataset}/_manifest/{seq:012d}.json", json.dumps(new) + "\n"):
            return new


def _written(df: DataFrame, root: str, dataset: str) -> dict:
    """Write the data and describe them; rows are counted from the written files."""
    path = f"{root}/{dataset}/data-{uuid.uuid4().hex[:12]}"
    df.write.mode("errorifexists").parquet(path)
    return {"path": path, "rows": df.sparkSession.read.parquet(path).count(), "columns": len(df.columns)}


def save_version(df: DataFrame, root: str, dataset: str, changes: str = "Initial version",
                 user: str = "system") -> int:
    """Write ``df`` as the next version and make it current; returns the version number."""
    data = _written(df, root, dataset)
    return _commit(df.sparkSession, root, dataset, lambda seq, version: {**data, "version": version, "user": user, "changes": changes})["version"]


def list_versions(spark: SparkSession, root: str, dataset: str) -> DataFrame:
    """One row per version (its latest entry), newest first, with current/previous status."""
    m = manifest(spark, root, dataset)
    latest_entry = Window.partitionBy("version").orderBy(F.col("seq").desc())
    per_version = m.withColumn("_rk", F.row_number().over(latest_entry)).filter("_rk = 1").drop("_rk")
    cur = current_version(spark, root, dataset)
    return (per_version.withColumn("status", F.when(F.col("version") == F.lit(cur), "current").otherwise("previous"))
            .orderBy(F.col("version").desc()))


def current_version(spark: SparkSession, root: str, dataset: str) -> int | None:
    r = manifest(spark, root, dataset).orderBy(F.col("seq").desc()).limit(1).collect()
    return r[0]["version"] if r else None


def version_path(spark: SparkSession, root: str, dataset: str, version: int) -> str:
    m = manifest(spark, root, dataset).filter(F.col("version") == version).orderBy(F.col("seq").desc()).limit(1).collect()
    if not m:
        raise ValueError(f"{dataset} has no version {version}")
    return m[0]["path"]


def read_version(spark: SparkSession, root: str, dataset: str, version: int | None = None) -> DataFrame:
    """Time travel by number (current version when None)."""
    v = version if version is not None else current_version(spark, root, dataset)
    return spark.read.parquet(version_path(spark, root, dataset, v))


def restore_version(spark: SparkSession, root: str, dataset: str, version: int, user: str = "system") -> int:
    """Copy version N as a new version ("Restored from version N")."""
    return save_version(read_version(spark, root, dataset, version), root, dataset,
                        f"Restored from version {version}", user)


def update_version(df: DataFrame, root: str, dataset: str, version: int, changes: str,
                   user: str = "system") -> str:
    """Replace the content of version N: new directory, new entry, N becomes current."""
    data = _written(df, root, dataset)
    _commit(df.sparkSession, root, dataset, lambda seq, _: {**data, "version": version, "user": user, "changes": changes})
    return data["path"]


def snapshot(spark: SparkSession, root: str, dataset: str, changes: str = "Manual snapshot",
             user: str = "system") -> int:
    """Snapshot the current version as a new one."""
    return save_version(read_version(spark, root, dataset), root, dataset, changes, user)


def branch(spark: SparkSession, root: str, dataset: str, version: int, new_dataset: str,
           user: str = "system") -> int:
    """Copy version N of a dataset into a new working dataset."""
    return save_version(read_version(spark, root, dataset, version), root, new_dataset,
                        f"Branched from {dataset} version {version}", user)


def drop_dataset(spark: SparkSession, root: str, dataset: str) -> bool:
    """Delete a dataset with all its versions and its manifest."""
    fs, p = _fs(spark, f"{root}/{dataset}")
    return bool(fs.delete(p, True)) if fs.exists(p) else False


def list_datasets(spark: SparkSession, root: str) -> DataFrame:
    """Datasets under ``root`` with their newest entry time, newest first (one read of all manifests)."""
    fs, p = _fs(spark, root)
    if not fs.exists(p) or not any(st.isDirectory() for st in fs.listStatus(p)):
        return spark.createDataFrame([], "dataset string, last_change string, versions int")
    m = spark.read.schema(MANIFEST_SCHEMA).json(f"{root}/*/_manifest")
    return (m.groupBy("dataset").agg(F.max("date").alias("last_change"), F.max("version").alias("versions"))
            .orderBy(F.col("last_change").desc(), F.col("dataset")))
