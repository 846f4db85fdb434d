"""CSV records with line ends inside quotes, from splits read in parallel.

A line end closes a record where the number of quotes before it is even. Every file
split counts its quotes on its own; a prefix sum over the splits of a file (one row
each) tells each whether it starts inside quotes. Then every split cuts its lines
into records; only the pieces of records that cross a split's edge are shuffled
and put together. Lines stay in the tasks that read them.

Texts are read as pandas reads them: doubled quotes inside quotes, blank lines
skipped, ``NA_TEXTS`` missing, short records filled with nulls; fields beyond the
header's are dropped. A column is long, double or boolean if all its values are, else text.
A quote that is never closed makes the rest of its file one record.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import quoted
from ..session import materialize, ship_package

# Texts that pandas takes for missing, and for truth values.
NA_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
            "n/a", "nan", "null"]
TRUE_TEXTS, FALSE_TEXTS = ["True", "TRUE", "true"], ["False", "FALSE", "false"]
# splits (rows of a few dozen bytes) whose table may be broadcast
BROADCAST_SPLITS = 500_000


def lines_of(spark: SparkSession, path: str, western: bool = False) -> DataFrame:
    """(file, start, seq, line): lines in the order of ``seq`` within the file split at byte ``start``."""
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("seq"), "value")
    return raw.withColumn("line", F.decode(F.col("value").cast("binary"), "ISO-8859-1") if western else F.col("value")).drop("value")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Parts of the batches that lie in one split."""
    for batch in batches:
        start, files = batch.column("start").to_numpy(), batch.column("file")
        edges = np.flatnonzero(np.diff(start) != 0) + 1 if len(start) else []
        # neighbouring splits may start at one byte of different files
        same = pc.equal(files.slice(1), files.slice(0, max(0, len(files) - 1))).to_numpy(zero_copy_only=False) if len(files) > 1 else np.ones(0, bool)
        cuts = sorted({0, *map(int, edges), *map(int, np.flatnonzero(~same) + 1), batch.num_rows})
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield files[a].as_py(), int(start[a]), batch.slice(a, b - a)


def _quotes(lines: pa.Array) -> np.ndarray:
    return pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64)


def _count_quotes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, start, quotes, odd): quotes of a part of a split, and whether any of its lines ends behind an odd
    number of the split's quotes. A split in several batches is several rows; ``part`` orders them."""
    at, total, part = None, 0, 0
    for file, start, run in _runs(batches):
        if (file, start) != at:
            at, total, part = (file, start), 0, 0
        sums = total + np.cumsum(_quotes(run.column("line")))
        total, part = int(sums[-1]), part + 1
        yield pa.RecordBatch.from_pydict({"file": [file], "start": [start], "part": [part], "quotes": [total], "odd": [bool((sums % 2).any())]})


def splits_of(lines: DataFrame) -> DataFrame:
    """(file, start, inside, owner): whether a split starts inside quotes, and the start of the split
    in which the record that is open there began."""
    ship_package(lines.sparkSession)
    counted = lines.select("file", "start", "line").mapInArrow(_count_quotes, "file string, start long, part long, quotes long, odd boolean")
    splits = counted.groupBy("file", "start").agg(F.max_by("quotes", "part").alias("quotes"), F.max("odd").alias("odd"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row per split
    splits = splits.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    # a record begins here and stays open: odd behind the last line, even behind some line or before the first
    begins = (F.col("inside") != (F.col("quotes") % 2 == 1)) & (~F.col("inside") | F.col("odd"))
    return materialize(splits.withColumn("begins", begins).withColumn("owner", F.last(F.when(F.col("begins"), F.col("start")), ignorenulls=True).over(before))
                       .select("file", "start", "inside", "owner"), "csv-splits")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, owner, start, first, piece, whole): whole records, and pieces of those that cross an edge.
    ``first`` marks the first record of a file."""
    at, odd, held, owner, first = None, 0, [], None, False

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"file": pa.string(), "owner": pa.int64(), "start": pa.int64(), "first": pa.bool_(), "piece": pa.string(), "whole": pa.bool_()}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    for file, start, run in _runs(batches):
        if (file, start) != at:
            if held:
                yield out([(*at[:1], owner, at[1], first, "\n".join(held), False)])
            inside = run.column("inside")[0].as_py()
            at, odd, held = (file, start), int(inside), []
            owner, first = (run.column("owner")[0].as_py(), False) if inside else (start, start == 0)
            edge = inside  # the record at hand began in another split
        lines = run.column("line").to_pylist()
        ends = np.flatnonzero((odd + np.cumsum(_quotes(run.column("line")))) % 2 == 0)
        rows, begin = [], 0
        for end in ends.tolist():
            held.extend(lines[begin:end + 1])
            text = held[0] if len(held) == 1 else "\n".join(held)
            rows.append((file, owner, start, first, text, not edge))
            held, begin, owner, first, edge = [], end + 1, start, False, False
        held.extend(lines[begin:])
        odd = (odd + int(_quotes(run.column("line")).sum())) % 2
        if rows:
            yield out(rows)
    if held:
        yield out([(at[0], owner, at[1], first, "\n".join(held), False)])


def records_of(lines: DataFrame) -> DataFrame:
    """(record, first): all records of the files; ``first`` marks each file's header."""
    splits = splits_of(lines)
    if splits.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS:
        marked = lines.join(F.broadcast(splits), ["file", "start"])  # keeps the order of the lines
    else:
        marked = lines.join(splits, ["file", "start"]).repartition("file", "start").sortWithinPartitions("file", "start", "seq")
    ship_package(lines.sparkSession)
    cut = materialize(marked.select("file", "start", "line", "inside", "owner").mapInArrow(
        _cut, "file string, owner long, start long, first boolean, piece string, whole boolean"), "csv-records")
    pieces = (cut.filter("NOT whole").groupBy("file", "owner")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "piece"))), lambda s: s["piece"]), "\n").alias("piece"), F.max("first").alias("first")))
    both = cut.filter("whole").select("piece", "first").union(pieces.select("piece", "first"))
    return both.select(F.regexp_replace("piece", "\r$", "").alias("record"), "first")


def header_names(record: str, sep: str) -> list[str]:
    """Column names of a header record; empty and repeated names get a number."""
    out: list[str] = []
    for i, name in enumerate(next(csv.reader([record], delimiter=sep))):
        name = name or f"Unnamed: {i}"
        n, made = 0, name
        while made in out:
            n += 1
            made = f"{name}.{n}"
        out.append(made)
    return out


def fields_of(records: DataFrame, names: list[str], sep: str) -> DataFrame:
    """All fields as texts."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1", "mode": "PERMISSIVE"}
    rows = records.filter("NOT first AND record <> ''").select(F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), options).alias("r"))
    return rows.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])


def _missing(c: Column) -> Column:
    return F.when(~c.isin(*NA_TEXTS), c)


def typed(texts: DataFrame) -> DataFrame:
    """Columns as long, double or boolean where every value is one (one aggregate over all columns)."""
    clean = texts.select(*[_missing(quoted(c)).alias(c) for c in texts.columns])
    tests = {"bigint": lambda c: c.rlike(r"^\s*[+-]?\d+\s*$") & F.trim(c).try_cast("bigint").isNotNull(),
             "double": lambda c: ~c.rlike(r"(?i)[dfx]\s*$|^\s*$") & F.trim(c).try_cast("double").isNotNull(),
             "boolean": lambda c: c.isin(*TRUE_TEXTS, *FALSE_TEXTS)}
    names = list(texts.columns)
    fits = clean.agg(*[F.coalesce(F.bool_and(F.when(quoted(c).isNotNull(), f(quoted(c)))), F.lit(False)).alias(f"{kind}{i}") for i, c in enumerate(names) for kind, f in tests.items()]).first()
    out = []
    for i, c in enumerate(names):
        kind = next((k for k in tests if fits[f"{k}{i}"]), None)
        value = quoted(c) if kind is None else quoted(c).isin(*TRUE_TEXTS) if kind == "boolean" else F.trim(quoted(c)).try_cast(kind)
        out.append(value.alias(c))
    return clean.select(*out)
