"""Scans and sinks: parquet tables, tolerant CSV, schema peek, file sinks.

Ingest rule: pandas has one missing value, Spark has NULL and NaN and NaN
poisons aggregates, so every float column is turned NaN -> NULL once here.
"""

from __future__ import annotations

import csv

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import named
from . import records

FLOAT_TYPES = (T.DoubleType, T.FloatType)

# Encodings and separators probed by the tolerant CSV reader.
CSV_ENCODINGS = ("utf-8", "cp1252")
CSV_SEPARATORS = (",", ";", "\t")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every float/double column (row-local, no action)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, FLOAT_TYPES):
            cols.append(F.nanvl(F.col(f"`{f.name}`"), F.lit(None).cast(f.dataType)).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def read_table(spark: SparkSession, sf_dir: str, name: str, clean_nan: bool = True) -> DataFrame:
    """Read one parquet table of a data directory."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return nan_to_null(df) if clean_nan else df


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "utf-8",
             infer_schema: bool = True, schema: T.StructType | str | None = None) -> DataFrame:
    """Plain CSV scan with a header row."""
    western = encoding.lower() in ("cp1252", "windows-1252")  # Spark reads its near relative latin-1
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", "iso-8859-1" if western else encoding)
    reader = reader.option("mode", "PERMISSIVE").option("multiLine", False)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", infer_schema)
    df = reader.csv(path)
    return nan_to_null(_cp1252(df) if western else df)


def _cp1252(df: DataFrame) -> DataFrame:
    """Texts and names read as latin-1, as cp1252 has them: it differs in 0x80-0x9F."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    old, new = (("".join(x) for x in zip(*((a, c) for a, c in pairs if c), strict=True)))
    table = str.maketrans(old, new)
    return df.select(*[(F.translate(F.col(f"`{f.name}`"), old, new) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`"))
                       .alias(f.name.translate(table)) for f in df.schema.fields])


def probe_csv_format(spark: SparkSession, path: str) -> tuple[str, str]:
    """Pick (encoding, separator).

    utf-8 unless some line of the whole file is not valid utf-8 (one distributed
    pass that stops at the first such line), then cp1252. The separator giving
    the most columns on the header line wins, separators inside quotes aside (a
    ``;`` file is not taken as one wide column).
    """
    lines = spark.read.text(path)
    bad = lines.filter(~F.is_valid_utf8("value")).limit(1).count()
    header = lines.filter(F.length("value") > 0).limit(1).collect()
    width = lambda s: len(next(csv.reader([header[0].value], delimiter=s)))
    best = max(CSV_SEPARATORS, key=lambda s: (width(s), -CSV_SEPARATORS.index(s))) if header else CSV_SEPARATORS[0]
    return CSV_ENCODINGS[1 if bad else 0], best


def read_csv_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """CSV scan as pandas does it: finds encoding and separator, keeps line ends inside
    quotes, takes the usual texts for missing values and types whole columns (``records``).

    Where no line holds an odd number of quotes, each line is a record and Spark's own
    reader cuts it; else records are put together from lines."""
    encoding, sep = probe_csv_format(spark, path)
    western = encoding != "utf-8"
    lines = records.lines_of(spark, path, western)
    odd = lines.filter((F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))) % 2 == 1)
    if odd.limit(1).count():
        rows = records.records_of(lines)
        head = rows.filter("first").limit(1).collect()
        if not head:
            return spark.createDataFrame([], T.StructType([]))
        texts = records.fields_of(rows, records.header_names(head[0].record, sep), sep)
    else:
        head = lines.filter("start = 0 AND line NOT IN ('', '\r')").orderBy("file", "seq").limit(1).collect()
        if not head:
            return spark.createDataFrame([], T.StructType([]))
        names = records.header_names(head[0].line.rstrip("\r"), sep)
        schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        reader = spark.read.schema(schema).option("header", True).option("sep", sep).option("escape", '"').option("maxCharsPerColumn", -1)
        texts = reader.option("encoding", "iso-8859-1" if western else "utf-8").csv(path).toDF(*names)
    return records.typed(_cp1252(texts) if western else texts)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """File sink (parquet by default; ``csv`` writes a header and no index, doubles quotes
    and keeps white space)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    return path


def schema_peek(df: DataFrame, order_by: list[str] | None = None, n: int = 5) -> DataFrame:
    """First ``n`` rows (in ``order_by`` order when given) — a bounded preview."""
    if order_by:
        df = df.orderBy(*named(order_by))
    return df.limit(n)


def schema_frame(df: DataFrame) -> DataFrame:
    """The schema as rows: (position, name, dtype, kind)."""
    rows = [(i, f.name, f.dataType.simpleString(), column_kind(f.dataType))
            for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(
        rows, "position int, name string, dtype string, kind string")


def column_kind(dt: T.DataType) -> str:
    """numeric / categorical / datetime / boolean / other (pandas-style dtype groups)."""
    if isinstance(dt, T.NumericType):
        return "numeric"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dt, T.StringType):
        return "categorical"
    if isinstance(dt, T.BooleanType):
        return "boolean"
    return "other"


def is_numeric(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, T.NumericType)


def scan_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None,
               predicate: Column | None = None, predicate_cols: list[str] | None = None) -> DataFrame:
    """Projected, filtered scan whose predicate reaches the parquet reader.

    ``nan_to_null`` wraps float columns in ``nanvl``, which hides them from
    filter pushdown, so the predicate is applied to the RAW columns first. The
    predicate must reject NULL on the columns it reads (comparisons, IN,
    BETWEEN); since Spark orders NaN above every number, each float column in
    ``predicate_cols`` gets an ``isnan`` guard, which makes the result equal to
    filtering after the NaN -> NULL conversion.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if predicate is not None:
        cond = predicate
        for c in predicate_cols or []:
            if isinstance(df.schema[c].dataType, FLOAT_TYPES):
                cond = cond & ~F.isnan(F.col(f"`{c}`"))
        df = df.filter(cond)
    if columns:
        df = df.select(*named(columns))
    return nan_to_null(df)
