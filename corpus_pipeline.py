"""Documents to training tokens: rules, line dedup, near-dedup, decontamination, pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprep.llm import decontaminate, line_dedup, near_dedup, quality, sentence_pieces
from sparkprep.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# EM, near-duplicate links and shortest paths have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    judged, _ = quality.judged(docs)
    return judged.filter("__kept").select(*docs.columns)


def line_spread(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many sites show."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group (five-word shingles, 80 percent)."""
    return near_dedup.one_of_each(docs).select(*docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to half or more."""
    judged = decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))
    return judged.filter("NOT __leaked").select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids, and whether these decode to the text."""
    return sentence_pieces.encoded(docs, sentence_pieces.read_model())


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_spread),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("sentence_pieces", pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
