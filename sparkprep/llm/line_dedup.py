"""Cross-site boilerplate lines by distinct-site spread.

For every line (a \\n-separated piece of a text, compared after trimming and
lower-casing) a HyperLogLog sketch of the sites that show it is built map-side
and merged by aggregation. Lines whose estimate is clear of the threshold are
decided by it; lines near it get an exact distinct count. Lines shown by
``min_sites`` sites or more are removed from every text. Copies of one whole
text count as one showing (on the least of their sites), and texts more than half
of whose words stand in lines of ``min_sites`` sites or more don't count as
showings at all: they are near copies of each other. Whole and near copies are the
business of document deduplication and must not make an article boilerplate.

Defined results: a null text stays null, a text that loses all its lines becomes
empty; lines of fewer than ``min_words`` words are never removed; a null site
counts for no spread but its texts are cleaned too; repeated rows each give a
row; an empty table gives an empty result; further columns are kept, but for those
called ``__n_lines`` or ``__n_removed``, which the result replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACE_CLASS, Packed, let, small, written

MIN_SITES = 3
MIN_WORDS = 3
LG_K = 8
# three standard errors of a sketch with 2**LG_K registers
MARGIN = 3 * 1.04 / 2 ** (LG_K / 2)


def _normal(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(SPACE_CHARS)))


def _long_enough(norm: Column, min_words: int) -> Column:
    """At least ``min_words`` words in a trimmed line."""
    more = f"(?:{SPACE_CLASS}[^\\x20\\x09-\\x0D]+){{{min_words - 1}}}" if min_words > 1 else ""
    return norm.rlike(f"^[^\\x20\\x09-\\x0D]+{more}")


def _lines(rows: DataFrame, text: str, min_words: int, *keep: Column) -> DataFrame:
    """One row per line that may be removed: its two hashes and position."""
    return (rows.select(*keep, F.posexplode(F.split(F.col(text), "\n")).alias("__pos", "__line"))
            .withColumn("__line", _normal(F.col("__line")))
            .filter(_long_enough(F.col("__line"), min_words))
            .withColumns({"h1": F.xxhash64("__line"), "h2": F.hash("__line"), "__words": F.size(F.split("__line", SPACE_CLASS))}).drop("__line"))


def boilerplate_lines(df: DataFrame, site: str = "source", text: str = "text", min_sites: int = MIN_SITES,
                      min_words: int = MIN_WORDS) -> DataFrame:
    """(h1, h2, estimate, sites): hashes of the lines on ``min_sites`` sites or
    more, near copies aside; ``sites`` is their exact count, null where the estimate
    of all showings was clear."""
    known = df.filter(F.col(site).isNotNull())
    lines = _lines(known, text, min_words, F.col(site).cast("string").alias("__site"), F.xxhash64(text).alias("__text"))
    shown = written(lines.groupBy("h1", "h2", "__text").agg(F.min("__site").alias("__site"), F.first("__words").alias("__words")), "line-shown")
    # sketches over numbers: an empty site name counts like any other
    spread = (shown.groupBy("h1", "h2").agg(F.hll_sketch_agg(F.xxhash64("__site"), F.lit(LG_K)).alias("__sk"))
              .select("h1", "h2", F.hll_sketch_estimate("__sk").alias("estimate"))
              .filter(F.col("estimate") >= int(min_sites * (1 - MARGIN))))
    spread = written(spread, "line-spread")
    clear = spread.filter(F.col("estimate") > min_sites * (1 + MARGIN))
    near = spread.filter(F.col("estimate") <= min_sites * (1 + MARGIN))
    exact = (shown.join(small(near), ["h1", "h2"])
             .groupBy("h1", "h2", "estimate", "__site").agg(F.count("*").alias("__n"))
             .groupBy("h1", "h2", "estimate").agg(F.count("*").alias("sites"))
             .filter(F.col("sites") >= min_sites))
    shared = written(clear.withColumn("sites", F.lit(None).cast("long")).unionByName(exact), "shared-lines")
    # near copies: texts more than half of whose words (each line once) stand in shared lines
    inside = shown.join(small(shared.select("h1", "h2")), ["h1", "h2"])
    whole = shown.groupBy("__text").agg(F.sum("__words").alias("__all"))
    copies = (inside.groupBy("__text").agg(F.sum("__words").alias("__in")).join(whole, "__text").filter(2 * F.col("__in") > F.col("__all")).select("__text"))
    copies = written(copies, "near-copies")
    own = inside.join(small(copies), "__text", "left_anti").groupBy("h1", "h2", "__site").agg(F.count("*").alias("__n"))
    own = own.groupBy("h1", "h2").agg(F.count("*").alias("__own")).filter(F.col("__own") >= min_sites)
    return written(shared.join(own, ["h1", "h2"]).withColumn("sites", F.when(F.col("sites").isNotNull(), F.col("__own"))).drop("__own"), "boilerplate")


def remove_boilerplate(df: DataFrame, boilerplate: DataFrame, text: str = "text", id_col: str = "doc_id",
                       min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with cleaned texts and ``__n_lines``, ``__n_removed``."""
    rows = df.withColumn("__h", F.xxhash64(text))
    lines = _lines(rows, text, min_words, F.col(id_col).alias("__id"), F.col("__h").alias("__th"))
    gone = (lines.join(small(boilerplate.select("h1", "h2")), ["h1", "h2"])
            .groupBy("__id", "__th").agg(F.collect_set("__pos").alias("__gone")))
    joined = rows.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left")
    pieces = F.split(F.col(text), "\n")
    cleaned = let(pieces, lambda ls: F.array_join(F.transform(
        F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("__gone")), lambda i: F.element_at(ls, i + 1)), "\n"))
    return (joined
            .withColumn("__n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.size(pieces)).cast("long"))
            .withColumn("__n_removed", F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long"))
            .withColumn(text, F.when(F.col("__gone").isNull(), F.col(text)).otherwise(cleaned))
            .drop("__h", "__id", "__th", "__gone"))


def dedup_lines(df: DataFrame, site: str = "source", text: str = "text", id_col: str = "doc_id",
                min_sites: int = MIN_SITES, min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` without boilerplate lines, plus ``__n_lines`` and ``__n_removed``."""
    packed = Packed(df, doc_id=id_col, text=text, source=site)
    found = boilerplate_lines(packed.df, "source", "text", min_sites, min_words)
    out = remove_boilerplate(packed.df, found, "text", "doc_id", min_words)
    return packed.unpacked(out, ("__n_lines", "__n_removed"), text=text)
