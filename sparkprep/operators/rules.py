"""Association rules: binarisation, frequent item sets (parallel FP-growth),
every antecedent/consequent split, and the rule summary.

Item sets come from Spark ML's ``FPGrowth`` (parallel FP-growth: it never
enumerates item pairs of a basket). Rules are generated per frequent item set
from its own subsets (2^m - 2 splits of an m-item set; m is bounded by the
longest frequent set, not by the data) and priced by joining the supports of
the antecedent and the consequent.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import named, quoted
from ..sources.ingest import is_numeric
from . import scan
from .clean import fit_domain, onehot

def binarize(df: DataFrame, cols: list[str], max_levels: int = 5) -> DataFrame:
    """0/1 columns pass through; other numeric -> ``<col>_high`` = value > median;
    text with <= ``max_levels`` values -> one-hot; other columns are dropped."""
    out = df
    keep = []
    numeric = [c for c in cols if is_numeric(df, c)]
    qv = scan.quantile_values(df, numeric, [0.5]) if numeric else {}
    medians = {c: (v[0] if v else None) for c, v in qv.items()}
    binary = set()
    for c in numeric:  # already 0/1 indicator columns pass through unchanged
        vals = [r[0] for r in df.select(quoted(c)).filter(quoted(c).isNotNull()).distinct().limit(3).collect()]
        if vals and set(vals) <= {0, 1}:
            binary.add(c)
    for c in cols:
        if c in binary:
            out = out.withColumn(c, quoted(c).cast("int"))
            keep.append(c)
        elif c in numeric:
            if medians[c] is not None:
                out = out.withColumn(f"{c}_high", (quoted(c) > F.lit(medians[c])).cast("int"))
                keep.append(f"{c}_high")
        else:
            dom = df.select(quoted(c)).filter(quoted(c).isNotNull()).distinct().limit(max_levels + 1).count()
            if dom <= max_levels:
                values = fit_domain(df, c, max_levels)
                before = set(out.columns)
                out = onehot(out, c, values)
                keep += [x for x in out.columns if x not in before]
    return out.select(*named(keep))


def onehot_to_baskets(binary: DataFrame, id_col: str | None = None) -> DataFrame:
    """0/1 indicator columns -> (id, items) with the names of the columns set to 1."""
    cols = [c for c in binary.columns if c != id_col]
    items = F.filter(F.array(*[F.when(quoted(c) == 1, F.lit(c)) for c in cols]), lambda x: x.isNotNull())
    return binary.select(*([quoted(id_col)] if id_col else []), F.array_sort(items).alias("items"))


def frequent_itemsets(baskets: DataFrame, min_support: float = 0.1, items_col: str = "items",
                      num_partitions: int | None = None) -> DataFrame:
    """(items sorted array, size, freq, support) of every item set with support >= min_support."""
    b = baskets.select(F.array_distinct(quoted(items_col)).alias("items"))  # FP-growth needs distinct items
    n = b.count()
    fp = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=1.0)
    if num_partitions:
        fp = fp.setNumPartitions(num_partitions)
    model = fp.fit(b)
    fi = model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").cast("long").alias("freq"))
    return (fi.withColumn("support", F.col("freq") / F.lit(float(n)))
            .filter(F.col("support") >= F.lit(min_support))
            .select("items", F.size("items").alias("size"), "freq", "support"))


def association_rules(itemsets: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """All rules A -> C with A, C non-empty, A u C frequent; confidence >= threshold.

    Columns: antecedents, consequents (sorted arrays), support, confidence,
    lift, leverage, conviction (NULL when confidence is 1). Rules come by falling
    lift, then confidence and support, then by their items. Item sets are compared as
    sorted arrays, so items may hold any character.
    """
    sup = itemsets.select(F.col("items").alias("k"), F.col("support").alias("s"))
    big = itemsets.filter(F.col("size") >= 2)
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), F.col("size")).cast("int") - 2)
    splits = big.select("items", F.col("support").alias("support"), F.explode(masks).alias("mask"))
    ante = F.expr("filter(items, (x, i) -> ((mask >> i) & 1) = 1)")
    r = splits.select("support", ante.alias("antecedents"), "items") \
        .withColumn("consequents", F.array_except("items", "antecedents"))
    a = sup.select(F.col("k").alias("ka"), F.col("s").alias("support_a"))
    c = sup.select(F.col("k").alias("kc"), F.col("s").alias("support_c"))
    r = r.join(a, F.col("antecedents") == F.col("ka")).join(c, F.col("consequents") == F.col("kc"))
    conf = F.col("support") / F.col("support_a")
    r = r.select("antecedents", "consequents", "support", conf.alias("confidence"),
                 (conf / F.col("support_c")).alias("lift"),
                 (F.col("support") - F.col("support_a") * F.col("support_c")).alias("leverage"),
                 F.when(conf < 1, (1 - F.col("support_c")) / (1 - conf)).alias("conviction"))
    return r.filter(F.col("confidence") >= F.lit(min_confidence)).orderBy(F.desc("lift"), F.desc("confidence"), F.desc("support"), "antecedents", "consequents")


def rule_summary(rules: DataFrame) -> DataFrame:
    """max / avg lift (clipped to [1, 50]), max confidence (clipped to [0, 1]), rule count."""
    r = rules.agg(F.max("lift").alias("mx"), F.avg("lift").alias("av"), F.max("confidence").alias("mc"),
                  F.count(F.lit(1)).alias("n"))
    clip = lambda x, lo, hi, default: F.when(x.isNull(), F.lit(default)).otherwise(F.least(F.lit(hi), F.greatest(F.lit(lo), x)))
    return r.select(clip(F.col("mx"), 1.0, 50.0, 1.0).alias("max_lift"),
                    clip(F.col("mc"), 0.0, 1.0, 0.0).alias("max_confidence"),
                    clip(F.col("av"), 1.0, 50.0, 1.0).alias("avg_lift"), F.col("n").alias("rules_count"))
