"""Model results as a long table, leaderboards and model comparison.

``model_results(project_id, model_id, algorithm, problem_type, split, metric,
value, created_at, error)`` replaces the reference's one-JSON-file-per-run
layout: every question about stored runs is a filter / groupBy over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import named, rnd

RESULT_COLUMNS = ["project_id", "model_id", "algorithm", "problem_type", "split", "metric", "value",
                  "created_at", "error"]

# Metrics for which less is better.
LOWER_IS_BETTER = ["rmse", "mae", "mse", "log_loss", "davies_bouldin_score", "kl_divergence"]
TIE_BAND = 0.001

# Essential metrics per problem type.
ESSENTIAL_METRICS = {
    "classification": ["accuracy", "precision", "recall", "f1"],
    "regression": ["r2", "rmse", "mae"],
    "clustering": ["silhouette_score", "n_clusters", "calinski_harabasz_score"],
    "anomaly": ["outlier_ratio", "anomalies_detected"],
    "anomaly_detection": ["outlier_ratio", "anomalies_detected"],
    "dimensionality_reduction": ["variance_explained", "kl_divergence", "n_components"],
    "association": ["rules_count", "max_lift", "frequent_itemsets_count"],
    "association_rules": ["rules_count", "max_lift", "frequent_itemsets_count"],
    "unsupervised": ["completed", "n_clusters", "outlier_ratio"],
}
# Gap levels of a metric difference (strictly above).
GAP_LEVELS = [(0.15, "Significant"), (0.08, "Moderate"), (0.03, "Marginal")]
GAP_FALLBACK = "Minimal"

# Ordered fallbacks for the headline metric of a run, per problem type.
BEST_METRIC_ORDER = {
    "classification": ["accuracy", "f1", "precision", "recall"],
    "regression": ["r2", "rmse", "mae"],
    "clustering": ["silhouette_score", "calinski_harabasz_score", "davies_bouldin_score"],
    "anomaly": ["outlier_ratio", "anomalies_detected"],
    "anomaly_detection": ["outlier_ratio", "anomalies_detected"],
    "dimensionality_reduction": ["variance_explained", "n_components"],
    "association": ["rules_count", "max_lift"],
    "association_rules": ["rules_count", "max_lift"],
}


def to_long(metrics: DataFrame, id_cols: list[str], metric_cols: list[str]) -> DataFrame:
    """Wide metrics -> (id..., metric, value) with one ``stack``."""
    pairs = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metric_cols)
    return metrics.select(*id_cols, F.expr(f"stack({len(metric_cols)}, {pairs}) AS (metric, value)"))


def run_results(metrics: DataFrame, project_id: str, model_id: str, problem_type: str, created_at: str) -> DataFrame:
    """Result rows of a run from the metrics that training returns (``algorithm``
    or ``method``, ``metric``, ``value``, ``error`` and, for supervised runs, ``split``)."""
    name = "algorithm" if "algorithm" in metrics.columns else "method"
    split = F.col("split") if "split" in metrics.columns else F.lit(None).cast("string")
    return metrics.select(F.lit(project_id).alias("project_id"), F.lit(model_id).alias("model_id"), F.col(name).alias("algorithm"),
                          F.lit(problem_type).alias("problem_type"), split.alias("split"), "metric", "value",
                          F.lit(created_at).alias("created_at"), "error")


def append_results(rows: DataFrame, path: str) -> None:
    """Add a run's rows to the results table, files in a folder of shared storage."""
    rows.select(*RESULT_COLUMNS).write.mode("append").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All results. A run (project, model, time) that was appended twice, as by a job that was tried
    again, counts once: its equal rows are one."""
    return spark.read.parquet(path).select(*RESULT_COLUMNS).distinct()


def best_by(df: DataFrame, metric: str, by: list[str] | None = None, tiebreak: str | None = None,
            higher: bool = True) -> DataFrame:
    """Row with the best ``metric`` (per ``by`` group); ties go to the smallest ``tiebreak``."""
    by = list(by or [])
    order = [F.col(metric).desc_nulls_last() if higher else F.col(metric).asc_nulls_last()]
    if tiebreak:
        order.append(F.col(tiebreak).asc())
    if not by:
        return df.orderBy(*order).limit(1)
    w = Window.partitionBy(*named(by)).orderBy(*order)
    return df.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1).drop("_rk")


def display_score(results: DataFrame) -> DataFrame:
    """0-100 score of a run: the headline metric of its type, best algorithm, 1 dp.

    clustering: silhouette (negatives as 0); dimensionality_reduction:
    variance explained; anomaly: outlier ratio; association: min(rules/10, 1);
    classification: accuracy; regression: R^2 (negatives as 0). Error rows skip.
    """
    r = results.filter(F.col("error").isNull() & F.col("value").isNotNull())
    pt, m, v = F.col("problem_type"), F.col("metric"), F.col("value")
    val = (F.when((pt == "clustering") & (m == "silhouette_score"), F.greatest(v, F.lit(0.0)))
           .when((pt == "dimensionality_reduction") & (m == "variance_explained"), v)
           .when(pt.isin("anomaly", "anomaly_detection") & (m == "outlier_ratio"), v)
           .when(pt.isin("association", "association_rules") & (m == "rules_count"), F.least(v / 10.0, F.lit(1.0)))
           .when((pt == "classification") & (m == "accuracy"), v)
           .when((pt == "regression") & (m == "r2"), F.greatest(v, F.lit(0.0))))
    label = (F.when(pt == "clustering", "Silhouette Score").when(pt == "dimensionality_reduction", "Variance Explained")
             .when(pt.isin("anomaly", "anomaly_detection"), "Anomaly Ratio")
             .when(pt.isin("association", "association_rules"), "Rules Found")
             .when(pt == "classification", "Accuracy").when(pt == "regression", "R2 Score"))
    s = r.filter(F.col("split").isNull() | (F.col("split") == "test")).select(
        "project_id", "model_id", "problem_type", (val * 100).alias("s"), label.alias("label"))
    return (s.filter(F.col("s").isNotNull()).groupBy("project_id", "model_id", "problem_type")
            .agg(rnd(F.max("s"), 1).alias("display_score"), F.first("label").alias("score_label")))


def best_metric(results: DataFrame, digits: int = 4) -> DataFrame:
    """Headline metric of every run: the first available metric of the type's fallback list."""
    r = results.filter(F.col("error").isNull() & F.col("value").isNotNull()
                       & (F.col("split").isNull() | (F.col("split") == "test")))
    cand = _headline(r)
    # per run: smallest priority, then the best algorithm for that metric
    pick = F.min_by(F.struct("metric", "value", "algorithm"), F.struct(F.col("_p"), -F.col("_o"), F.col("algorithm")))
    g = cand.groupBy("project_id", "model_id", "problem_type").agg(pick.alias("b"))
    return g.select("project_id", "model_id", "problem_type", F.col("b.metric").alias("metric"),
                    rnd("b.value", digits).alias("value"), F.col("b.algorithm").alias("algorithm"))


def best_model(results: DataFrame, metric: str = "accuracy", split: str = "test") -> DataFrame:
    """Best algorithm of every run by ``metric`` (first algorithm name wins ties)."""
    r = results.filter((F.col("metric") == metric) & (F.col("split") == split) & F.col("error").isNull())
    higher = metric not in LOWER_IS_BETTER
    key = F.col("value") if higher else -F.col("value")
    w = Window.partitionBy("project_id", "model_id").orderBy(key.desc(), F.col("algorithm").asc())
    return (r.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") == 1)
            .select("project_id", "model_id", F.col("algorithm").alias("best_algorithm"), "value"))


def winner(metric: Column, a: Column, b: Column) -> Column:
    """'A' / 'B' / 'tie' with the metric's direction and a 0.001 tie band."""
    lower = metric.isin(*LOWER_IS_BETTER)
    return (F.when(a.isNull() | b.isNull(), F.lit("tie"))
            .when(F.abs(a - b) < TIE_BAND, F.lit("tie"))
            .when(lower, F.when(a < b, F.lit("A")).otherwise(F.lit("B")))
            .otherwise(F.when(a > b, F.lit("A")).otherwise(F.lit("B"))))


def gap_level(diff: Column) -> Column:
    out = F.lit(GAP_FALLBACK)
    for thr, name in reversed(GAP_LEVELS):
        out = F.when(diff > thr, F.lit(name)).otherwise(out)
    return out


def _headline(results: DataFrame) -> DataFrame:
    """Rows of a headline metric with ``_p`` (its place in the type's list) and
    ``_o`` (the value, negated where less is better)."""
    prio = F.lit(None).cast("int")
    for ptype, names in BEST_METRIC_ORDER.items():
        for i, name in enumerate(names):
            prio = F.when((F.col("problem_type") == ptype) & (F.col("metric") == name), F.lit(i)).otherwise(prio)
    lower = F.col("metric").isin(*LOWER_IS_BETTER)
    return (results.withColumn("_p", prio).filter(F.col("_p").isNotNull())
            .withColumn("_o", F.when(lower, -F.col("value")).otherwise(F.col("value"))))


def compare_models(results: DataFrame, model_a: str, model_b: str, split: str = "test") -> DataFrame:
    """Metric-by-metric comparison of two runs' best algorithms.

    The best algorithm of a run is the one with the best headline metric of the
    run's type (its direction counts; the first name wins ties); a run without a
    headline metric takes its first algorithm. Rows without a split (clustering,
    anomaly, association) count like those of ``split``.
    """
    r = results.filter((F.col("split").isNull() | (F.col("split") == split)) & F.col("error").isNull() & F.col("value").isNotNull()
                       & F.col("model_id").isin(model_a, model_b))
    best = (_headline(r).groupBy("model_id")
            .agg(F.min_by("algorithm", F.struct(F.col("_p"), -F.col("_o"), F.col("algorithm"))).alias("best")))
    chosen = (r.groupBy("model_id").agg(F.min("algorithm").alias("first")).join(best, "model_id", "left")
              .select("model_id", F.coalesce("best", "first").alias("algorithm")))
    rows = r.join(chosen, ["model_id", "algorithm"])
    of = lambda mid, name: (rows.filter(F.col("model_id") == mid).groupBy("metric")
                            .agg(F.max("value").alias(name)))
    j = of(model_a, "value_a").join(of(model_b, "value_b"), "metric", "full")
    diff = F.abs(F.col("value_a") - F.col("value_b"))
    return j.select("metric", "value_a", "value_b", diff.alias("difference"),
                    winner(F.col("metric"), F.col("value_a"), F.col("value_b")).alias("winner"),
                    gap_level(diff).alias("gap_level"))


def essential_metrics(results: DataFrame) -> DataFrame:
    """Keep the essential metrics of each run's problem type."""
    pairs = [(k, m) for k, ms in ESSENTIAL_METRICS.items() for m in ms]
    keep = F.lit(False)
    for k, m in pairs:
        keep = keep | ((F.col("problem_type") == k) & (F.col("metric") == m))
    return results.filter(keep)


def project_models(results: DataFrame) -> DataFrame:
    """Projects with their model counts and newest run time, newest first."""
    runs = results.groupBy("project_id", "model_id").agg(F.max("created_at").alias("created_at"),
                                                         F.max(F.col("error").isNotNull().cast("int")).alias("failed"))
    return (runs.groupBy("project_id").agg(F.count(F.lit(1)).alias("models"),
                                           F.sum("failed").alias("failed_models"),
                                           F.max("created_at").alias("latest"))
            .orderBy(F.col("latest").desc(), F.col("project_id")))


def load_results(results: DataFrame, model_id: str) -> DataFrame:
    return results.filter(F.col("model_id") == model_id)


def results_json(results: DataFrame) -> DataFrame:
    """One JSON document per run (the export form)."""
    return (results.groupBy("project_id", "model_id").agg(
        F.to_json(F.sort_array(F.collect_list(F.struct("algorithm", "split", "metric", "value")))).alias("results")))
