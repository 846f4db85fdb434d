"""Unsupervised family routing with per-method failure isolation.

Families: clustering (kmeans, agglomerative, dbscan), dimensionality_reduction
(pca), anomaly (isolation_forest, one_class_svm), association (apriori = FP-growth item sets and
rules). Each method yields rows of a long metrics table
(method, metric, value, error); a failing method yields one error row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import named, quoted
from ..session import materialize
from . import anomaly, cluster, linkage, prep, reduce, rules

# Default method of every family.
DEFAULT_METHODS = {"clustering": ["kmeans"], "dimensionality_reduction": ["pca"], "anomaly": ["isolation_forest"],
                   "association": ["apriori"]}
FAMILY_OF = {"kmeans": "clustering", "agglomerative": "clustering", "dbscan": "clustering", "pca": "dimensionality_reduction",
             "isolation_forest": "anomaly", "one_class_svm": "anomaly", "apriori": "association"}


def _dbscan(df, key, features, params):
    """Cluster and noise counts, and the quality metrics of the other methods over the
    rows that are not noise, where there are two clusters or more."""
    lab = materialize(cluster.dbscan_labels(df, key, features, params.get("eps", 0.5), params.get("min_samples", 5)), "dbscan-labels")
    r = lab.agg(F.count_distinct(F.when(F.col("cluster") != cluster.NOISE, F.col("cluster"))).alias("k"),
                F.count_if(F.col("cluster") == cluster.NOISE).alias("noise")).first()
    out = [("n_clusters", float(r["k"])), ("n_noise", float(r["noise"]))]
    if r["k"] >= 2:
        named = lab.groupBy(quoted(key).alias("_key")).agg(F.max("cluster").alias("_cluster"))
        rows = df.select(quoted(key).alias("_id"), F.array(*[quoted(c).cast("double") for c in features]).alias("_x"))
        out += cluster.quality(rows.join(named, F.col("_id").eqNullSafe(F.col("_key"))), "_cluster", "_x")
    return out


def _clustering(df, key, vec, method, params):
    if method == "kmeans":
        lab, _ = cluster.kmeans(df, vec, k=params.get("n_clusters", 8), init=params.get("init", "k-means++"),
                                max_iter=params.get("max_iter", 300), seed=params.get("random_state", 42))
    else:
        size = df.select(F.size(vec)).first()[0]
        wide = df.select(quoted(key), *[F.col(vec)[i].alias(f"d{i}") for i in range(size)])
        found, error = linkage.agglomerative_labels(wide, key, [f"d{i}" for i in range(size)], params.get("n_clusters", 2), params.get("linkage", "ward"))
        lab = materialize(df.join(found, key), "agglomerative")
    summ = cluster.summaries(lab, "cluster", vec)
    out = [("n_clusters", float(len(summ)))]
    if method == "agglomerative":
        out.append(("linkage_error", error))
    if len(summ) >= 2:
        out.append(("silhouette_score", cluster.silhouette_sq(lab, "cluster", vec, summ).first()[0]))
        out.append(("calinski_harabasz_score", cluster.calinski_harabasz(lab, "cluster", vec, summ).first()[0]))
        out.append(("davies_bouldin_score", cluster.davies_bouldin(lab, "cluster", vec, summ).first()[0]))
    return out


def train_unsupervised(df: DataFrame, key: str, features: list[str], family: str,
                       methods: list[str] | None = None, params: dict | None = None,
                       items_col: str | None = None) -> DataFrame:
    """Run the selected methods of a family; returns (method, metric, value, error)."""
    if family not in DEFAULT_METHODS:
        raise ValueError(f"unknown unsupervised type '{family}'")
    methods = methods or DEFAULT_METHODS[family]
    params = params or {}
    spark = df.sparkSession
    rows = []
    for m in methods:
        p = params.get(m, {})
        try:
            if FAMILY_OF.get(m) != family:
                raise ValueError(f"method '{m}' does not belong to {family}")
            if family == "clustering":
                d = prep.impute(df.select(quoted(key), *named(features)), features)
                d = prep.standard_scale(d, features)
                if m == "dbscan":
                    out = _dbscan(d, key, features, p)
                else:
                    out = _clustering(d.select(quoted(key), F.array(*[quoted(c).cast("double") for c in features]).alias("x")), key, "x", m, p)
            elif family == "dimensionality_reduction":
                k = p.get("n_components", 2)
                ratios = reduce.variance_ratio(prep.impute(df.select(*named(features)), features), features, k, scale=True)
                vals = [r["ratio"] for r in ratios.orderBy("component").collect()]
                out = [("variance_explained", float(sum(vals))), ("n_components", float(k))]
            elif family == "anomaly":
                if m == "one_class_svm":
                    d = prep.standard_scale(prep.impute(df.select(quoted(key), *named(features)), features), features)
                    s = anomaly.one_class_svm(d, key, features, p.get("nu", 0.5), p.get("kernel", "rbf"), p.get("gamma", "scale"))
                else:
                    s = anomaly.isolation_forest(df, key, features, p.get("n_estimators", 100),
                                                 contamination=p.get("contamination", 0.1))
                r = anomaly.anomaly_summary(s).first()
                out = [("anomalies_detected", float(r["anomalies_detected"])), ("outlier_ratio", float(r["outlier_ratio"]))]
            else:
                baskets = df.select(quoted(items_col).alias("items")) if items_col else rules.onehot_to_baskets(rules.binarize(df, features))
                fi = rules.frequent_itemsets(baskets, p.get("min_support", 0.1))
                rl = rules.association_rules(fi, p.get("min_confidence", 0.5))
                s = rules.rule_summary(rl).first()
                out = [("rules_count", float(s["rules_count"])), ("max_lift", float(s["max_lift"])),
                       ("frequent_itemsets_count", float(fi.count()))]
            rows += [(m, k, None if v is None else float(v), None) for k, v in out]
        except Exception as e:  # one failing method does not abort the run
            rows.append((m, None, None, str(e).splitlines()[0][:300]))
    return spark.createDataFrame(rows, "method string, metric string, value double, error string")
