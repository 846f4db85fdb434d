"""Model preparation, linear models, training runs, clustering metrics,
PCA and anomaly queries (M1-M18, U1-U16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import rnd
from ..operators import anomaly as AN
from ..operators import cluster as CL
from ..operators import knn as KN
from ..operators import linkage as LK
from ..operators import prep as PR
from ..operators import reduce as RD
from ..operators import supervised as SV
from .registry import query
from .tables import DOC_LABELS_SQL, doc_labels, t

D = 6


# ------------------------------------------------------------------ preparation
@query("ml_impute", f"""
WITH d AS {DOC_LABELS_SQL},
m AS (SELECT lang FROM d WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)
SELECT doc_id, round(coalesce(quality, (SELECT avg(quality) FROM d)), {D}) AS quality,
  round(coalesce(toxic, (SELECT avg(toxic) FROM d)), {D}) AS toxic, coalesce(lang, (SELECT lang FROM m)) AS lang FROM d""")
def q_ml_impute(spark, sf):
    """M1: numeric features -> mean, text -> most frequent value."""
    d = doc_labels(spark, sf).select("doc_id", "quality", "toxic", "lang")
    out = PR.impute(d, ["quality", "toxic", "lang"])
    return out.select("doc_id", rnd("quality", D).alias("quality"), rnd("toxic", D).alias("toxic"), "lang")


@query("standard_scale", f"""SELECT l_orderkey, l_linenumber, l_partkey,
  round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), {D}) AS l_quantity,
  round((l_discount - (SELECT avg(l_discount) FROM lineitem)) / (SELECT stddev_pop(l_discount) FROM lineitem), {D}) AS l_discount
FROM lineitem""")
def q_standard_scale(spark, sf):
    """M5: (x - mean) / population std."""
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount")
    out = PR.standard_scale(li, ["l_quantity", "l_discount"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", rnd("l_quantity", D).alias("l_quantity"),
                      rnd("l_discount", D).alias("l_discount"))


def _split_sql(salt: str, test_size: float = 0.2) -> str:
    return f"""SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY md5('{salt}' || CAST(event_id AS VARCHAR)), event_id)
  <= floor(count(*) OVER (PARTITION BY event_type) * {test_size} + 0.5) THEN 'test' ELSE 'train' END AS split FROM events"""


@query("stratified_split", _split_sql("42"))
def q_stratified_split(spark, sf):
    """M6: exact per-class test share, md5 order (hash buckets, no whole-class sort)."""
    e = t(spark, sf, "events").select("event_id", "event_type")
    return PR.stratified_split(e, "event_id", "event_type", 0.2, "42").select("event_id", "split")


@query("kfold_assign", """SELECT event_id, CAST((row_number() OVER (PARTITION BY event_type ORDER BY md5('42' || CAST(event_id AS VARCHAR)), event_id) - 1) % 5 AS INTEGER) AS fold FROM events""")
def q_kfold_assign(spark, sf):
    """Stratified 5-fold assignment."""
    e = t(spark, sf, "events").select("event_id", "event_type")
    return PR.assign_folds(e, "event_id", "event_type", 5, "42").select("event_id", "fold")


@query("shuffle_split", " UNION ALL ".join(
    f"SELECT {i} AS split_id, event_id, split FROM ({_split_sql(f'42-{i}', 0.25)})" for i in range(3)))
def q_shuffle_split(spark, sf):
    """Three repeated stratified splits (test share 0.25)."""
    e = t(spark, sf, "events").select("event_id", "event_type")
    return PR.shuffle_split(e, "event_id", "event_type", 3, 0.25, "42")


@query("legacy_prepare", f"""WITH q AS (SELECT quality, toxic FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)
SELECT round((quality - (SELECT avg(quality) FROM q)) / (SELECT stddev_pop(quality) FROM q), {D}) AS quality,
  round((toxic - (SELECT avg(toxic) FROM q)) / (SELECT stddev_pop(toxic) FROM q), {D}) AS toxic
FROM q""")
def q_legacy_prepare(spark, sf):
    """M6d: drop NULL rows, numeric only, scale."""
    out = PR.legacy_prepare(t(spark, sf, "labels").select("quality", "toxic"), ["quality", "toxic"])
    return out.select(rnd("quality", D).alias("quality"), rnd("toxic", D).alias("toxic"))


# ------------------------------------------------------------------ linear models (closed-form oracles)
_XY = "(SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem)"
_SUMS = f"(SELECT avg(x) AS mx, avg(y) AS my, sum((x - (SELECT avg(x) FROM {_XY} a)) * (y - (SELECT avg(y) FROM {_XY} b))) AS sxy, " \
        f"sum((x - (SELECT avg(x) FROM {_XY} c)) * (x - (SELECT avg(x) FROM {_XY} d))) AS sxx, count(*) AS n FROM {_XY} e)"


@query("linreg", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, "
       "round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def q_linreg(spark, sf):
    """Ordinary least squares (Spark LinearRegression, normal equations)."""
    r = SV.linear_fit(t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "linear_regression")
    return r.select(rnd("slope", 4).alias("slope"), rnd("intercept", 4).alias("intercept"))


@query("ridge", f"SELECT round(sxy / (sxx + 1000.0), 4) AS slope, round(my - sxy / (sxx + 1000.0) * mx, 4) AS intercept FROM {_SUMS} s")
def q_ridge(spark, sf):
    """Ridge, alpha = 1000 (closed form w = Sxy / (Sxx + alpha))."""
    r = SV.linear_fit(t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "ridge", alpha=1000.0)
    return r.select(rnd("slope", 4).alias("slope"), rnd("intercept", 4).alias("intercept"))


@query("lasso", f"""SELECT round(w, 2) AS slope, round(my - w * mx, 2) AS intercept FROM (
  SELECT *, sign(sxy / n) * greatest(abs(sxy / n) - 5000.0, 0) / (sxx / n) AS w FROM {_SUMS} s)""")
def q_lasso(spark, sf):
    """Lasso, alpha = 5000 (one feature: soft threshold)."""
    r = SV.linear_fit(t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "lasso", alpha=5000.0, max_iter=10000)
    return r.select(rnd("slope", 2).alias("slope"), rnd("intercept", 2).alias("intercept"))


# ------------------------------------------------------------------ training runs (rows-only)
# fewer and shallower trees than the defaults (100, unlimited depth, 100 rounds): those take over
# seven minutes here on lineitem of sf0.01, eight threads
_QUERY_PARAMS = {"random_forest": {"n_estimators": 20, "max_depth": 8}, "gradient_boosting": {"n_estimators": 20}, "xgboost": {"n_estimators": 20}}


@query("train_classification")
def q_train_classification(spark, sf):
    """Every registered classifier (algorithms not
    chosen -> all) with one-hot text features on documents -> quality."""
    d = t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(
        t(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    _pred, metrics = SV.train_models(d, "doc_id", "quality", ["lang", "source", "n_chars"], "classification",
                                     None, _QUERY_PARAMS)
    return metrics


@query("train_regression")
def q_train_regression(spark, sf):
    """Linear, ridge, lasso, forest, boosting on lineitem -> price."""
    li = t(spark, sf, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("line_id"),
        "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag")
    _pred, metrics = SV.train_models(li, "line_id", "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_returnflag"],
                                     "regression", ["linear_regression", "ridge", "lasso", "random_forest",
                                                    "gradient_boosting"], _QUERY_PARAMS)
    return metrics


@query("feature_importance")
def q_feature_importance(spark, sf):
    """Top-20 feature importances of a forest (names from ML attributes)."""
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
                                         "l_returnflag")
    return SV.feature_importance(li, "l_orderkey", "l_extendedprice", ["l_quantity", "l_discount", "l_tax", "l_returnflag"],
                                 "regression", "random_forest", _QUERY_PARAMS["random_forest"])


# ------------------------------------------------------------------ clustering (labels of embeddings as clusters)
_E = "(SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"


def _emb(spark, sf):
    return t(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


@query("cluster_sizes", "SELECT label AS cluster, count(*) AS size FROM embeddings GROUP BY label")
def q_cluster_sizes(spark, sf):
    """Rows per cluster (plot metadata)."""
    return CL.cluster_sizes(_emb(spark, sf), "label")


@query("cluster_stats", f"""SELECT label AS cluster, CAST(i - 1 AS INTEGER) AS dim, count(*) AS size, round(avg(x[i]), {D}) AS mean,
  round(stddev_pop(x[i]), {D}) AS std, round(min(x[i]), {D}) AS min, round(max(x[i]), {D}) AS max
FROM {_E} e, range(1, 65) r(i) GROUP BY label, i""")
def q_cluster_stats(spark, sf):
    """Per cluster and dimension: mean, population std, min, max."""
    return CL.cluster_stats(_emb(spark, sf), "label", "x")


_PAIRS = f"""p AS (SELECT a.vec_id, a.label AS la, b.label AS lb, list_distance(a.x, b.x) ^ 2 AS d FROM {_E} a JOIN {_E} b ON a.vec_id <> b.vec_id),
pc AS (SELECT vec_id, la, lb, avg(d) AS md FROM p GROUP BY ALL),
s AS (SELECT vec_id, max(CASE WHEN la = lb THEN md END) AS a, min(CASE WHEN la <> lb THEN md END) AS b FROM pc GROUP BY vec_id)"""


@query("silhouette", f"WITH {_PAIRS} SELECT round(avg(coalesce((b - a) / greatest(a, b), 0.0)), {D}) AS silhouette_sq FROM s")
def q_silhouette(spark, sf):
    """U4: silhouette with squared distances from cluster summaries (oracle: all pairs)."""
    return CL.silhouette_sq(_emb(spark, sf), "label", "x").select(rnd("silhouette_sq", D).alias("silhouette_sq"))


_CENT = f"""c AS (SELECT label, i, avg(x[i]) AS cv, count(*) AS n FROM {_E} e, range(1, 65) r(i) GROUP BY label, i),
g AS (SELECT i, avg(x[i]) AS gv FROM {_E} e, range(1, 65) r(i) GROUP BY i)"""


@query("calinski_harabasz", f"""WITH {_CENT},
bt AS (SELECT sum(c.n * (cv - gv) ^ 2) AS b FROM c JOIN g USING (i)),
wt AS (SELECT sum((e.x[c.i] - c.cv) ^ 2) AS w FROM {_E} e JOIN c ON e.label = c.label)
SELECT round((b / ((SELECT count(DISTINCT label) FROM embeddings) - 1)) / (w / ((SELECT count(*) FROM embeddings) - (SELECT count(DISTINCT label) FROM embeddings))), 4) AS calinski_harabasz FROM bt, wt""")
def q_calinski_harabasz(spark, sf):
    """Between / within dispersion ratio from summaries."""
    return CL.calinski_harabasz(_emb(spark, sf), "label", "x").select(rnd("calinski_harabasz", 4).alias("calinski_harabasz"))


@query("davies_bouldin", f"""WITH {_CENT},
cen AS (SELECT label, list(cv ORDER BY i) AS cx FROM c GROUP BY label),
sp AS (SELECT e.label, avg(list_distance(e.x, cen.cx)) AS s FROM {_E} e JOIN cen USING (label) GROUP BY e.label),
m AS (SELECT a.label, max((sa.s + sb.s) / list_distance(a.cx, b.cx)) AS r FROM cen a JOIN cen b ON a.label <> b.label
      JOIN sp sa ON sa.label = a.label JOIN sp sb ON sb.label = b.label GROUP BY a.label)
SELECT round(avg(r), {D}) AS davies_bouldin FROM m""")
def q_davies_bouldin(spark, sf):
    """Davies-Bouldin index (centroid pairs: k^2 numbers)."""
    return CL.davies_bouldin(_emb(spark, sf), "label", "x").select(rnd("davies_bouldin", D).alias("davies_bouldin"))


@query("kmeans_assign", f"""WITH {_CENT}, cen AS (SELECT label, list(cv ORDER BY i) AS cx FROM c GROUP BY label)
SELECT e.vec_id, arg_min(cen.label, (list_distance(e.x, cen.cx), cen.label)) AS cluster FROM {_E} e, cen GROUP BY e.vec_id""")
def q_kmeans_assign(spark, sf):
    """Assignment of every vector to the nearest of fixed centroids (label means)."""
    e = _emb(spark, sf)
    cents = [(c["label"], c["centroid"]) for c in CL.summaries(e, "label", "x")]
    return CL.assign_nearest(e, "x", cents).select("vec_id", "cluster")


@query("kmeans_train")
def q_kmeans_train(spark, sf):
    """K-means (k=8) and bisecting k-means on the embeddings; sizes and metrics."""
    e = _emb(spark, sf)
    km, _ = CL.kmeans(e, "x", k=8)
    sizes = CL.cluster_sizes(km, "cluster").withColumn("method", F.lit("kmeans"))
    ag = CL.agglomerative(e, "x", k=4)
    return sizes.unionByName(CL.cluster_sizes(ag, "cluster").withColumn("method", F.lit("bisecting")))


@query("pca_variance", f"""WITH s AS (SELECT var_samp(l_quantity) AS a, covar_samp(l_quantity, l_discount * 100) AS b,
  var_samp(l_discount * 100) AS c FROM lineitem),
l AS (SELECT (a + c) / 2 + sqrt(((a - c) / 2) ^ 2 + b * b) AS l1, (a + c) / 2 - sqrt(((a - c) / 2) ^ 2 + b * b) AS l2 FROM s)
SELECT 1 AS component, round(l1 / (l1 + l2), {D}) AS ratio FROM l UNION ALL SELECT 2, round(l2 / (l1 + l2), {D}) FROM l""")
def q_pca_variance(spark, sf):
    """Explained-variance ratios of PCA on centred data (2 features, closed form)."""
    li = t(spark, sf, "lineitem").select("l_quantity", (F.col("l_discount") * 100).alias("l_discount"))
    r = RD.variance_ratio(li, ["l_quantity", "l_discount"], 2)
    return r.select("component", rnd("ratio", D).alias("ratio"))


@query("reconstruction_error")
def q_reconstruction_error(spark, sf):
    """Mean squared reconstruction residual with 2 of 4 components (scaled data)."""
    li = t(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return RD.reconstruction_error(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 2)


@query("isolation_forest")
def q_isolation_forest(spark, sf):
    """Isolation forest (100 trees, 256-row samples, contamination 0.1) on
    order features; anomaly count and ratio."""
    o = t(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    scored = AN.isolation_forest(o, "o_orderkey", ["o_totalprice", "o_custkey"])
    return AN.anomaly_summary(scored)


@query("anomaly_ratio", """SELECT count(*) FILTER (WHERE anomaly) AS anomalies_detected, count(*) AS n,
  round(count(*) FILTER (WHERE anomaly) / count(*), 6) AS outlier_ratio FROM (
  SELECT abs(value - (SELECT avg(value) FROM events)) / (SELECT stddev_samp(value) FROM events) > 3 AS anomaly FROM events)""")
def q_anomaly_ratio(spark, sf):
    """Anomaly count / ratio of a flag column (z-score detector here)."""
    e = t(spark, sf, "events")
    flagged = AN.zscore_flags(e, "value")
    return AN.anomaly_summary(flagged).select("anomalies_detected", "n", rnd("outlier_ratio", 6).alias("outlier_ratio"))


@query("cv_scores")
def q_cv_scores(spark, sf):
    """Stratified 5-fold accuracy of logistic regression (scaler fitted per fold), mean and std."""
    from ..operators.supervised import cross_validate
    d = t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(
        t(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return cross_validate(d, "doc_id", "quality", ["lang", "source", "n_chars"], "classification",
                          "logistic_regression", 5)


@query("model_artifact")
def q_model_artifact(spark, sf):
    """Save a fitted model to the shared folder, load it back, predictions agree."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from ..operators.supervised import load_model, save_model, without_summary
    from ..session import scratch_path
    e = t(spark, sf, "events").select("event_id", (F.col("event_type") == "purchase").cast("double").alias("label"),
                                      "value", "user_id")
    v = VectorAssembler(inputCols=["value", "user_id"], outputCol="features").transform(e)
    m = without_summary(LogisticRegression(maxIter=50).fit(v))
    path = save_model(m, scratch_path(spark, "model-artifact"))
    back = load_model(path, "LogisticRegressionModel")
    a = m.transform(v).select("event_id", F.col("prediction").alias("p1"))
    b = back.transform(v).select("event_id", F.col("prediction").alias("p2"))
    return a.join(b, "event_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p1") == F.col("p2")).alias("equal"))


@query("train_unsupervised")
def q_train_unsupervised(spark, sf):
    """Family routing with per-method error rows."""
    from ..operators.unsupervised import train_unsupervised
    from .q_rules import type_baskets
    o = t(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    feats = ["o_totalprice", "o_custkey"]
    parts = [train_unsupervised(o, "o_orderkey", feats, "clustering", ["kmeans", "agglomerative", "dbscan", "pca"],
                                {"kmeans": {"n_clusters": 4}, "agglomerative": {"n_clusters": 3}})
             .withColumn("family", F.lit("clustering")),
             train_unsupervised(o, "o_orderkey", feats, "dimensionality_reduction").withColumn("family", F.lit("dimensionality_reduction")),
             train_unsupervised(o, "o_orderkey", feats, "anomaly", ["isolation_forest", "one_class_svm"])
             .withColumn("family", F.lit("anomaly")),
             train_unsupervised(type_baskets(spark, sf), "l_orderkey", [], "association", items_col="items",
                                params={"apriori": {"min_support": 0.1, "min_confidence": 0.3}})
             .withColumn("family", F.lit("association"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("results_export")
def q_results_export(spark, sf):
    """One JSON document per run, written as JSON files to the shared folder and read back."""
    from ..operators.results import results_json
    from ..session import scratch_path
    from .q_results import model_results
    path = scratch_path(spark, "results-export")
    results_json(model_results(spark, sf)).write.json(path)
    return spark.read.json(path)


_DB_PTS = "(SELECT event_id AS id, value / 50.0::DOUBLE AS x, user_id / 15.0::DOUBLE AS y FROM events)"


@query("dbscan_core", f"""WITH p AS {_DB_PTS},
pr AS (SELECT a.id, b.id AS qid FROM p a JOIN p b ON b.x BETWEEN a.x - 0.1::DOUBLE AND a.x + 0.1::DOUBLE
       AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.1::DOUBLE * 0.1::DOUBLE),
c AS (SELECT id, count(*) >= 5 AS core FROM pr GROUP BY id),
nc AS (SELECT DISTINCT pr.id FROM pr JOIN c ON pr.qid = c.id WHERE c.core)
SELECT c.id AS event_id, c.core, (NOT c.core AND nc.id IS NOT NULL) AS border,
  (NOT c.core AND nc.id IS NULL) AS noise FROM c LEFT JOIN nc ON c.id = nc.id""")
def q_dbscan_core(spark, sf):
    """DBSCAN core / border / noise roles (eps 0.1, min_samples 5) on (value/50, user/15)."""
    e = t(spark, sf, "events").select("event_id", (F.col("value") / 50.0).alias("x"), (F.col("user_id") / 15.0).alias("y"))
    return CL.dbscan_points(e, "event_id", ["x", "y"], eps=0.1, min_samples=5)


# names spread over the links until a round moves none
@query("dbscan_labels", f"""WITH RECURSIVE p AS {_DB_PTS},
pr AS (SELECT a.id, b.id AS qid FROM p a JOIN p b ON b.x BETWEEN a.x - 0.1::DOUBLE AND a.x + 0.1::DOUBLE
       AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.1::DOUBLE * 0.1::DOUBLE),
core AS (SELECT id FROM pr GROUP BY id HAVING count(*) >= 5),
links AS (SELECT pr.id, qid FROM pr JOIN core a ON a.id = pr.id JOIN core b ON b.id = qid),
lab AS (
  SELECT id, id AS name, TRUE AS moved FROM core
  UNION ALL
  SELECT id, least(name, near), bool_or(near < name) OVER () FROM (
    SELECT l.id, l.name, min(n.name) AS near FROM lab l JOIN links k ON k.id = l.id JOIN lab n ON n.id = k.qid WHERE l.moved GROUP BY l.id, l.name)),
named AS (SELECT id, min(name) AS name FROM lab GROUP BY id),
border AS (SELECT pr.id, min(name) AS name FROM pr JOIN named ON named.id = pr.qid GROUP BY pr.id)
SELECT p.id AS event_id, coalesce(named.name, border.name, -1) AS cluster FROM p LEFT JOIN named USING (id) LEFT JOIN border USING (id)""")
def q_dbscan_labels(spark, sf):
    """DBSCAN cluster labels (least core id; border: least of its neighbours'; noise -1), eps 0.1, min_samples 5."""
    e = t(spark, sf, "events").select("event_id", (F.col("value") / 50.0).alias("x"), (F.col("user_id") / 15.0).alias("y"))
    return CL.dbscan_labels(e, "event_id", ["x", "y"], eps=0.1, min_samples=5)


_KNN_SQL = """WITH e AS (SELECT event_id, event_type, value, user_id, value / 50.0::DOUBLE AS x, user_id / 15.0::DOUBLE AS y FROM events),
d AS (SELECT q.event_id, t.event_type AS c, t.user_id AS u, row_number() OVER (PARTITION BY q.event_id
        ORDER BY 0.0::DOUBLE + (q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y), t.event_id) AS r
      FROM (SELECT * FROM e WHERE event_id % 5 = 0) q, (SELECT * FROM e WHERE event_id % 5 <> 0) t),
n AS (SELECT * FROM d WHERE r <= 5)"""


def _knn_parts(spark, sf):
    e = t(spark, sf, "events").select("event_id", "event_type", F.col("user_id").cast("double").alias("user_id"),
                                      (F.col("value") / 50.0).alias("x"), (F.col("user_id") / 15.0).alias("y"))
    test = F.col("event_id") % 5 == 0  # the rows to predict; the others are the training rows
    return e.filter(~test), e.filter(test)


@query("knn_classify", _KNN_SQL + """,
v AS (SELECT event_id, c, count(*) AS k FROM n GROUP BY ALL)
SELECT event_id, arg_min(c, (-k, c)) AS prediction FROM v GROUP BY event_id""")
def q_knn_classify(spark, sf):
    """M7: class of every fifth event by its five nearest other events, exact (value/50, user/15)."""
    train, test = _knn_parts(spark, sf)
    return KN.classify(train, test, "event_id", ["x", "y"], "event_type", 5)


@query("knn_regress", _KNN_SQL + """
SELECT event_id, round(avg(u), 6) AS prediction FROM n GROUP BY event_id""")
def q_knn_regress(spark, sf):
    """M7: mean target of the five nearest events, exact."""
    train, test = _knn_parts(spark, sf)
    return KN.regress(train, test, "event_id", ["x", "y"], "user_id", 5).select("event_id", rnd("prediction", 6).alias("prediction"))


_NEAR = "(SELECT event_id, c, u, sqrt(d2) AS d, min(d2) OVER (PARTITION BY event_id) AS least FROM n)"
_WEIGHT = "CASE WHEN least = 0 THEN (d = 0)::INT::DOUBLE ELSE 1.0::DOUBLE / d END"
_KNN_WEIGHTED = _KNN_SQL.replace("SELECT q.event_id, t.event_type AS c,", "SELECT q.event_id, 0.0::DOUBLE + (q.x - t.x) * (q.x - t.x) + (q.y - t.y) * (q.y - t.y) AS d2, t.event_type AS c,")


@query("knn_weighted", _KNN_WEIGHTED + f""",
w AS (SELECT *, {_WEIGHT} AS w FROM {_NEAR})
SELECT event_id, round(sum(w * u) / sum(w), 6) AS prediction FROM w GROUP BY event_id""")
def q_knn_weighted(spark, sf):
    """M7: mean target of the five nearest events, weighted by one over the distance."""
    train, test = _knn_parts(spark, sf)
    return KN.regress(train, test, "event_id", ["x", "y"], "user_id", 5, weights="distance").select("event_id", rnd("prediction", 6).alias("prediction"))


LINKED = 10


@query("agglomerative_labels", f"""WITH RECURSIVE c AS (SELECT c_custkey, c_acctbal / 100.0::DOUBLE AS x, c_nationkey::DOUBLE AS y FROM customer),
p AS (SELECT min(c_custkey) AS id, x, y FROM c GROUP BY x, y),
first AS (SELECT * FROM p ORDER BY id LIMIT 1),
prim AS (
  SELECT 0 AS step, p.id, p.x, p.y, sqrt((p.x - f.x) * (p.x - f.x) + (p.y - f.y) * (p.y - f.y)) AS d, least(p.id, f.id) AS a, greatest(p.id, f.id) AS b
  FROM p, first f WHERE p.id <> f.id
  UNION ALL
  SELECT step + 1, id, x, y, CASE WHEN closer THEN nd ELSE d END, CASE WHEN closer THEN na ELSE a END, CASE WHEN closer THEN nb ELSE b END FROM (
    SELECT *, (nd, na, nb) < (d, a, b) AS closer FROM (
      SELECT t.*, sqrt((t.x - c.x) * (t.x - c.x) + (t.y - c.y) * (t.y - c.y)) AS nd, least(t.id, c.id) AS na, greatest(t.id, c.id) AS nb
      FROM prim t, (SELECT id, x, y FROM prim ORDER BY d, a, b LIMIT 1) c WHERE t.id <> c.id))),
tree AS (SELECT d, a, b FROM prim QUALIFY row_number() OVER (PARTITION BY step ORDER BY d, a, b) = 1),
kept AS (SELECT a, b FROM tree ORDER BY d DESC, a DESC, b DESC OFFSET {LINKED - 1}),
ends AS (SELECT a, b FROM kept UNION ALL SELECT b, a FROM kept),
reach AS (SELECT id, id AS r FROM p UNION SELECT reach.id, ends.b FROM reach JOIN ends ON ends.a = reach.r),
named AS (SELECT id, min(r) AS name FROM reach GROUP BY id),
numbered AS (SELECT id, (dense_rank() OVER (ORDER BY name) - 1)::INT AS cluster FROM named)
SELECT c.c_custkey, numbered.cluster FROM c JOIN p ON c.x = p.x AND c.y = p.y JOIN numbered ON numbered.id = p.id""")
def q_agglomerative_labels(spark, sf):
    """Single-linkage clusters of all customers (account balance / 100, nation), exact."""
    return LK.agglomerative_labels(_customers(spark, sf), "c_custkey", ["x", "y"], k=LINKED, linkage="single")[0]


@query("agglomerative_ward")
def q_agglomerative_ward(spark, sf):
    """Sizes of the Ward clusters of all customers, with the stated error."""
    lab, error = LK.agglomerative_labels(_customers(spark, sf), "c_custkey", ["x", "y"], k=5, linkage="ward")
    return CL.cluster_sizes(lab, "cluster").withColumn("error", rnd(F.lit(error), D))


def _customers(spark, sf):
    c = t(spark, sf, "customer")
    return c.select("c_custkey", (F.col("c_acctbal") / 100.0).alias("x"), F.col("c_nationkey").cast("double").alias("y"))


@query("one_class_svm")
def q_one_class_svm(spark, sf):
    """One-class SVM (RBF via random Fourier features, nu 0.5) on order features."""
    o = t(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_custkey")
    s = PR.standard_scale(o, ["o_totalprice", "o_custkey"])
    return AN.anomaly_summary(AN.one_class_svm(s, "o_orderkey", ["o_totalprice", "o_custkey"], nu=0.5))
