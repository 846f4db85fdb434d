"""Evaluation queries (E1-E16, W2, W4, W7) over prediction tables derived
from the given tables:

* binary: events, y_true = purchase, y_score = value / max(value) (4 dp);
* multiclass: events, y_true = event_type, y_pred = a value band, split by user;
* models: the binary score cut at three thresholds (three "models");
* regression: orders, y_true = o_totalprice, y_pred = the order's line total.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import norm_ppf_sql, sig_round, sig_round_sql, rnd
from ..operators import evaluate as E
from .registry import query
from .tables import SCORES_SQL, scores, t

D = 6  # digits compared


def _r(df: DataFrame, digits: int = D) -> DataFrame:
    return df.select(*[rnd(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
                       for f in df.schema.fields])


def multiclass(spark, sf):
    e = t(spark, sf, "events")
    band = (F.when(F.col("value") < 10, "click").when(F.col("value") < 30, "view")
            .when(F.col("value") < 60, "purchase").when(F.col("value") < 100, "signup").otherwise("error"))
    split = F.when(F.col("user_id") % 5 == 0, "test").otherwise("train")
    return e.select(split.alias("split"), F.col("event_type").alias("y_true"), band.alias("y_pred"))


MULTI_SQL = """(SELECT CASE WHEN user_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, event_type AS y_true,
  CASE WHEN value < 10 THEN 'click' WHEN value < 30 THEN 'view' WHEN value < 60 THEN 'purchase'
       WHEN value < 100 THEN 'signup' ELSE 'error' END AS y_pred FROM events)"""

THRESHOLDS = [0.05, 0.1, 0.2]


def models(spark, sf):
    s = scores(spark, sf)
    thr = F.explode(F.array(*[F.struct(F.lit(f"thr_{x}").alias("model"), F.lit(x).alias("thr")) for x in THRESHOLDS]))
    m = s.select("y_true", "y_score", thr.alias("m"))
    return m.select(F.col("m.model").alias("model"), "y_true",
                    (F.col("y_score") >= F.col("m.thr")).cast("int").alias("y_pred"), "y_score")


MODELS_SQL = f"""(SELECT model, y_true, CAST(y_score >= thr AS INTEGER) AS y_pred, y_score
  FROM {SCORES_SQL} s, (VALUES {', '.join(f"('thr_{x}', {x}::DOUBLE)" for x in THRESHOLDS)}) th(model, thr))"""


def dec(c: str):
    """Money columns as exact decimals: sums then do not depend on summation order."""
    return F.col(c).cast("decimal(12,2)")


def line_total():
    return F.sum(dec("l_extendedprice") * (1 + dec("l_tax")) * (1 - dec("l_discount"))).cast("double")


LINE_TOTAL_SQL = ("CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 + CAST(l_tax AS DECIMAL(12,2))) "
                  "* (1 - CAST(l_discount AS DECIMAL(12,2)))) AS DOUBLE)")


def regression(spark, sf):
    li = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(line_total().alias("y_pred"))
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("y_true"))
    return o.join(li, "l_orderkey").select(F.col("l_orderkey").alias("o_orderkey"), "y_true", "y_pred")


REG_SQL = f"""(SELECT o.o_orderkey, o.o_totalprice AS y_true, p.y_pred FROM orders o JOIN
  (SELECT l_orderkey, {LINE_TOTAL_SQL} AS y_pred FROM lineitem GROUP BY l_orderkey) p
  ON o.o_orderkey = p.l_orderkey)"""

_PC_SQL = """cc AS (SELECT {by}y_true AS t, y_pred AS p, count(*) AS c FROM {src} x GROUP BY ALL),
lab AS (SELECT {by}t AS label FROM cc UNION SELECT {by}p FROM cc),
sup AS (SELECT {by}t AS label, sum(c) AS support FROM cc GROUP BY ALL),
prd AS (SELECT {by}p AS label, sum(c) AS predicted FROM cc GROUP BY ALL),
tpq AS (SELECT {by}t AS label, sum(c) AS tp FROM cc WHERE t = p GROUP BY ALL),
pc AS (SELECT {by}label, coalesce(tp, 0)::DOUBLE AS tp, coalesce(support, 0)::DOUBLE AS support,
   coalesce(predicted, 0)::DOUBLE AS predicted FROM lab LEFT JOIN sup USING ({byu}label) LEFT JOIN prd USING ({byu}label)
   LEFT JOIN tpq USING ({byu}label)),
prf AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS prec,
   CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS rec FROM pc),
prf2 AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM prf)"""


def _pc_sql(src, by=None):
    b = f"{by}, " if by else ""
    return _PC_SQL.format(by=b, byu=b, src=src)


def _metrics_sql(src, by):
    return f"""WITH {_pc_sql(src, by)},
m AS (SELECT {by}, CAST(sum(support) AS BIGINT) AS n, sum(tp) AS correct, sum(prec * support) / sum(support) AS precision,
  sum(rec * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1,
  sum(support * predicted) AS tp_sum, sum(predicted * predicted) AS pp, sum(support * support) AS tt FROM prf2 GROUP BY {by})
SELECT {by}, n, round(correct / n, {D}) AS accuracy, round(precision, {D}) AS precision, round(recall, {D}) AS recall,
  round(f1, {D}) AS f1,
  round(CASE WHEN sqrt((n::DOUBLE * n - pp) * (n::DOUBLE * n - tt)) = 0 THEN 0.0
       ELSE (correct * n - tp_sum) / sqrt((n::DOUBLE * n - pp) * (n::DOUBLE * n - tt)) END, {D}) AS mcc,
  round(CASE WHEN tp_sum / (n::DOUBLE * n) = 1 THEN NULL
       ELSE (correct / n - tp_sum / (n::DOUBLE * n)) / (1 - tp_sum / (n::DOUBLE * n)) END, {D}) AS cohen_kappa
FROM m"""


@query("metrics_classification", _metrics_sql(MULTI_SQL, "split"))
def q_metrics_classification(spark, sf):
    """Accuracy, weighted P/R/F1, MCC, kappa for train and test."""
    return _r(E.classification_metrics(multiclass(spark, sf), ["split"]))


@query("metrics_binary", _metrics_sql(MODELS_SQL, "model"))
def q_metrics_binary(spark, sf):
    """E1 for three binary threshold models in one job."""
    return _r(E.classification_metrics(models(spark, sf).drop("y_score"), ["model"]))


@query("mcc", f"SELECT split, mcc FROM ({_metrics_sql(MULTI_SQL, 'split')})")
def q_mcc(spark, sf):
    """E5: Matthews correlation (multiclass form)."""
    return _r(E.classification_metrics(multiclass(spark, sf), ["split"]).select("split", "mcc"))


@query("cohen_kappa", f"SELECT split, cohen_kappa FROM ({_metrics_sql(MULTI_SQL, 'split')})")
def q_cohen_kappa(spark, sf):
    """Cohen's kappa."""
    return _r(E.classification_metrics(multiclass(spark, sf), ["split"]).select("split", "cohen_kappa"))


@query("classification_report", f"""WITH {_pc_sql(MULTI_SQL, 'split')}
SELECT split, label, round(prec, {D}) AS precision, round(rec, {D}) AS recall, round(f1, {D}) AS f1, CAST(support AS BIGINT) AS support FROM prf2
UNION ALL SELECT split, 'macro avg', round(avg(prec), {D}), round(avg(rec), {D}), round(avg(f1), {D}), CAST(sum(support) AS BIGINT) FROM prf2 GROUP BY split
UNION ALL SELECT split, 'weighted avg', round(sum(prec * support) / sum(support), {D}), round(sum(rec * support) / sum(support), {D}),
  round(sum(f1 * support) / sum(support), {D}), CAST(sum(support) AS BIGINT) FROM prf2 GROUP BY split""")
def q_classification_report(spark, sf):
    """Per-class and averaged precision / recall / f1 / support."""
    return _r(E.classification_report(multiclass(spark, sf), ["split"]))


@query("confusion_matrix", f"""
WITH cc AS (SELECT split, y_true AS t, y_pred AS p, count(*) AS c FROM {MULTI_SQL} x GROUP BY ALL),
lab AS (SELECT split, t AS l FROM cc UNION SELECT split, p FROM cc)
SELECT a.split, a.l AS true_label, b.l AS pred_label, CAST(coalesce(cc.c, 0) AS BIGINT) AS count
FROM lab a JOIN lab b ON a.split = b.split LEFT JOIN cc ON cc.split = a.split AND cc.t = a.l AND cc.p = b.l""")
def q_confusion_matrix(spark, sf):
    """Zero-filled confusion matrix over the label union."""
    return E.confusion_matrix(multiclass(spark, sf), ["split"])


@query("log_loss", f"""SELECT round(-avg(y_true * ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, y_score)))
  + (1 - y_true) * ln(1 - greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, y_score)))), {D}) AS log_loss FROM {SCORES_SQL} s""")
def q_log_loss(spark, sf):
    """Binary log loss with clipping."""
    return _r(E.log_loss(scores(spark, sf)))


@query("brier", f"SELECT round(avg((y_score - y_true) * (y_score - y_true)), {D}) AS brier_score FROM {SCORES_SQL} s")
def q_brier(spark, sf):
    """Brier score."""
    return _r(E.brier_score(scores(spark, sf)))


_CUM_SQL = f"""h AS (SELECT y_score AS score, CAST(sum(y_true) AS BIGINT) AS pos, CAST(count(*) - sum(y_true) AS BIGINT) AS neg
  FROM {SCORES_SQL} s WHERE y_score IS NOT NULL GROUP BY 1),
c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS pos_cum,
  sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS neg_cum,
  sum(pos) OVER () AS "P", sum(neg) OVER () AS "N" FROM h)"""


@query("roc_curve", f"""WITH {_CUM_SQL}
SELECT 'inf'::DOUBLE AS threshold, 0.0 AS fpr, 0.0 AS tpr
UNION ALL SELECT score, round(neg_cum / "N", {D}), round(pos_cum / "P", {D}) FROM c""")
def q_roc_curve(spark, sf):
    """ROC points at every distinct score (running sums, no single-task sort)."""
    return E.roc_curve(scores(spark, sf))


# three classes (order status) with probabilities made from the order's price
def class_probs(spark, sf):
    o = t(spark, sf, "orders")
    mx = o.agg(F.max("o_totalprice")).first()[0]
    s = rnd(F.col("o_totalprice") / F.lit(float(mx)), 4)
    cls = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return o.select(cls.alias("y_true"), F.array(s / 2, (1 - s) / 2, F.lit(0.5)).alias("y_prob"))


CLASS_PROBS_SQL = """(SELECT CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS y_true, [s / 2, (1 - s) / 2, 0.5::DOUBLE] AS y_prob
  FROM (SELECT o_orderstatus, round(o_totalprice / (SELECT max(o_totalprice) FROM orders), 4) AS s FROM orders))"""


@query("log_loss_multiclass", f"""SELECT round(-avg(ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, y_prob[y_true + 1])))), {D}) AS log_loss
FROM {CLASS_PROBS_SQL} p""")
def q_log_loss_multiclass(spark, sf):
    """Log loss over three classes."""
    return _r(E.log_loss_multiclass(class_probs(spark, sf)))


@query("roc_auc_ovr", f"""WITH b AS (SELECT CAST(k - 1 AS INTEGER) AS class, CAST(y_true = k - 1 AS INTEGER) AS y, y_prob[k] AS s FROM {CLASS_PROBS_SQL} p, range(1, 4) r(k)),
h AS (SELECT class, s, sum(y) AS pos, count(*) - sum(y) AS neg FROM b GROUP BY class, s),
c AS (SELECT *, sum(pos) OVER w AS pos_cum, sum(pos) OVER (PARTITION BY class) AS p, sum(neg) OVER (PARTITION BY class) AS n FROM h
      WINDOW w AS (PARTITION BY class ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
SELECT class, round(sum((neg / n) * (pos_cum / p + (pos_cum - pos) / p) / 2), {D}) AS roc_auc FROM c GROUP BY class""")
def q_roc_auc_ovr(spark, sf):
    """One-vs-rest ROC area of every class."""
    return _r(E.roc_auc_ovr(class_probs(spark, sf)))


@query("roc_auc", f"""WITH {_CUM_SQL}
SELECT round(sum((neg / "N") * (pos_cum / "P" + (pos_cum - pos) / "P") / 2), {D}) AS roc_auc FROM c""")
def q_roc_auc(spark, sf):
    """Trapezoid ROC AUC."""
    return _r(E.roc_auc(scores(spark, sf)))


@query("pr_curve", f"""WITH {_CUM_SQL}
SELECT score AS threshold, round(pos_cum / (pos_cum + neg_cum), {D}) AS precision, round(pos_cum / "P", {D}) AS recall
FROM c WHERE NOT (pos_cum - pos >= "P")
UNION ALL SELECT NULL, 1.0, 0.0""")
def q_pr_curve(spark, sf):
    """Precision-recall points down to full recall, plus (0, 1)."""
    return E.pr_curve(scores(spark, sf))


@query("pr_auc", f"""WITH {_CUM_SQL}
SELECT round(sum((pos / "P") * (pos_cum / (pos_cum + neg_cum)
  + CASE WHEN (pos_cum - pos) + (neg_cum - neg) > 0 THEN (pos_cum - pos) / ((pos_cum - pos) + (neg_cum - neg)) ELSE 1.0 END) / 2), {D}) AS pr_auc
FROM c WHERE NOT (pos_cum - pos >= "P")""")
def q_pr_auc(spark, sf):
    """Trapezoid PR AUC (recall on x)."""
    return _r(E.pr_auc(scores(spark, sf)))


@query("lift_chart", f"""WITH {_CUM_SQL}
SELECT score AS threshold, round((pos_cum + neg_cum) / ("P" + "N"), {D}) AS percent_samples,
  round(pos_cum / "P", {D}) AS percent_positives,
  round((pos_cum / "P") / ((pos_cum + neg_cum) / ("P" + "N")), {D}) AS lift FROM c""")
def q_lift_chart(spark, sf):
    """Cumulative gain and lift at every distinct score."""
    return E.lift_chart(scores(spark, sf))


@query("roc_auc_by_model", f"""WITH s AS {MODELS_SQL},
h AS (SELECT model, y_pred AS score, CAST(sum(y_true) AS BIGINT) AS pos, CAST(count(*) - sum(y_true) AS BIGINT) AS neg FROM s GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS pos_cum,
  sum(pos) OVER (PARTITION BY model) AS "P", sum(neg) OVER (PARTITION BY model) AS "N" FROM h)
SELECT model, round(sum((neg / "N") * (pos_cum / "P" + (pos_cum - pos) / "P") / 2), {D}) AS roc_auc FROM c GROUP BY model""")
def q_roc_auc_by_model(spark, sf):
    """E9 per model (keyed running sums): AUC of each thresholded model's hard prediction."""
    return _r(E.roc_auc(models(spark, sf), ["model"], y_score="y_pred"))


_REG_M = f"""SELECT count(*) AS n, avg((y_true - y_pred) * (y_true - y_pred)) AS mse, avg(abs(y_true - y_pred)) AS mae,
  avg(abs(y_true - y_pred) / greatest(abs(y_true), 2.220446049250313e-16)) AS mape,
  quantile_cont(abs(y_true - y_pred), 0.5) AS median_ae, sum((y_true - y_pred) * (y_true - y_pred)) AS ss_res,
  var_pop(y_true) AS var_y, var_pop(y_true - y_pred) AS var_e FROM {REG_SQL} r"""


@query("metrics_regression", f"""WITH a AS ({_REG_M}),
b AS (SELECT *, CASE WHEN var_y * n = 0 THEN (CASE WHEN ss_res = 0 THEN 1.0 ELSE 0.0 END) ELSE 1 - ss_res / (var_y * n) END AS r2,
  CASE WHEN var_y = 0 THEN (CASE WHEN var_e = 0 THEN 1.0 ELSE 0.0 END) ELSE 1 - var_e / var_y END AS ev FROM a)
SELECT n, {sig_round_sql('mse')} AS mse, round(sqrt(mse), {D}) AS rmse, round(mae, {D}) AS mae, round(r2, {D}) AS r2, round(mape, {D}) AS mape,
  round(median_ae, {D}) AS median_ae, round(ev, {D}) AS explained_variance,
  round(CASE WHEN n > 2 THEN 1 - (1 - r2) * (n - 1) / (n - 1 - 1) ELSE r2 END, {D}) AS adjusted_r2 FROM b""")
def q_metrics_regression(spark, sf):
    """Regression metrics (adjusted R^2 with p = 1)."""
    m = E.regression_metrics(regression(spark, sf))
    return _r(m).withColumn("mse", sig_round(F.col("mse")))


@query("residuals", f"SELECT o_orderkey, y_pred, y_true - y_pred AS residual FROM {REG_SQL} r")
def q_residuals(spark, sf):
    """residual = y - y_hat per prediction (exact decimal line totals, no rounding needed)."""
    return E.residuals(regression(spark, sf), keep=["o_orderkey"])


@query("qq_points", f"""SELECT CAST(position AS BIGINT) AS position, round({norm_ppf_sql('((position + 0.5) / n)')}, {D}) AS theoretical, sample
FROM (SELECT row_number() OVER (ORDER BY residual) - 1 AS position, count(*) OVER () AS n, residual AS sample
  FROM (SELECT y_true - y_pred AS residual FROM {REG_SQL} r))""")
def q_qq_points(spark, sf):
    """Sorted residuals against normal quantiles of (i + 0.5) / n."""
    r = E.residuals(regression(spark, sf))
    q = E.qq_points(r)
    return q.select(F.col("position").cast("long").alias("position"), rnd("theoretical", D).alias("theoretical"), "sample")


def _summary_sql():
    m = _metrics_sql(MODELS_SQL, "model")
    auc = f"""WITH s AS {MODELS_SQL},
h AS (SELECT model, y_score AS score, CAST(sum(y_true) AS BIGINT) AS pos, CAST(count(*) - sum(y_true) AS BIGINT) AS neg FROM s GROUP BY 1, 2),
c AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS pos_cum,
  sum(pos) OVER (PARTITION BY model) AS "P", sum(neg) OVER (PARTITION BY model) AS "N" FROM h)
SELECT model, sum((neg / "N") * (pos_cum / "P" + (pos_cum - pos) / "P") / 2) AS auc FROM c GROUP BY model"""
    return f"""WITH m AS ({m}), a AS ({auc}),
best AS (SELECT m.*, a.auc FROM m JOIN a USING (model) ORDER BY accuracy DESC, model LIMIT 1)
SELECT model AS best_model_name,
  CASE WHEN accuracy >= 0.9 THEN 'Excellent' WHEN accuracy >= 0.8 THEN 'Good' WHEN accuracy >= 0.7 THEN 'Fair' ELSE 'Poor' END AS performance_level,
  printf('%.1f%%', round(accuracy * 100, 1)) AS accuracy_text, printf('%.1f%%', round(precision * 100, 1)) AS precision_text,
  printf('%.1f%%', round(recall * 100, 1)) AS recall_text, printf('%.1f%%', round(f1 * 100, 1)) AS f1_text,
  printf('%.3f', round(auc, 3)) AS auc_text,
  CASE WHEN precision = 0 OR recall = 0 THEN 'Unknown' WHEN abs(precision - recall) < 0.05 THEN 'Well balanced'
       WHEN precision > recall THEN 'Precision-focused' ELSE 'Recall-focused' END AS balance_assessment,
  (SELECT count(*) FROM m) AS total_models_trained,
  array_to_string(list_filter([
    CASE WHEN accuracy < 0.8 THEN '{E.REC_LOW_ACCURACY[0]}' END, CASE WHEN accuracy < 0.8 THEN '{E.REC_LOW_ACCURACY[1]}' END,
    CASE WHEN accuracy < 0.8 THEN '{E.REC_LOW_ACCURACY[2]}' END,
    CASE WHEN precision <> 0 AND recall <> 0 AND abs(precision - recall) > 0.1 AND precision > recall THEN '{E.REC_LOW_RECALL}' END,
    CASE WHEN precision <> 0 AND recall <> 0 AND abs(precision - recall) > 0.1 AND precision <= recall THEN '{E.REC_LOW_PRECISION}' END,
    CASE WHEN f1 <> 0 AND f1 < 0.75 THEN '{E.REC_F1}' END,
    CASE WHEN accuracy < 0.9 THEN '{E.REC_NOT_EXCELLENT[0]}' END, CASE WHEN accuracy < 0.9 THEN '{E.REC_NOT_EXCELLENT[1]}' END
  ], lambda x: x IS NOT NULL)[1:5], ' | ') AS recommendations
FROM best"""


@query("performance_summary", _summary_sql())
def q_performance_summary(spark, sf):
    """Best model by accuracy, level, balance, formatted metrics, first five recommendations."""
    from ..operators.results import best_by
    mdl = models(spark, sf)
    m = E.classification_metrics(mdl.drop("y_score"), ["model"])
    auc = E.roc_auc(mdl, ["model"])
    # one row per model: the model count is a window over that small table
    m = m.withColumn("total_models_trained", F.count(F.lit(1)).over(Window.partitionBy()))
    best = best_by(m.join(auc, "model"), "accuracy", tiebreak="model")
    fmt = lambda c: F.format_string("%.1f%%", rnd(F.col(c) * 100, 1))
    acc, p, r, f1 = F.col("accuracy"), F.col("precision"), F.col("recall"), F.col("f1")
    return best.select(
        F.col("model").alias("best_model_name"), E.performance_level(acc).alias("performance_level"),
        fmt("accuracy").alias("accuracy_text"), fmt("precision").alias("precision_text"),
        fmt("recall").alias("recall_text"), fmt("f1").alias("f1_text"),
        F.format_string("%.3f", rnd("roc_auc", 3)).alias("auc_text"),
        E.balance_assessment(p, r).alias("balance_assessment"),
        F.col("total_models_trained").cast("long").alias("total_models_trained"),
        F.array_join(E.recommendations(acc, p, r, f1), " | ").alias("recommendations"))
