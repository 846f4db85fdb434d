"""Evaluation metrics and curves from one prediction DataFrame.

Input: rows with ``y_true``, ``y_pred`` and (for curves) ``y_score``; an
optional ``by`` list (e.g. ``split`` = train/test or the algorithm) evaluates
every group in the same job.

* Classification metrics come from the confusion counts
  ``groupBy(by, y_true, y_pred).count()`` — k^2 rows per group, however many
  predictions there are.
* ROC / PR / lift come from the score histogram ``groupBy(y_score)`` plus a
  two-level running sum in descending score order; the area under a curve is
  one aggregate because the previous point of every threshold is its own
  running sum minus its own counts.
"""

from __future__ import annotations

import functools
import operator
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import named, norm_ppf, quoted, rnd
from ..session import materialize
from . import scan

MEDIAN_BRACKET = [0.48, 0.52]  # quantiles, good to 1 / 10000, that enclose both middle values of any number of rows
EPS = sys.float_info.epsilon  # float64 machine epsilon (clip / MAPE guard)


# ---------------------------------------------------------------- confusion based
def confusion_counts(pred: DataFrame, by: list[str] | None = None, y_true="y_true", y_pred="y_pred") -> DataFrame:
    by = list(by or [])
    return (pred.select(*named(by), quoted(y_true).cast("string").alias("t"), quoted(y_pred).cast("string").alias("p"))
            .groupBy(*named(by), "t", "p").agg(F.count(F.lit(1)).alias("c")))


def _per_class(cc: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, tp, support, predicted) over the union of true and predicted labels."""
    tp = cc.filter(F.col("t") == F.col("p")).groupBy(*named(by), F.col("t").alias("label")).agg(F.sum("c").alias("tp"))
    sup = cc.groupBy(*named(by), F.col("t").alias("label")).agg(F.sum("c").alias("support"))
    prd = cc.groupBy(*named(by), F.col("p").alias("label")).agg(F.sum("c").alias("predicted"))
    keys = by + ["label"]
    j = sup.join(prd, keys, "full").join(tp, keys, "left")
    return j.select(*named(keys), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "support", "predicted")])


def _prf(pc: DataFrame) -> DataFrame:
    p = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    out = pc.withColumn("precision", p).withColumn("recall", r)
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0)
    return out.withColumn("f1", f1)


def classification_report(pred: DataFrame, by: list[str] | None = None, **kw) -> DataFrame:
    """Per class precision / recall / f1 / support, plus macro and weighted averages."""
    by = list(by or [])
    pc = _prf(_per_class(confusion_counts(pred, by, **kw), by))
    per = pc.select(*named(by), "label", "precision", "recall", "f1", F.col("support").cast("long").alias("support"))
    tot = F.sum("support")
    macro = pc.groupBy(*named(by)).agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                                F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), tot.cast("long").alias("support"))
    weighted = pc.groupBy(*named(by)).agg(
        F.lit("weighted avg").alias("label"),
        (F.sum(F.col("precision") * F.col("support")) / tot).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / tot).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / tot).alias("f1"), tot.cast("long").alias("support"))
    return per.unionByName(macro).unionByName(weighted)


def classification_metrics(pred: DataFrame, by: list[str] | None = None, **kw) -> DataFrame:
    """accuracy and weighted precision / recall / f1 (zero division -> 0), MCC, Cohen's kappa."""
    by = list(by or [])
    cc = confusion_counts(pred, by, **kw)
    pc = _prf(_per_class(cc, by))
    n = F.sum("support")
    agg = pc.groupBy(*named(by)).agg(
        n.cast("long").alias("n"), F.sum("tp").cast("double").alias("correct"),
        (F.sum(F.col("precision") * F.col("support")) / n).alias("precision"),
        (F.sum(F.col("recall") * F.col("support")) / n).alias("recall"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("f1"),
        F.sum(F.col("support").cast("double") * F.col("predicted")).alias("tp_sum"),
        F.sum(F.col("predicted").cast("double") ** 2).alias("pp"),
        F.sum(F.col("support").cast("double") ** 2).alias("tt"))
    s = F.col("n").cast("double")
    mcc_den = F.sqrt((s * s - F.col("pp")) * (s * s - F.col("tt")))
    mcc = F.when(mcc_den == 0, F.lit(0.0)).otherwise((F.col("correct") * s - F.col("tp_sum")) / mcc_den)
    po = F.col("correct") / s
    pe = F.col("tp_sum") / (s * s)
    kappa = F.when(pe == 1, F.lit(None).cast("double")).otherwise((po - pe) / (1 - pe))
    return agg.select(*named(by), "n", (F.col("correct") / s).alias("accuracy"), "precision", "recall", "f1",
                      mcc.alias("mcc"), kappa.alias("cohen_kappa"))


def confusion_matrix(pred: DataFrame, by: list[str] | None = None, **kw) -> DataFrame:
    """Long zero-filled matrix (by, true_label, pred_label, count) over the label union."""
    by = list(by or [])
    cc = confusion_counts(pred, by, **kw)
    labels = (cc.select(*named(by), F.col("t").alias("l")).unionByName(cc.select(*named(by), F.col("p").alias("l")))
              .filter(F.col("l").isNotNull()).distinct())
    # the label set of a group is small (number of classes): build the k x k grid per group
    lists = labels.groupBy(*named(by)).agg(F.array_sort(F.collect_set("l")).alias("ls"))
    grid = lists.select(*named(by), F.explode("ls").alias("true_label"), "ls").select(
        *by, "true_label", F.explode("ls").alias("pred_label"))
    cnt = cc.select(*named(by), F.col("t").alias("true_label"), F.col("p").alias("pred_label"), "c")
    j = grid.join(cnt, by + ["true_label", "pred_label"], "left")
    return j.select(*named(by), "true_label", "pred_label", F.coalesce("c", F.lit(0)).cast("long").alias("count"))


def f1_from_pr(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r))


# ---------------------------------------------------------------- probability based
def log_loss(pred: DataFrame, by=None, y_true="y_true", y_score="y_score") -> DataFrame:
    """Binary log loss with probabilities clipped to [eps, 1 - eps]."""
    by = list(by or [])
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), quoted(y_score).cast("double")))
    y = quoted(y_true).cast("double")
    return pred.groupBy(*named(by)).agg((-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def brier_score(pred: DataFrame, by=None, y_true="y_true", y_score="y_score") -> DataFrame:
    by = list(by or [])
    return pred.groupBy(*named(by)).agg(F.avg((quoted(y_score) - quoted(y_true)) ** 2).alias("brier_score"))


def log_loss_multiclass(pred: DataFrame, by=None, y_true="y_true", y_prob="y_prob") -> DataFrame:
    """Log loss over any number of classes: ``y_prob`` holds a probability per
    class in class order, ``y_true`` the class number; probabilities are scaled to
    sum to 1 and clipped to [eps, 1 - eps]."""
    by = list(by or [])
    total = F.aggregate(y_prob, F.lit(0.0), lambda a, x: a + x)
    p = F.try_divide(F.get(quoted(y_prob), quoted(y_true).cast("int")), total)
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.coalesce(p, F.lit(0.0))))
    return pred.groupBy(*named(by)).agg((-F.avg(F.log(p))).alias("log_loss"))


def one_vs_rest(pred: DataFrame, keep: list[str] | None = None, y_true="y_true", y_prob="y_prob") -> DataFrame:
    """A binary row (class, y_true, y_score) per row and class: input of the ROC and PR functions with by=[.., 'class']."""
    return (pred.select(*(keep or []), quoted(y_true).alias("_c"), F.posexplode(y_prob).alias("class", "y_score"))
            .select(*(keep or []), "class", (F.col("_c").cast("int") == F.col("class")).cast("int").alias("y_true"), "y_score"))


def roc_auc_ovr(pred: DataFrame, by=None, y_true="y_true", y_prob="y_prob") -> DataFrame:
    """One-vs-rest area under the ROC curve of every class (null if it or its rest has no row)."""
    by = list(by or [])
    return roc_auc(one_vs_rest(pred, by, y_true, y_prob), [*by, "class"])


def _score_cum(pred: DataFrame, by, y_true, y_score) -> DataFrame:
    """Per distinct score (desc): pos, neg, cumulative tps / fps, totals P / N."""
    by = list(by or [])
    h = pred.filter(quoted(y_score).isNotNull()).groupBy(*named(by), quoted(y_score).alias("score")).agg(
        F.sum(quoted(y_true).cast("long")).alias("pos"), F.count(F.lit(1)).alias("cnt"))
    # read for the splitters, the totals and the result
    h = materialize(h.withColumn("neg", F.col("cnt") - F.col("pos")), "score-histogram")
    tot = h.groupBy(*named(by)).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    nb = scan.choose_buckets(pred)
    h = scan.prefix_sums(h, ["score"], ["pos", "neg"], partition_cols=by, descending=True, n_buckets=nb)
    if by:
        return h.join(tot, by)  # one row per group
    r = tot.first()  # two scalars
    return h.withColumn("P", F.lit(r["P"] if r else 0)).withColumn("N", F.lit(r["N"] if r else 0))


def roc_curve(pred: DataFrame, by=None, y_true="y_true", y_score="y_score", digits: int = 6) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, plus the (inf, 0, 0) start point."""
    by = list(by or [])
    h = _score_cum(pred, by, y_true, y_score)
    pts = h.select(*named(by), F.col("score").cast("double").alias("threshold"),
                   rnd(F.col("neg_cum") / F.col("N"), digits).alias("fpr"),
                   rnd(F.col("pos_cum") / F.col("P"), digits).alias("tpr"))
    start = h.select(*named(by)).distinct().select(*named(by), F.lit(float("inf")).alias("threshold"),
                                             F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(pts)


def roc_auc(pred: DataFrame, by=None, y_true="y_true", y_score="y_score") -> DataFrame:
    """Trapezoid area under the ROC curve (one aggregate over the score histogram)."""
    by = list(by or [])
    h = _score_cum(pred, by, y_true, y_score)
    prev_tpr = (F.col("pos_cum") - F.col("pos")) / F.col("P")
    tpr = F.col("pos_cum") / F.col("P")
    area = (F.col("neg") / F.col("N")) * (tpr + prev_tpr) / 2
    return h.groupBy(*named(by)).agg(F.sum(area).alias("roc_auc"))


def pr_curve(pred: DataFrame, by=None, y_true="y_true", y_score="y_score", digits: int = 6) -> DataFrame:
    """(threshold, precision, recall) from the highest score down to the first
    threshold with full recall, plus the (recall 0, precision 1) end point."""
    by = list(by or [])
    h = _score_cum(pred, by, y_true, y_score)
    full_before = (F.col("pos_cum") - F.col("pos")) >= F.col("P")  # full recall reached at a higher score
    pts = h.filter(~full_before).select(
        *by, F.col("score").cast("double").alias("threshold"),
        rnd(F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum")), digits).alias("precision"),
        rnd(F.col("pos_cum") / F.col("P"), digits).alias("recall"))
    end = h.select(*named(by)).distinct().select(*named(by), F.lit(None).cast("double").alias("threshold"),
                                           F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(end)


def pr_auc(pred: DataFrame, by=None, y_true="y_true", y_score="y_score") -> DataFrame:
    """Trapezoid area under the PR curve (recall on x), as ``auc(recall, precision)``."""
    by = list(by or [])
    h = _score_cum(pred, by, y_true, y_score)
    full_before = (F.col("pos_cum") - F.col("pos")) >= F.col("P")
    prev_tp = F.col("pos_cum") - F.col("pos")
    prev_all = prev_tp + F.col("neg_cum") - F.col("neg")
    prev_prec = F.when(prev_all > 0, prev_tp / prev_all).otherwise(F.lit(1.0))
    prec = F.col("pos_cum") / (F.col("pos_cum") + F.col("neg_cum"))
    area = (F.col("pos") / F.col("P")) * (prec + prev_prec) / 2
    return h.filter(~full_before).groupBy(*named(by)).agg(F.sum(area).alias("pr_auc"))


def lift_chart(pred: DataFrame, by=None, y_true="y_true", y_score="y_score", digits: int = 6) -> DataFrame:
    """Cumulative gain at every distinct score (desc): % samples, % positives, lift."""
    by = list(by or [])
    h = _score_cum(pred, by, y_true, y_score)
    n = F.col("P") + F.col("N")
    pct_s = (F.col("pos_cum") + F.col("neg_cum")) / n
    pct_p = F.col("pos_cum") / F.col("P")
    return h.select(*named(by), F.col("score").cast("double").alias("threshold"),
                    rnd(pct_s, digits).alias("percent_samples"), rnd(pct_p, digits).alias("percent_positives"),
                    rnd(pct_p / pct_s, digits).alias("lift"))


# ---------------------------------------------------------------- regression
def regression_metrics(pred: DataFrame, by=None, y_true="y_true", y_pred="y_pred", p: int = 1) -> DataFrame:
    """MSE, RMSE, MAE, R^2, MAPE (fraction), median AE, explained variance, adjusted R^2."""
    by = list(by or [])
    y, f = quoted(y_true).cast("double"), quoted(y_pred).cast("double")
    e = y - f
    a = pred.groupBy(*named(by)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"),
        F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(EPS))).alias("mape"),
        F.sum(e * e).alias("ss_res"), F.var_pop(y).alias("var_y"), F.var_pop(e).alias("var_e"),
        F.percentile_approx(F.abs(e), MEDIAN_BRACKET, 10000).alias("_bracket"))
    a = materialize(a, "regression-sums")
    # exact medians of all groups from one histogram of the errors: no task holds a group's values. What lies
    # outside a bracket around the median counts as the bracket's end, which leaves the median as it is
    name = F.to_json(F.struct(*[quoted(c) for c in by])) if by else F.lit("all")
    ends = a.select(*[quoted(c).alias(f"_g{i}") for i, c in enumerate(by)], F.col("_bracket")[0].alias("_lo"), F.col("_bracket")[1].alias("_hi"))
    errors = pred.select(*[quoted(c).alias(f"_e{i}") for i, c in enumerate(by)], F.abs(e).alias("v")).filter(F.col("v").isNotNull())
    same = functools.reduce(operator.and_, [F.col(f"_e{i}").eqNullSafe(F.col(f"_g{i}")) for i in range(len(by))], F.lit(True))
    of = F.to_json(F.struct(*[F.col(f"_g{i}").alias(c) for i, c in enumerate(by)])) if by else F.lit("all")
    hist = (errors.join(ends.withColumn("name", of), same).select("name", F.greatest("_lo", F.least("_hi", "v")).alias("v"))
            .groupBy("name", "v").agg(F.count(F.lit(1)).alias("c")))
    hist = materialize(hist, "error-histogram")  # read for the splitters and the running counts
    med = scan.quantiles_from_hist(hist, [0.5], scan.choose_buckets(pred)).select(F.col("name").alias("_group"), F.col("value").alias("median_ae"))
    a = a.withColumn("_group", name).join(med, "_group", "left")
    n = F.col("n")
    ss_tot = F.col("var_y") * n
    r2 = (F.when(ss_tot == 0, F.when(F.col("ss_res") == 0, 1.0).otherwise(0.0))
          .otherwise(1 - F.col("ss_res") / ss_tot))
    ev = (F.when(F.col("var_y") == 0, F.when(F.col("var_e") == 0, 1.0).otherwise(0.0))
          .otherwise(1 - F.col("var_e") / F.col("var_y")))
    adj = F.when(n > p + 1, 1 - (1 - F.col("r2")) * (n - 1) / (n - p - 1)).otherwise(F.col("r2"))
    out = a.select(*named(by), "n", "mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"), "mape", "median_ae",
                   ev.alias("explained_variance"))
    return out.withColumn("adjusted_r2", adj)


def residuals(pred: DataFrame, y_true="y_true", y_pred="y_pred", keep: list[str] | None = None) -> DataFrame:
    return pred.select(*(keep or []), quoted(y_pred).alias("y_pred"),
                       (quoted(y_true) - quoted(y_pred)).alias("residual"))


def qq_points(resid: DataFrame, col: str = "residual", by=None) -> DataFrame:
    """(position, theoretical, sample): sorted residuals against normal quantiles
    of (i + 0.5) / n. Positions come from the residual histogram and a running
    count; tied values are expanded to one point per row."""
    by = list(by or [])
    h = materialize(scan.value_histogram(resid, col, by, "c"), "residual-histogram")  # read for the splitters, the count and the result
    total = None if by else h.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    nb = scan.choose_buckets(resid)
    h = scan.prefix_sums(h, [col], ["c"], by, n_buckets=nb)
    if by:
        h = h.join(h.groupBy(*named(by)).agg(F.sum("c").alias("n")), by)
    else:
        h = h.withColumn("n", F.lit(total))
    pts = h.select(*named(by), col, "n", F.explode(F.sequence(F.col("c_cum") - F.col("c"), F.col("c_cum") - 1)).alias("position"))
    return pts.select(*named(by), "position", norm_ppf((F.col("position") + 0.5) / F.col("n")).alias("theoretical"),
                      quoted(col).alias("sample"))


# ---------------------------------------------------------------- summaries
# Performance levels, balance labels and recommendation texts.
LEVELS = [(0.9, "Excellent"), (0.8, "Good"), (0.7, "Fair")]
LEVEL_FALLBACK = "Poor"
REC_LOW_ACCURACY = ["Consider feature engineering to improve overall model performance",
                    "Try ensemble methods or different algorithms",
                    "Collect more training data if possible"]
REC_LOW_RECALL = ("Model has low recall - consider adjusting classification threshold to catch more positive cases")
REC_LOW_PRECISION = ("Model has low precision - consider adjusting classification threshold to reduce false positives")
REC_F1 = "F1 score indicates room for improvement in precision-recall balance"
REC_NOT_EXCELLENT = ["Perform hyperparameter tuning to optimize model performance",
                     "Consider addressing class imbalance if present in the dataset"]


def performance_level(acc: Column) -> Column:
    out = F.lit(LEVEL_FALLBACK)
    for thr, name in reversed(LEVELS):
        out = F.when(acc >= thr, F.lit(name)).otherwise(out)
    return out


def balance_assessment(p: Column, r: Column) -> Column:
    known = p.isNotNull() & r.isNotNull() & (p != 0) & (r != 0)
    return (F.when(~known, F.lit("Unknown")).when(F.abs(p - r) < 0.05, F.lit("Well balanced"))
            .when(p > r, F.lit("Precision-focused")).otherwise(F.lit("Recall-focused")))


def recommendations(acc: Column, p: Column, r: Column, f1: Column) -> Column:
    """The first five applicable recommendation texts, in rule order."""
    acc0 = F.coalesce(acc, F.lit(0.0))
    pr_known = p.isNotNull() & r.isNotNull() & (p != 0) & (r != 0)
    items = [F.when(acc0 < 0.8, F.lit(t)) for t in REC_LOW_ACCURACY]
    items.append(F.when(pr_known & (F.abs(p - r) > 0.1) & (p > r), F.lit(REC_LOW_RECALL)))
    items.append(F.when(pr_known & (F.abs(p - r) > 0.1) & (p <= r), F.lit(REC_LOW_PRECISION)))
    items.append(F.when(f1.isNotNull() & (f1 != 0) & (f1 < 0.75), F.lit(REC_F1)))
    items += [F.when(acc0 < 0.9, F.lit(t)) for t in REC_NOT_EXCELLENT]
    return F.slice(F.filter(F.array(*items), lambda x: x.isNotNull()), 1, 5)
