"""Profiler rules, correlations and evaluation metrics against brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkprep.operators import correlate as R
from sparkprep.operators import evaluate as E
from sparkprep.operators import profile as P


def test_feature_type_rules(spark):
    n = 100
    pdf = pd.DataFrame({"idlike": np.arange(n), "small_int": np.arange(n) % 7,
                        "price": np.round(np.arange(n) % 40 * 1.5, 2), "d": ["2021-01-02"] * n,
                        "t": ["x", "y"] * (n // 2)})
    types = {r["name"]: r["type"] for r in P.feature_types(spark.createDataFrame(pdf)).collect()}
    assert types == {"idlike": "Categorical", "small_int": "Categorical", "price": "Numeric",
                     "d": "Date/Time", "t": "Categorical"}


def test_quality_issues(spark):
    df = spark.createDataFrame([(1, "a") if i % 2 else (None, "a") for i in range(10)], "x int, s string")
    q = {r["name"]: (r["quality_score"], r["quality_issues"]) for r in P.feature_quality(df).collect()}
    assert q["s"] == (60, "Fair quality; Single value only")
    assert q["x"][1].startswith("Poor quality; Moderate missing data")


def test_describe_matches_pandas(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 2.0, 5.0, None], "b": [3, 1, 4, 1, 5]})
    got = {r["column"]: r for r in P.describe(spark.createDataFrame(pdf)).collect()}
    exp = pdf.describe()
    for c in ("a", "b"):
        assert got[c]["count"] == exp[c]["count"]
        for k, e in (("mean", "mean"), ("std", "std"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%")):
            assert got[c][k] == pytest.approx(round(exp[c][e], 4))


def _tau_b(x, y):
    c = d = tx = ty = 0
    for i, j in itertools.combinations(range(len(x)), 2):
        sx, sy = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
        if sx == 0 and sy == 0:
            continue
        if sx == 0:
            tx += 1
        elif sy == 0:
            ty += 1
        elif sx == sy:
            c += 1
        else:
            d += 1
    return (c - d) / math.sqrt((c + d + tx) * (c + d + ty))


def test_correlations_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 12, 120).astype(float)
    y = (x + rng.integers(0, 6, 120)).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    get = lambda m: {(r["col_x"], r["col_y"]): r["r"] for r in R.correlate(df, ["x", "y"], m, None).collect()}
    assert get("pearson")[("x", "y")] == pytest.approx(np.corrcoef(x, y)[0, 1])
    rx, ry = pd.Series(x).rank(), pd.Series(y).rank()
    assert get("spearman")[("x", "y")] == pytest.approx(np.corrcoef(rx, ry)[0, 1])
    assert get("kendall")[("x", "y")] == pytest.approx(_tau_b(x, y))
    assert get("kendall")[("x", "x")] == pytest.approx(1.0)


def test_constant_column_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "c double, v double")
    got = {(r["col_x"], r["col_y"]): r["r"] for r in R.pearson(df, ["c", "v"]).collect()}
    assert got[("c", "v")] is None


def test_classification_metrics_brute_force(spark):
    t = ["a", "a", "b", "c", "c", "c", "b"]
    p = ["a", "b", "b", "c", "a", "c", "d"]
    df = spark.createDataFrame(list(zip(t, p)), "y_true string, y_pred string")
    m = E.classification_metrics(df).first()
    labels = sorted(set(t) | set(p))
    sup = {l: t.count(l) for l in labels}
    prec = {l: (sum(1 for a, b in zip(t, p) if a == b == l) / p.count(l)) if p.count(l) else 0.0 for l in labels}
    rec = {l: (sum(1 for a, b in zip(t, p) if a == b == l) / sup[l]) if sup[l] else 0.0 for l in labels}
    wp = sum(prec[l] * sup[l] for l in labels) / len(t)
    assert m["accuracy"] == pytest.approx(4 / 7)
    assert m["precision"] == pytest.approx(wp)
    assert m["recall"] == pytest.approx(sum(rec[l] * sup[l] for l in labels) / len(t))
    cm = E.confusion_matrix(df).collect()
    assert len(cm) == len(labels) ** 2 and sum(r["count"] for r in cm) == len(t)


def test_roc_auc_equals_pair_probability(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 200)
    s = np.round(rng.random(200) * 0.5 + y * 0.2, 1)  # many ties
    df = spark.createDataFrame(pd.DataFrame({"y_true": y, "y_score": s}))
    auc = E.roc_auc(df).first()["roc_auc"]
    pos, neg = s[y == 1], s[y == 0]
    exp = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert auc == pytest.approx(exp)
    assert 0 <= E.pr_auc(df).first()["pr_auc"] <= 1


def test_regression_metrics(spark):
    y = np.array([3.0, -0.5, 2.0, 7.0])
    f = np.array([2.5, 0.0, 2.0, 8.0])
    df = spark.createDataFrame(pd.DataFrame({"y_true": y, "y_pred": f}))
    m = E.regression_metrics(df).first()
    assert m["mse"] == pytest.approx(np.mean((y - f) ** 2))
    assert m["r2"] == pytest.approx(1 - np.sum((y - f) ** 2) / np.sum((y - y.mean()) ** 2))
    assert m["median_ae"] == pytest.approx(np.median(np.abs(y - f)))
    qq = E.qq_points(E.residuals(df)).orderBy("position").collect()
    assert [r["sample"] for r in qq] == sorted(y - f)


def test_many_buckets_match_few_buckets(spark, monkeypatch):
    """Results don't depend on the number of order buckets."""
    from sparkprep.operators import scan
    from sparkprep.operators import clean as C
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"id": np.arange(600), "k": rng.integers(0, 4, 600),
                        "v": np.where(rng.random(600) < 0.2, np.nan, rng.normal(size=600).round(2)),
                        "w": rng.integers(0, 30, 600), "s": rng.choice(["a", "b", "c"], 600)})
    df = spark.createDataFrame(pdf).repartition(5)
    from sparkprep.sources.ingest import nan_to_null
    df = nan_to_null(df)
    small_prof = sorted(tuple(r) for r in P.feature_profile(df).collect())
    small_fill = sorted(tuple(r) for r in C.fill_missing(df, "v", "forward_fill", ["id"], by=["k"]).collect())
    small_q = scan.quantile_values(df, ["v", "w"], [0.1, 0.5, 0.9])
    real = scan.choose_buckets
    monkeypatch.setattr(scan, "choose_buckets", lambda df, n_buckets=None: real(df, n_buckets or 37))
    assert sorted(tuple(r) for r in P.feature_profile(df).collect()) == small_prof
    assert sorted(tuple(r) for r in C.fill_missing(df, "v", "forward_fill", ["id"], by=["k"]).collect()) == small_fill
    big_q = scan.quantile_values(df, ["v", "w"], [0.1, 0.5, 0.9])
    for c in ("v", "w"):
        assert np.allclose(big_q[c], small_q[c])


def test_profile_reads_the_value_histogram_once(spark):
    df = spark.createDataFrame([(i, i % 5, None if i % 3 else "a", float(i % 4) if i != 9 else 900.0) for i in range(60)], "k long, g int, t string, v double")
    plan = P.feature_profile(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(array(struct(name, k") == 1
    full = {r["name"]: r for r in P.profile_frame(df).collect()}
    assert {n: (r["nunique"], r["outliers"], r["top"][0]["value"]) for n, r in full.items()} == {
        "k": (60, 0, "0"), "g": (5, 0, "0"), "t": (1, 0, "a"), "v": (5, 1, "0.0")}
    bare = {r["name"]: r.asDict() for r in P.profile_frame(df, top=0).collect()}
    assert bare == {n: {k: v for k, v in r.asDict().items() if k != "top"} for n, r in full.items()}
