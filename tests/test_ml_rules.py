"""Preparation, splits, clustering metrics, rules and detections."""

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkprep.operators import cluster as CL
from sparkprep.operators import detections as DT
from sparkprep.operators import groupby as G
from sparkprep.operators import prep as PR
from sparkprep.operators import rules as AR


def _labelled(spark, n=1000, parts=7):
    cls = ["a"] * 600 + ["b"] * 300 + ["c"] * 100
    return spark.createDataFrame(list(zip(range(n), cls)), "id int, y string").repartition(parts)


def test_stratified_split_exact_shares(spark):
    out = PR.stratified_split(_labelled(spark), "id", "y", 0.2).groupBy("y", "split").count().collect()
    got = {(r["y"], r["split"]): r["count"] for r in out}
    assert got[("a", "test")] == 120 and got[("b", "test")] == 60 and got[("c", "test")] == 20


def test_split_partition_independent(spark):
    a = {r["id"]: r["split"] for r in PR.stratified_split(_labelled(spark, parts=1), "id", "y").collect()}
    b = {r["id"]: r["split"] for r in PR.stratified_split(_labelled(spark, parts=37), "id", "y").collect()}
    assert a == b


def test_split_cuts_by_two_levels_of_few_buckets(spark, monkeypatch):
    import hashlib
    sizes, cutoff = [], PR._cutoff
    monkeypatch.setattr(PR, "_cutoff", lambda counts, *rest: sizes.append(counts.count()) or cutoff(counts, *rest))
    df = spark.range(20000).select("id", F.when(F.col("id") % 50 == 0, "b").when(F.col("id") % 50 > 1, "a").alias("y"))
    for label in (None, "y"):
        for share in (0.0, 0.2, 0.37, 1.0):
            got = {r["id"]: r["split"] for r in PR.stratified_split(df, "id", label, share).collect()}
            classes = [range(20000)] if label is None else [[i for i in range(20000) if i % 50 == 0], [i for i in range(20000) if i % 50 > 1]]
            test = {i for c in classes for i in sorted(c, key=lambda i: (hashlib.md5(f"42{i}".encode()).hexdigest(), i))[:int(len(c) * share + 0.5)]}
            assert len(got) == 20000 and {i for i, s in got.items() if s == "test"} == test
    # one window orders the buckets of a class: no more than 4096, however many rows it has
    assert sizes and max(sizes) <= 3 * 4096


def test_prepared_rows_are_split_once(spark, monkeypatch):
    from sparkprep.operators import supervised as S
    plans, fit = [], PR.fit_scaler
    monkeypatch.setattr(PR, "fit_scaler", lambda df, cols: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or fit(df, cols))
    df = spark.createDataFrame([(i, float(i % 7), "ab"[i % 2], 2.0 * (i % 7) + i % 2) for i in range(200)], "id long, x double, g string, y double")
    S.feature_importance(df, "id", "y", ["x", "g"], "regression", "ridge", {"alpha": 1.0})
    S.train_models(df, "id", "y", ["x", "g"], "regression", ["ridge"])
    S.cross_validate(df, "id", "y", ["x", "g"], "regression", "ridge", 2, {"alpha": 1.0}, method="shuffle")
    assert len(plans) == 4 and not any("Window" in p for p in plans)


def test_fold_sizes_balanced(spark):
    f = PR.assign_folds(_labelled(spark), "id", "y", 5).groupBy("y", "fold").count().toPandas()
    assert (f.groupby("y")["count"].agg(lambda s: s.max() - s.min()) <= 1).all()


def test_scaler_population_std(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "x double")
    vals = [r["x"] for r in PR.standard_scale(df, ["x"]).collect()]
    exp = (np.array([1, 2, 3, 4]) - 2.5) / np.std([1, 2, 3, 4])
    assert np.allclose(vals, exp)


def test_basket_rules_hand_checked(spark):
    lines = [(1001, "Milk"), (1001, "Bread"), (1001, "Butter"), (1002, "Milk"), (1002, "Bread"),
             (1003, "Milk"), (1003, "Butter"), (1003, "Eggs"), (1004, "Bread"), (1004, "Butter"), (1004, "Eggs"),
             (1005, "Milk"), (1005, "Bread"), (1005, "Butter"), (1005, "Eggs"), (1005, "Eggs")]
    df = spark.createDataFrame(lines, "InvoiceID int, Item string")
    fi = AR.frequent_itemsets(G.baskets(df, "InvoiceID", "Item"), 0.2)
    rules = AR.association_rules(fi, 0.0).collect()
    get = {(tuple(r["antecedents"]), tuple(r["consequents"])): r for r in rules}
    assert get[(("Eggs",), ("Butter",))]["confidence"] == pytest.approx(1.0)
    assert get[(("Eggs",), ("Butter",))]["lift"] == pytest.approx(1.25)
    assert get[(("Milk",), ("Bread",))]["confidence"] == pytest.approx(0.75)
    assert get[(("Milk",), ("Bread",))]["lift"] == pytest.approx(0.9375)
    # every split of a 3-item set is present
    assert (("Bread", "Milk"), ("Butter",)) in get and (("Butter",), ("Bread", "Milk")) in get


def test_silhouette_sq_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (20, 3)), rng.normal(4, 1, (15, 3)), rng.normal(-4, 1, (1, 3))])
    lab = [0] * 20 + [1] * 15 + [2]
    df = spark.createDataFrame([(int(l), [float(v) for v in row]) for l, row in zip(lab, x)], "label int, x array<double>")
    got = CL.silhouette_sq(df, "label", "x").first()[0]
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    lab = np.array(lab)
    s = []
    for i in range(len(x)):
        own = lab == lab[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    assert got == pytest.approx(np.mean(s))


def test_detections_fallback(spark):
    det = spark.createDataFrame([("i1", 0, 0, 0.9, 0.0, 0.0, 10.7, 5.2), ("i1", 1, 1, 0.1, 0.0, 0.0, 1.0, 1.0),
                                 ("i2", 2, 7, 0.2, 1.5, 2.5, 4.0, 9.9), ("i2", 3, 0, 0.15, 0.0, 0.0, 1.0, 1.0)],
                                "image_id string, box_id int, class_id int, confidence double, x1 double, y1 double, "
                                "x2 double, y2 double")
    names = DT.class_names_frame(spark, {0: "person", 1: "bicycle"})
    out = {r["box_id"]: r for r in DT.postprocess(det, names, 0.25).collect()}
    assert set(out) == {0, 2}
    assert out[2]["name"] == "Class_7 (Low Confidence)" and (out[2]["w"], out[2]["h"]) == (2, 7)
    assert out[0]["w"] == 10


def test_dbscan_roles_with_hot_cell(spark):
    rng = np.random.default_rng(4)
    pts = np.vstack([np.zeros((60, 2)) + 0.01 * rng.random((60, 2)),      # one hot cell
                     rng.random((80, 2)) * 3.0])                            # scattered
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id int, x double, y double")
    got = {r["id"]: (r["core"], r["border"], r["noise"]) for r in CL.dbscan_points(df, "id", ["x", "y"], 0.3, 5).collect()}
    d2 = ((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1)
    nb = (d2 <= 0.09).sum(1)
    core = nb >= 5
    for i in range(len(pts)):
        border = (not core[i]) and bool(((d2[i] <= 0.09) & core).any())
        assert got[i] == (bool(core[i]), border, (not core[i]) and not border)


def test_image_source_and_detector(spark, tmp_path):
    from sparkprep.sources.images import detect_images, read_images
    (tmp_path / "a.png").write_bytes(b"12345")
    (tmp_path / "notes.txt").write_bytes(b"not an image")
    (tmp_path / "big.png").write_bytes(b"x" * 100)
    imgs = read_images(spark, str(tmp_path), max_bytes=50)
    assert [r["path"].rsplit("/", 1)[1] for r in imgs.collect()] == ["a.png"]
    boxes = detect_images(imgs, lambda: lambda content: [(len(content), 0.5, 0, 1, 2, 3)]).collect()
    assert [tuple(b)[1:] for b in boxes] == [(0, 5, 0.5, 0.0, 1.0, 2.0, 3.0)]


def _points(spark, n=400, missing=0):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 2))
    x[:10] += 8
    rows = [(i, float(a), None if i >= n - missing else float(b)) for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "id long, a double, b double")


def test_isolation_forest_scores_every_row(spark):
    from sparkprep.operators import anomaly as A
    df = _points(spark, missing=25)
    out = {r["id"]: r for r in A.isolation_forest(df, "id", ["a", "b"], contamination=0.05).collect()}
    assert len(out) == 400
    assert sum(r["anomaly"] for r in out.values()) == 20
    assert np.mean([out[i]["score"] for i in range(10)]) > np.quantile([r["score"] for r in out.values()], 0.97)


def test_one_class_svm_scores_every_row(spark):
    from sparkprep.operators import anomaly as A
    out = A.one_class_svm(_points(spark, missing=25), "id", ["a", "b"], nu=0.2, n_components=20, iterations=40).collect()
    share = np.mean([r["anomaly"] for r in out])
    assert len(out) == 400 and 0.02 < share < 0.5


def test_one_class_svm_stores_no_features(spark, monkeypatch):
    """F8: what the steps read again is the points, not n_components numbers a row; decisions are those of the features."""
    from sparkprep.operators import anomaly as A
    stored = []
    monkeypatch.setattr(A, "materialize", lambda df, name, keep=A.materialize: stored.append(df.columns) or keep(df, name))
    for kernel in ("rbf", "linear"):
        out = A.one_class_svm(_points(spark), "id", ["a", "b"], nu=0.2, kernel=kernel, n_components=20, iterations=15)
        assert out.columns == ["id", "decision", "anomaly"] and out.count() == 400
    assert stored and all(len(c) == 3 for c in stored)
    rng = np.random.default_rng(4)
    x, W, b, w = rng.normal(size=(50, 2)), rng.normal(size=(20, 2)), rng.normal(size=20), rng.normal(size=20)
    z = np.cos(x @ W.T + b) * 0.5
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in x.T], names=["x0", "x1"])
    monkeypatch.setattr(A, "SVM_ROWS", 7)
    got = next(A._svm_sums(iter([batch, batch]), w, 0.1, W, b, 0.5))
    below = z @ w < 0.1
    assert got["cnt"][0].as_py() == 2 * below.sum() and np.allclose(got["s"][0].as_py(), 2 * z[below].sum(axis=0))


def test_feature_importance_of_linear_and_multiclass_models(spark):
    from sparkprep.operators import supervised as S
    rng = np.random.default_rng(1)
    rows = [(i, float(v), float(rng.normal()), "abc"[0 if v < -0.4 else 1 if v < 0.4 else 2], 50 * float(v)) for i, v in enumerate(rng.normal(size=300))]
    df = spark.createDataFrame(rows, "id long, signal double, noise double, cls string, y double")
    for algo, target, kind in (("gradient_boosting", "cls", "classification"), ("logistic_regression", "cls", "classification"), ("ridge", "y", "regression")):
        params = {"n_estimators": 5} if algo == "gradient_boosting" else {}
        got = S.feature_importance(df, "id", target, ["signal", "noise"], kind, algo, params).collect()
        assert got[0]["feature"] == "signal" and got[0]["importance"] > 2 * got[1]["importance"]
    ridge = S.feature_importance(df, "id", "y", ["signal", "noise"], "regression", "ridge", {"alpha": 1.0}).first()
    assert abs(ridge["importance"] / (50 * np.std([r[1] for r in rows])) - 1) < 0.1
    with pytest.raises(ValueError):
        S.validate_params("random_forest", {"min_samples_split": 1})


def test_comparison_follows_the_metrics_direction(spark):
    from sparkprep.operators import results as R
    rows = [("p", "A", a, "regression", "test", "rmse", v, "t", None) for a, v in (("x", 1.0), ("y", 9.0))] + [("p", "B", "x", "regression", "test", "rmse", 5.0, "t", None)]
    rows += [("p", m, "kmeans", "clustering", None, "silhouette_score", v, "t", None) for m, v in (("C", 0.4), ("D", 0.6))]
    rows += [("p", "E", "isolation_forest", "anomaly", None, "outlier_ratio", 0.1, "t", None), ("p", "F", "apriori", "association", None, "rules_count", 7.0, "t", None)]
    df = spark.createDataFrame(rows, "project_id string, model_id string, algorithm string, problem_type string, split string, metric string, value double, created_at string, error string")
    r = R.compare_models(df, "A", "B").first()
    assert (r["value_a"], r["value_b"], r["winner"]) == (1.0, 5.0, "A")
    r = R.compare_models(df, "C", "D").first()
    assert (r["metric"], r["winner"]) == ("silhouette_score", "B")
    assert {r["model_id"] for r in R.best_metric(df).collect()} == set("ABCDEF")
    assert {r["model_id"]: r["display_score"] for r in R.display_score(df).collect()}.items() >= {"C": 40.0, "E": 10.0, "F": 70.0}.items()


@pytest.mark.parametrize("eps, scale", [(0.3, 1.0), (0.12, 1.0), (0.5, 3.0)])
def test_dbscan_labels_by_brute_force(spark, eps, scale):
    rng = np.random.default_rng(11)
    pts = np.concatenate([rng.normal(c, 0.25, (90, 2)) for c in ((0, 0), (1.2, 0), (0, 3), (4, 4))] + [rng.uniform(-2, 6, (60, 2))]) * scale
    pts[:40] = pts[0]  # many equal points
    ids = rng.permutation(len(pts)) + 10
    got = {r["id"]: r["cluster"] for r in CL.dbscan_labels(
        spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in zip(ids, pts)], "id long, a double, b double"), "id", ["a", "b"], eps, 5).collect()}
    near = ((pts[:, None] - pts[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= 5
    label = np.where(core, ids, 10 ** 9)
    while True:
        new = np.where(core, np.where(near & core[None], label[None], 10 ** 9).min(1), label)
        if (new == label).all():
            break
        label = new
    border = np.where(near & core[None], label[None], 10 ** 9).min(1)
    want = {int(i): int(x) if c else int(b) if b < 10 ** 9 else -1 for i, x, c, b in zip(ids, label, core, border)}
    assert got == want and len(set(want.values())) > 3


@pytest.mark.parametrize("d, k", [(1, 3), (2, 5), (4, 7)])
def test_neighbours_by_brute_force(spark, monkeypatch, d, k):
    from sparkprep.operators import knn
    monkeypatch.setattr(knn, "LEAF_ROWS", 8)
    rng = np.random.default_rng(d)
    x = np.concatenate([rng.normal(size=(250, d)).round(1), rng.uniform(-9, 9, (60, d)), np.ones((80, d)) * 0.5])
    q = np.concatenate([rng.normal(size=(60, d)).round(1), rng.uniform(-20, 20, (20, d)), np.ones((1, d)) * 0.5])
    cols = [f"f{i}" for i in range(d)]
    frame = lambda a, first: spark.createDataFrame([(first + i, *map(float, r)) for i, r in enumerate(a)], "id long, " + ", ".join(f"{c} double" for c in cols))
    got = {(r["query"], r["rank"]): r["neighbour"] for r in knn.neighbours(frame(x, 0), frame(q, 1000), "id", cols, k).collect()}
    want = {}
    for i, v in enumerate(q):
        d2 = np.zeros(len(x))
        for j in range(d):
            d2 = d2 + (v[j] - x[:, j]) * (v[j] - x[:, j])
        for rank, j in enumerate(np.lexsort((np.arange(len(x)), d2))[:k], 1):
            want[1000 + i, rank] = int(j)
    assert got == want
    few = knn.neighbours(frame(x[:2], 0), frame(q[:3], 1000), "id", cols, k).collect()
    assert len(few) == 6


def test_training_with_neighbours_and_probabilities(spark):
    from sparkprep.operators import evaluate as E
    from sparkprep.operators import supervised as S
    rng = np.random.default_rng(4)
    rows = [(i, float(a), "xyz"[0 if a < -0.5 else 1 if a < 0.5 else 2]) for i, a in enumerate(rng.normal(size=240))]
    df = spark.createDataFrame(rows, "id long, a double, cls string")
    pred, metrics = S.train_models(df, "id", "cls", ["a"], "classification", ["knn", "logistic_regression", "nothing"])
    got = {(r["algorithm"], r["split"]): r["value"] for r in metrics.filter("metric = 'accuracy'").collect()}
    assert got["knn", "test"] > 0.9 and got["logistic_regression", "test"] > 0.6
    assert [r["algorithm"] for r in metrics.filter("error IS NOT NULL").collect()] == ["nothing"]
    assert pred.filter("algorithm = 'knn'").count() == 240
    prob = pred.filter("algorithm = 'logistic_regression'")
    p = np.array([r["y_prob"][int(r["y_true"])] for r in prob.collect()])
    assert abs(E.log_loss_multiclass(prob).first()[0] + np.log(p).mean()) < 1e-9
    auc = {r["class"]: r["roc_auc"] for r in E.roc_auc_ovr(prob).collect()}
    assert set(auc) == {0, 1, 2} and auc[0] > 0.9 and auc[2] > 0.9
    folds = S.cross_validate(df, "id", "cls", ["a"], "classification", "logistic_regression", 3, method="shuffle").collect()
    assert [r["fold"] for r in folds] == ["0", "1", "2", "mean", "std"]
