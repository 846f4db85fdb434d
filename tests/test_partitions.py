"""Balls, nearest neighbours, linkages, whole-key ordering, quoted CSV and wide one-hot features."""

import collections
import csv
import datetime
import decimal
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkprep.operators import clean, graph, knn, linkage, scan, sparse, supervised
from sparkprep.sources import ingest, records


def frame(spark, x, names="abcdefghijklmnopqrstuvwxyz"):
    cols = list(names[:x.shape[1]])
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, " + ", ".join(f"{c} double" for c in cols)), cols


# ------------------------------------------------------------------ nearest neighbours
@pytest.mark.parametrize("n,d,leaf", [(400, 20, 32), (900, 2, 16), (30, 3, 128)])
def test_neighbours_by_brute_force(spark, n, d, leaf):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(size=(n, d)), 1 if d < 4 else 3)
    x[n // 4: n // 3] = x[0]  # copies
    df, cols = frame(spark, x)
    got = knn.neighbours(df.filter("id % 3 <> 0"), df.filter("id % 3 = 0"), "id", cols, 7, leaf_rows=leaf).collect()
    of = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        of[r["query"]].append(r["neighbour"])
    for q in range(0, n, 3):
        want = sorted((sum((float(a) - float(b)) ** 2 for a, b in zip(x[q], x[i], strict=True)), i) for i in range(n) if i % 3)[:7]
        assert of[q] == [i for _, i in want]


def test_distance_weights(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(200, 2)), 1)
    df, cols = frame(spark, x)
    df = df.withColumn("t", (F.col("id") % 11).cast("double"))
    got = {r["id"]: r["prediction"] for r in knn.regress(df.filter("id >= 50"), df.filter("id < 50"), "id", cols, "t", 4, weights="distance").collect()}
    for q in range(50):
        near = sorted((float(((x[q] - x[i]) ** 2).sum()), i) for i in range(50, 200))[:4]
        d = np.sqrt([a for a, _ in near])
        w = (d == 0).astype(float) if d.min() == 0 else 1 / d
        assert got[q] == pytest.approx(float((w * [i % 11 for _, i in near]).sum() / w.sum()))
    with pytest.raises(ValueError):
        knn.regress(df, df, "id", cols, "t", 4, weights="other")


def test_codes_count_as_their_vectors_do(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(rng.normal()), int(rng.integers(4)), int(rng.integers(3))) for i in range(150)]
    df = spark.createDataFrame(rows, "id long, a double, c long, e long").withColumn("c", F.when(F.col("id") % 10 != 0, F.col("c")))
    got = knn.neighbours(df, df, "id", ["a"], 3, leaf_rows=16, codes=["c", "e"]).collect()
    vec = np.array([[a, *np.eye(4)[c] * (i % 10 != 0), *np.eye(3)[e]] for i, a, c, e in rows])
    for r in got:
        q = r["query"]
        d = sorted(((vec[q] - vec[i]) ** 2).sum() for i in range(150))
        assert r["distance"] ** 2 == pytest.approx(d[r["rank"] - 1], abs=1e-9)


# ------------------------------------------------------------------ linkages
def brute_linkage(x, k, kind):
    groups = [[i] for i in range(len(x))]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))

    def gap(a, b):
        if kind == "ward":
            return len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()
        part = d[np.ix_(a, b)]
        return part.min() if kind == "single" else part.max() if kind == "complete" else part.mean()

    while len(groups) > k:
        _, i, j = min((gap(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups[:i]))
        groups[j] += groups[i]
        del groups[i]
    return sorted(sorted(g) for g in groups)


def groups_of(labels, key="id"):
    out = collections.defaultdict(list)
    for r in labels.collect():
        out[r["cluster"]].append(r[key])
    assert [min(out[c]) for c in sorted(out)] == sorted(min(g) for g in out.values())  # numbered by least key
    return sorted(sorted(g) for g in out.values())


@pytest.mark.parametrize("kind", linkage.LINKAGES)
def test_linkages_by_brute_force(spark, kind):
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(size=(20, 3)) + c for c in ([0, 0, 0], [5, 0, 0], [0, 6, 1], [4, 4, 4])])
    x[7] = x[3]
    df, cols = frame(spark, x)
    labels, error = linkage.agglomerative_labels(df, "id", cols, 5, kind)
    assert error == 0.0 and groups_of(labels) == brute_linkage(x, 5, kind)


def test_single_linkage_of_many_points(spark):
    x = np.round(np.random.default_rng(0).normal(size=(2000, 2)), 2)
    df, cols = frame(spark, x)
    first = {}
    for i, v in enumerate(map(tuple, x)):
        first.setdefault(v, i)
    at = np.array(list(first))
    ids = np.array(list(first.values()))
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(2))
    part = list(range(2000))

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    links = []
    i, j = np.triu_indices(len(at), 1)
    for w, a, b in sorted(zip(d[i, j], np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), strict=True)):
        if root(a) != root(b):
            part[max(root(a), root(b))] = min(root(a), root(b))
            links.append((w, a, b))
            if len(links) == len(at) - 1:
                break
    part = list(range(2000))
    for _, a, b in links[:len(at) - 12]:
        part[max(root(a), root(b))] = min(root(a), root(b))
    want = collections.defaultdict(list)
    for i, v in enumerate(map(tuple, x)):
        want[root(first[v])].append(i)
    labels, _ = linkage.agglomerative_labels(df, "id", cols, 12, "single")
    assert groups_of(labels) == sorted(want.values())


def test_features_state_their_error(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(100, 2)) * 0.2 + c for c in ([0, 0], [5, 0], [0, 6])])
    df, cols = frame(spark, x)
    labels, error = linkage.agglomerative_labels(df, "id", cols, 3, "ward", max_features=40)
    assert 0 < error < 1 and groups_of(labels) == brute_linkage(x[::1], 3, "single")
    with pytest.raises(ValueError):
        linkage.agglomerative_labels(df, "id", cols, 3, "median")
    assert linkage.agglomerative_labels(df.limit(0), "id", cols, 3, "ward")[0].collect() == []
    assert linkage.agglomerative_labels(df.limit(0), "id", cols, 3, "single")[0].collect() == []


# ------------------------------------------------------------------ order by the whole key
def test_buckets_follow_the_whole_key(spark):
    rnd = random.Random(1)
    rows = [(i, datetime.date(2020, 1, 1), rnd.choice([None, 1.5, float("nan"), -0.0, 2.0]), bytes([1, 2, rnd.randrange(256)]),
             rnd.choice(["x" * 50 + c for c in "abcdé"] + [None, ""]), datetime.datetime(2021, 1, 1) + datetime.timedelta(microseconds=rnd.randrange(10 ** 12)),
             decimal.Decimal(rnd.randrange(1000)), [rnd.randrange(3), rnd.randrange(50)], (rnd.randrange(2), f"q{rnd.randrange(40)}"), (1 << 60) + rnd.randrange(2000))
            for i in range(1500)]
    schema = "id long, d date, f double, b binary, s string, ts timestamp, dec decimal(20,6), arr array<int>, st struct<a:int,b:string>, `big.x` long"
    df = spark.createDataFrame(rows, schema).withColumn("ntz", F.col("ts").cast("timestamp_ntz"))
    for cols in (["d", "id"], ["b"], ["f", "id"], ["s", "id"], ["ntz", "id"], ["dec"], ["arr"], ["st"], ["big.x"], ["d", "s", "b", "id"]):
        for descending in (False, True):
            out = scan.add_order_bucket(df, cols, descending, 8)
            order = [F.col(f"`{c}`").desc_nulls_last() if descending else F.col(f"`{c}`").asc_nulls_first() for c in cols]
            buckets = [r[0] for r in out.orderBy(*order).select(scan.BUCKET_COL).collect()]
            assert buckets == sorted(buckets)
            sizes = collections.Counter(buckets).values()
            assert len(sizes) == 8 and max(sizes) < 600  # the day's rows spread


def test_fill_under_one_leading_value(spark):
    """All rows of one day: every bucket gets a share, and the result is pandas'."""
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"day": 1, "id": rng.permutation(3000), "v": np.where(rng.random(3000) < 0.7, np.nan, rng.normal(size=3000))})
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double")))
    out = scan.carry_fill(df, "v", ["day", "id"], out_col="f", n_buckets=6).toPandas().sort_values("id")
    want = pdf.sort_values("id")["v"].ffill().to_numpy()
    assert np.array_equal(out["f"].to_numpy(dtype=float), want, equal_nan=True)
    plan = scan.carry_fill(df, "v", ["day", "id"], out_col="f", n_buckets=6)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_long_texts_are_cut_behind_their_first_difference(spark):
    df = spark.createDataFrame([("p" * 3000 + f"{i:04d}" + "q" * 3000,) for i in range(400)], "s string")
    splits = scan._splitters(df, ["s"], 8)
    assert len(splits) == 7 and max(len(s) for s, in splits) <= 3004
    assert len(scan._splitters(spark.createDataFrame([(f"{i:04d}" + "q" * 3000,) for i in range(400)], "s string"), ["s"], 8)[0][0]) <= 4


# ------------------------------------------------------------------ CSV
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_with_line_ends_in_quotes(spark, tmp_path, end):
    rnd = random.Random(2)
    cells = ["plain", "with, comma", "line\nend", "two\n\nlines, and \"quotes\"", "", "é中", "NA", "x\r\ny", "\n", "a\"\"\"", "long " * 300]
    rows = [[i, rnd.choice(cells), round(rnd.random(), 3), rnd.choice(cells), rnd.choice(["True", "False"])] for i in range(300)]
    for name in ("one.csv", "two.csv"):
        with open(tmp_path / name, "w", newline="") as f:
            w = csv.writer(f, lineterminator=end)
            w.writerow(["id", "te xt", "num.x", "more", "flag"])
            w.writerows(rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        got = ingest.read_csv_tolerant(spark, str(tmp_path / "one.csv")).toPandas().sort_values("id").reset_index(drop=True)
        both = ingest.read_csv_tolerant(spark, str(tmp_path)).count()
        starts = records.lines_of(spark, str(tmp_path / "one.csv")).select("start").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    want = pd.read_csv(tmp_path / "one.csv")
    assert starts > 20 and both == 600 and list(got.columns) == list(want.columns)
    for c in want.columns:
        assert got[c].where(got[c].notna(), None).tolist() == want[c].where(want[c].notna(), None).tolist()


def test_csv_ragged_empty_and_repeated_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,a,,b\n1,2\n\n3,4,5,6\n"7\n8",,x,1.5\n')
    got = ingest.read_csv_tolerant(spark, str(tmp_path / "a.csv"))
    assert got.dtypes == [("a", "string"), ("a.1", "bigint"), ("Unnamed: 2", "string"), ("b", "double")]
    assert sorted(map(tuple, got.collect())) == [("1", 2, None, None), ("3", 4, "5", 6.0), ("7\n8", None, "x", 1.5)]
    (tmp_path / "b.csv").write_text("")
    assert ingest.read_csv_tolerant(spark, str(tmp_path / "b.csv")).collect() == []


def test_written_tables_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, ' two "quoted"\nlines ', 1.5), (2, "x;y", None)], "id long, t string, v double")
    for fmt in ("parquet", "csv", "json"):
        path = ingest.write_table(df, str(tmp_path / fmt), fmt)
        back = ingest.read_csv_tolerant(spark, path) if fmt == "csv" else spark.read.format(fmt).load(path)
        assert sorted(map(tuple, back.select("id", "t", "v").collect())) == sorted(map(tuple, df.collect()))


# ------------------------------------------------------------------ one-hot features
def test_wide_onehot_is_encoded_and_trained_on(spark):
    n = 12_000
    df = spark.range(n).select("id", F.concat(F.lit("v"), "id").alias("w.x"), (F.col("id") % 7).cast("double").alias("num"), (F.col("id") % 7 > 3).cast("int").alias("y"))
    v = clean.encode(df, "w.x", "onehot_vector").orderBy("id").collect()
    order = {t: i for i, t in enumerate(sorted(f"v{i}" for i in range(n)))}
    assert all(r["w.x_onehot"].size == n and list(r["w.x_onehot"].indices) == [order[f"v{r.id}"]] for r in v[:200])
    train = df.withColumnRenamed("w.x", "w")
    _, metrics = supervised.train_models(train, "id", "y", ["w", "num"], "classification", ["logistic_regression"], {"logistic_regression": {"max_iter": 20}})
    scores = {(r["split"], r["metric"]): r["value"] for r in metrics.collect()}
    assert scores["test", "accuracy"] > 0.95


def test_places_and_names_of_an_encoder(spark):
    df = spark.createDataFrame([(1, "b", 2.0, True), (2, "a", 0.0, False), (3, None, None, None)], "id long, t string, n double, f boolean")
    enc = sparse.fit(df, ["t", "n", "f"])
    rows = {r["id"]: r["features"].toArray().tolist() for r in enc.vectors(df, ["id"]).collect()}
    assert rows[1] == [2.0, 1.0, 0.0, 1.0] and rows[2] == [0.0, 0.0, 1.0, 0.0] and np.isnan(rows[3][:2]).all()
    assert enc.names([0, 3, 2]) == {0: "n", 3: "t_b", 2: "t_a"}


def test_every_classifier_by_default(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    df, cols = frame(spark, x)
    df = df.withColumns({"y": (F.col("a") + F.col("b") > 0).cast("int"), "t": F.when(F.col("id") % 2 == 0, "p").otherwise("q")})
    few = {"random_forest": {"n_estimators": 3, "max_depth": 3}, "gradient_boosting": {"n_estimators": 3}, "xgboost": {"n_estimators": 3}, "knn": {"weights": "distance"}}
    _, metrics = supervised.train_models(df, "id", "y", [*cols, "t"], "classification", params=few)
    rows = metrics.collect()
    assert {r["algorithm"] for r in rows} == set(supervised.CLASSIFIERS) and "knn" in supervised.CLASSIFIERS and not any(r["error"] for r in rows)
    assert next(r["value"] for r in rows if (r["algorithm"], r["split"], r["metric"]) == ("knn", "train", "accuracy")) == 1.0


def test_texts_of_nan_are_missing(spark):
    df = spark.createDataFrame([("1.5",), ("nan",), ("NaN",), ("x",), (None,)], "v string")
    out = clean.convert_type(df, "v", "float")
    assert [r["v"] for r in out.collect()] == [1.5, None, None, None, None]
    assert clean.fit_fill_value(out, "v", "median") == 1.5 == clean.fit_fill_value(out, "v", "mean")
    wild = spark.createDataFrame([(float("nan"), 1), (1.0, 2), (2.0, 3)], "v double, w long")
    assert [r["w_cum"] for r in scan.prefix_sums(wild, ["v"], ["w"], n_buckets=3).orderBy("v").collect()] == [2, 5, 6]


# ------------------------------------------------------------------ density clusters
@pytest.mark.parametrize("d,eps,least", [(6, 1.3, 4), (2, 0.25, 5), (1, 0.05, 3)])
def test_density_clusters_by_brute_force(spark, d, eps, least):
    from sparkprep.operators import cluster
    rng = np.random.default_rng(d)
    x = np.vstack([rng.normal(size=(120, d)) * 0.5, rng.normal(size=(80, d)) * 0.6 + 3.0, rng.uniform(-4, 6, size=(60, d))])
    x[10:30] = x[9]  # copies fill a cell
    df, cols = frame(spark, x)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) <= eps
    core = near.sum(1) >= least
    name = np.arange(len(x))
    changed = True
    while changed:
        new = np.array([min(name[j] for j in np.flatnonzero(near[i] & core)) if core[i] else name[i] for i in range(len(x))])
        changed = (new != name).any()
        name = new
    want = {i: int(name[i]) if core[i] else min((int(name[j]) for j in np.flatnonzero(near[i] & core)), default=-1) for i in range(len(x))}
    got = {r["id"]: r["cluster"] for r in cluster.dbscan_labels(df, "id", cols, eps, least).collect()}
    assert got == want and len(set(want.values())) > 2


# ------------------------------------------------------------------ rules and versions
def test_items_with_any_character_and_order_by_lift(spark):
    from sparkprep.operators import rules
    baskets = [["a|b", "c"], ["a", "b"], ["a", "b", "c"], ["a|b", "a", "b"], ["c"], ["a|b", "c"], ["a", "b", "a|b", "c"]]
    fi = rules.frequent_itemsets(spark.createDataFrame([(b,) for b in baskets], "items array<string>"), 0.1)
    got = [(tuple(r["antecedents"]), tuple(r["consequents"]), r["support"], r["confidence"], r["lift"]) for r in rules.association_rules(fi, 0.0).collect()]
    n = len(baskets)
    share = lambda s: sum(set(s) <= set(b) for b in baskets) / n
    assert len(got) == len({g[:2] for g in got}) > 20
    for a, c, s, conf, lift in got:
        assert s == pytest.approx(share(a + c)) and conf == pytest.approx(share(a + c) / share(a)) and lift == pytest.approx(share(a + c) / share(a) / share(c))
    assert [g[4] for g in got] == sorted((g[4] for g in got), reverse=True)


def test_rules_of_plain_features(spark):
    from sparkprep.operators import rules, unsupervised
    df = spark.createDataFrame([(i, i % 2, float(i), "x" if i < 6 else "y") for i in range(12)], "id long, `flag.1` int, v double, t string")
    baskets = rules.onehot_to_baskets(df.select("id", "`flag.1`", (F.col("v") > 3).cast("int").alias("big")), "id")
    assert {r["id"]: r["items"] for r in baskets.collect()} == {i: [c for c, on in (("big", i > 3), ("flag.1", i % 2)) if on] for i in range(12)}
    out = unsupervised.train_unsupervised(df.withColumnRenamed("flag.1", "flag"), "id", ["flag", "v", "t"], "association", params={"apriori": {"min_support": 0.2}}).collect()
    assert {r["metric"] for r in out} == {"rules_count", "max_lift", "frequent_itemsets_count"} and not any(r["error"] for r in out)


def test_two_writers_get_two_versions(spark, tmp_path):
    import threading
    from sparkprep.sources import versions
    root, got, errors = str(tmp_path), [], []
    start = threading.Barrier(4)

    def save(i):
        try:
            start.wait()
            got.append(versions.save_version(spark.range(i + 1).toDF("x"), root, "d", f"writer {i}"))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=save, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and sorted(got) == [1, 2, 3, 4]
    rows = versions.list_versions(spark, root, "d").collect()
    assert sorted((r["changes"], r["rows"]) for r in rows) == [(f"writer {i}", i + 1) for i in range(4)]
    assert sorted(versions.read_version(spark, root, "d", v).count() for v in got) == [1, 2, 3, 4]
    assert not versions._create(spark, f"{root}/d/_manifest/{1:012d}.json", "taken")
    assert versions.manifest(spark, root, "d").count() == 4


def test_kendall_of_many_values(spark):
    """tau-b by all pairs, with ties, nulls and columns of hardly any equal values."""
    from sparkprep.operators import correlate
    rng = np.random.default_rng(8)
    x = np.column_stack([rng.normal(size=300), np.round(rng.normal(size=300), 1), rng.integers(0, 4, 300)])
    x[:, 1] += np.round(x[:, 0], 1)
    df, cols = frame(spark, x)
    df = df.withColumn("b", F.when(F.col("id") % 11 != 0, F.col("b")))
    got = {(r["col_x"], r["col_y"]): r["r"] for r in correlate.kendall(df, cols, digits=None).collect()}
    x[::11, 1] = np.nan
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            both = x[~np.isnan(x[:, [i, j]]).any(axis=1)][:, [i, j]]
            u, v = (np.sign(both[:, k][:, None] - both[:, k][None, :]) for k in (0, 1))
            assert got[a, b] == pytest.approx((u * v).sum() / np.sqrt((u * u).sum() * (v * v).sum()))


def test_distances_of_few_dimensions(spark):
    """place by place to the same doubles as the loop over arrays, codes too, without a function over arrays."""
    from sparkprep.operators import balls
    rng = np.random.default_rng(5)
    rows = [([float(v) for v in rng.normal(size=3)] + [float(c) for c in rng.integers(-1, 2, 2)] for _ in range(2)) for _ in range(200)]
    df = spark.createDataFrame([tuple(r) for r in rows], "x array<double>, y array<double>")
    for numbers in (None, 3):
        both = df.select(balls.distance2(F.col("x"), F.col("y"), numbers).alias("a"), balls.distance2(F.col("x"), F.col("y"), numbers, 5).alias("b"))
        assert all(r["a"] == r["b"] for r in both.collect())
    plan = df.select(balls.distance2(F.col("x"), F.col("y"), 3, 5))._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "zip_with(" not in plan
    tree = balls.build(spark.createDataFrame([(i, [float(i), 0.0]) for i in range(20)], "id long, x array<double>"), dims=2)
    assert tree.dims == 2


def test_medians_from_few_errors(spark, monkeypatch):
    """the median error of every group is exact, and only errors near it are told apart."""
    from sparkprep.operators import evaluate
    rng = np.random.default_rng(6)
    rows = [(g, float(a), float(b)) for g, n in (("a", 1000), ("b", 2), ("c", 1), (None, 501)) for a, b in rng.normal(size=(n, 2))]
    df = spark.createDataFrame([*rows, ("d", None, 1.0)], "g string, y_true double, y_pred double")
    kept = {}
    monkeypatch.setattr(evaluate, "materialize", lambda d, name, keep=evaluate.materialize: kept.setdefault(name, keep(d, name)))
    got = {r["g"]: r["median_ae"] for r in evaluate.regression_metrics(df, ["g"]).collect()}
    for g in ("a", "b", "c", None):
        assert got[g] == pytest.approx(np.median([abs(a - b) for h, a, b in rows if h == g]), abs=1e-12)
    assert got["d"] is None and kept["error-histogram"].count() < 120
    kept.clear()
    assert evaluate.regression_metrics(df).first()["median_ae"] == pytest.approx(np.median([abs(a - b) for _, a, b in rows]), abs=1e-12)


def test_models_are_applied_once_for_all_metrics(spark, monkeypatch):
    """metrics read predictions from the shared folder, models do not run again for each of them."""
    kept = []
    monkeypatch.setattr(supervised, "materialize", lambda d, name, keep=supervised.materialize: kept.append(name) or keep(d, name))
    df = spark.createDataFrame([(i, float(i % 7), float(3 * (i % 7) + i % 2)) for i in range(120)], "id long, a double, y double")
    _pred, metrics = supervised.train_models(df, "id", "y", ["a"], "regression", ["linear_regression", "ridge"])
    assert metrics.filter("metric = 'median_ae' AND value IS NOT NULL").count() == 4 and kept.count("predictions") == 1


def test_kendall_in_small_buckets(spark):
    """a row goes to one bucket per column, whatever the number of values: no row per bit of its rank."""
    from sparkprep.operators import correlate
    rng = np.random.default_rng(9)
    x = np.column_stack([rng.normal(size=400), np.round(rng.normal(size=400), 1), rng.integers(0, 4, 400)])
    x[rng.random(400) < 0.3, 0] = 0.25  # a value of a third of the rows
    x[:, 1] += np.round(x[:, 0], 1)
    df, cols = frame(spark, x)
    df = df.withColumn("b", F.when(F.col("id") % 7 != 0, F.col("b")))
    x[::7, 1] = np.nan
    for rows in (7, 60):
        got = {(r["col_x"], r["col_y"]): r["r"] for r in correlate.kendall(df, cols, digits=None, bucket_rows=rows).collect()}
        for i, a in enumerate(cols):
            for j, b in enumerate(cols):
                both = x[~np.isnan(x[:, [i, j]]).any(axis=1)][:, [i, j]]
                u, v = (np.sign(both[:, k][:, None] - both[:, k][None, :]) for k in (0, 1))
                assert got[a, b] == pytest.approx((u * v).sum() / np.sqrt((u * u).sum() * (v * v).sum()))


def test_results_appended_twice_count_once(spark, tmp_path):
    from sparkprep.operators import results
    rows = spark.createDataFrame([("p", "m", "a", "regression", "test", "rmse", 1.0, "t", None), ("p", "m", "a", "regression", "test", "r2", 0.5, "t", None)],
                                 "project_id string, model_id string, algorithm string, problem_type string, split string, metric string, value double, created_at string, error string")
    for _ in range(2):
        results.append_results(rows, str(tmp_path / "r"))
    assert results.read_results(spark, str(tmp_path / "r")).count() == 2


def test_leaf_joins_only_sure_links():
    x = np.array([[0.0], [1.0], [3.0], [3.5]])
    comp, links = linkage.joined_inside(x, np.array([9.0, 9.0, 9.0, 0.1]), np.zeros(4, bool))
    # the last point may have a nearer one elsewhere, and so may all that it joins
    assert sorted(links) == [(0.5, 2, 3), (1.0, 0, 1), (2.0, 1, 2)] and comp.tolist() == [0, 0, 0, 0]
    comp, links = linkage.joined_inside(x, np.array([9.0, 9.0, 0.1, 0.1]), np.array([True, False, False, False]))
    assert links == [] and comp.tolist() == [0, 1, 2, 3]  # the nearest point is alone, or the link longer than the gap


def test_spanning_tree_takes_few_rounds(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.c_[np.round(rng.uniform(0, 40, 700), 2), rng.integers(0, 4, 700)]
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "id long, x double, y double")
    _, points = linkage.locations(df, "id", ["x", "y"])
    met = []
    monkeypatch.setattr(linkage, "connected_components", lambda e: met.append(1) or graph.connected_components(e))
    got = sorted(map(tuple, linkage.spanning_tree(points, 64).collect()))
    pts = [(r.id, np.array(r.x)) for r in points.collect()]
    every = sorted((float(np.sqrt(((p - r) ** 2).sum())), min(a, b), max(a, b)) for i, (a, p) in enumerate(pts) for b, r in pts[:i])
    root = {a: a for a, _ in pts}

    def top(a):
        while root[a] != a:
            a = root[a]
        return a

    want = []
    for d, a, b in every:
        if top(a) != top(b):
            root[top(a)] = top(b)
            want.append((d, a, b))
    assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in sorted(want)] and len(met) <= 6


@pytest.mark.parametrize("few", [0, graph.FEW])
def test_components_on_and_off_the_driver(spark, few):
    edges = spark.createDataFrame([(1, 2), (3, 2), (7, 7), (9, 8), (8, 5), (3, 1), (5, 4)], "a long, b long")
    assert sorted(map(tuple, graph.connected_components(edges, few).collect())) == [(2, 1), (3, 1), (5, 4), (8, 4), (9, 4)]


def test_components_on_the_driver_need_no_python_on_executors(spark):
    for kind in ("long", "string"):
        edges = spark.createDataFrame([("3", "2"), ("2", "1"), ("5", "4")], "a string, b string").selectExpr(f"CAST(a AS {kind}) a", f"CAST(b AS {kind}) b")
        found = graph.connected_components(edges)
        assert "ExistingRDD" not in found._jdf.queryExecution().toString()
        assert [t for _, t in found.dtypes] == ["bigint" if kind == "long" else kind] * 2
        assert sorted(tuple(map(int, r)) for r in found.collect()) == [(2, 1), (3, 1), (5, 4)]
    none = graph.connected_components(edges.filter("a = b"))
    assert none.dtypes == found.dtypes and none.count() == 0
