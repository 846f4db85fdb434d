"""Quality of density clusters, however many there are, against brute force."""

import numpy as np
import pytest

from sparkprep.operators import cluster, linkage, supervised, unsupervised
from sparkprep.operators.graph import connected_components


def by_pairs(x, labels):
    """Squared-distance silhouette, Calinski-Harabasz and Davies-Bouldin from all pairs."""
    names = sorted(set(labels.tolist()))
    d2 = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    cents = np.array([x[labels == c].mean(axis=0) for c in names])
    s = []
    for i, l in enumerate(labels):
        n = (labels == l).sum()
        a, b = d2[i, labels == l].sum() / (n - 1) if n > 1 else 0.0, min(d2[i, labels == c].mean() for c in names if c != l)
        s.append((b - a) / max(a, b) if n > 1 else 0.0)
    within = sum(((x[labels == c] - m) ** 2).sum() for c, m in zip(names, cents))
    between = sum((labels == c).sum() * ((m - x.mean(axis=0)) ** 2).sum() for c, m in zip(names, cents))
    k, n = len(names), len(x)
    spread = np.array([np.sqrt(((x[labels == c] - m) ** 2).sum(axis=1)).mean() for c, m in zip(names, cents)])
    gaps = np.sqrt(((cents[:, None] - cents[None]) ** 2).sum(axis=2)) + np.diag(np.full(k, np.inf))
    return np.mean(s), (between / (k - 1)) / (within / (n - k)), ((spread[:, None] + spread[None]) / gaps).max(axis=1).mean()


@pytest.fixture(scope="module")
def clumps():
    """Sixty clumps of unlike size and width, and rows far from all."""
    rng = np.random.default_rng(4)
    mids = rng.uniform(-100, 100, (60, 2))
    labels = np.repeat(np.arange(60), rng.integers(1, 9, 60))
    x = mids[labels] + rng.normal(size=(len(labels), 2)) * rng.uniform(0.1, 9, 60)[labels][:, None]
    return x, labels


@pytest.mark.parametrize("few", [2, 100])
def test_quality_of_many_clusters_by_brute_force(spark, clumps, few):
    x, labels = clumps
    rows = [(int(l), p.tolist()) for l, p in zip(labels, x)] + [(cluster.NOISE, [500.0, 500.0])]
    got = cluster.quality(spark.createDataFrame(rows, "l long, p array<double>"), "l", "p", few=few)
    assert [m for m, _ in got] == ["silhouette_score", "calinski_harabasz_score", "davies_bouldin_score"]
    assert [v for _, v in got] == pytest.approx(by_pairs(x, labels), rel=1e-9)


@pytest.mark.parametrize("groups", [3, 40])
def test_training_run_of_density_clusters_has_their_quality(spark, groups):
    rng = np.random.default_rng(groups)
    side = int(np.ceil(np.sqrt(groups)))
    mids = np.array([(i % side, i // side) for i in range(groups)], float)
    labels = np.repeat(np.arange(groups), 6)
    x = mids[labels] + rng.uniform(-0.05, 0.05, (len(labels), 2))
    x = np.vstack([x, [[side * 3.0, side * 3.0]]])
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, a double, b double")
    out = unsupervised.train_unsupervised(df, "id", ["a", "b"], "clustering", ["dbscan"], {"dbscan": {"eps": 0.15 if groups > 3 else 0.4, "min_samples": 4}}).collect()
    assert not any(r["error"] for r in out)
    got = {r["metric"]: r["value"] for r in out}
    assert got["n_clusters"] == groups and got["n_noise"] == 1
    scaled = (x - x.mean(axis=0)) / x.std(axis=0)
    want = by_pairs(scaled[:-1], labels)
    assert [got[m] for m in ("silhouette_score", "calinski_harabasz_score", "davies_bouldin_score")] == pytest.approx(want, rel=1e-9)


def test_one_density_cluster_has_no_quality(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(50)], "id long, a double")
    out = unsupervised.train_unsupervised(df, "id", ["a"], "clustering", ["dbscan"], {"dbscan": {"eps": 5.0}}).collect()
    assert {(r["metric"], r["value"]) for r in out} == {("n_clusters", 1.0), ("n_noise", 0.0)}


# ------------------------------------------------------------------ single linkage
@pytest.mark.parametrize("dims,grid", [(1, False), (2, True), (3, False), (6, False)])
def test_spanning_tree_in_one_task_by_brute_force(dims, grid):
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(350, dims)) if not grid else rng.permutation(np.unique(rng.integers(0, 30, (350, 2)), axis=0)).astype(float)
    node = np.arange(len(x)) if dims != 3 else np.r_[0, 0, np.arange(len(x) - 2)]  # a node of several points
    total = sum((x[:, None, i] - x[None, :, i]) ** 2 for i in range(x.shape[1]))
    part, want = list(range(node[-1] + 1)), []
    for d, a, b in sorted((d, *sorted((int(node[i]), int(node[j])))) for (i, j), d in np.ndenumerate(np.sqrt(total)) if node[i] < node[j]):
        if part[a] != part[b]:
            want.append((d, a, b))
            part = [part[a] if p == part[b] else p for p in part]
    assert sorted(zip(*(c.tolist() for c in linkage.tree_of(x, node)), strict=True)) == want


def test_single_linkage_in_one_task_as_by_joins(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(300, 2)), rng.normal(size=(300, 2)) + [9, 0], np.round(rng.uniform(-20, 20, (40, 2)))])
    rows = [(f"k{i % 630:04}", p.tolist()) for i, p in enumerate(x)] + [(None, [0.5, 0.5])]
    points = spark.createDataFrame(rows, "id string, x array<double>")
    count = spark.sparkContext._jsc.sc().dagScheduler().nextJobId
    start = count()
    got = sorted((r["id"] or "", r["cluster"]) for r in linkage.single_linkage(points, 9).collect())
    assert count() - start < 20  # rounds of joins take over a hundred jobs
    joined = linkage.single_linkage(points, 9, leaf_rows=32, whole=0).collect()
    assert len({c for _, c in got}) == 9
    assert {i: c for i, c in got if i} == {r["id"]: r["cluster"] for r in joined if r["id"]}


# ------------------------------------------------------------------ density clusters
@pytest.mark.parametrize("dims", [1, 2, 3, 4])
def test_density_clusters_of_full_cells_at_exact_distances(spark, dims):
    """Points on a lattice, many at exactly eps, and cells of many points that only their corners connect."""
    rng = np.random.default_rng(dims)
    lattice = rng.integers(0, 7 if dims > 1 else 90, (60, dims)) * 0.5
    x = np.vstack([lattice + 0.0] + [lattice[:12] + rng.integers(0, 3, (12, dims)) * 0.125 for _ in range(12)])
    eps, least = 0.5, 6
    total = sum((x[:, None, i] - x[None, :, i]) ** 2 for i in range(dims)) <= eps * eps
    core = total.sum(axis=1) >= least
    name = np.where(core, np.arange(len(x)), len(x))
    while True:
        new = np.where(core, np.min(np.where(total & core[None], name[None], len(x)), axis=1), name)
        if (new == name).all():
            break
        name = new
    near = np.min(np.where(total & core[None], name[None], len(x)), axis=1)
    want = {i: int(c) if c < len(x) else -1 for i, c in enumerate(near)}
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], ", ".join(["id long", *[f"v{i} double" for i in range(dims)]]))
    count = spark.sparkContext._jsc.sc().dagScheduler().nextJobId
    start = count()
    got = {r["id"]: r["cluster"] for r in cluster.dbscan_labels(df, "id", [f"v{i}" for i in range(dims)], eps, least).collect()}
    assert got == want and len(set(want.values())) > 1
    assert dims > 3 or count() - start < 120  # by balls and rounds of joins it took over two hundred


def test_components_in_one_task_on_the_driver_and_by_joins(spark):
    rng = np.random.default_rng(8)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i + 1000, i + 1001) for i in range(90)]
    for kind, name in (("long", lambda n: n), ("string", lambda n: f"n{n:05}")):
        edges = spark.createDataFrame([(name(a), name(b)) for a, b in pairs] + [(None, name(1))], f"a {kind}, b {kind}")
        ways = [sorted(map(tuple, connected_components(edges, few, one).collect())) for few, one in ((10 ** 6, 0), (0, 10 ** 6), (0, 0))]
        assert ways[0] == ways[1] == ways[2] and (name(1090), name(1000)) in ways[0]


# ------------------------------------------------------------------ training in a session that has observed tables
def test_models_predict_after_a_table_was_observed(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, float(v), int(v + w > 0), f"t{i % 3}", float(v - w)) for i, (v, w) in enumerate(rng.normal(size=(120, 2)))],
                               "id long, v double, y int, t string, z double")
    assert connected_components(df.selectExpr("id as a", "id div 2 as b")).count() == 119  # observes the edges
    _, metrics = supervised.train_models(df, "id", "y", ["v", "t"], "classification", ["logistic_regression"])
    assert {r["split"] for r in metrics.collect() if r["metric"] == "accuracy"} == {"train", "test"}
    _, metrics = supervised.train_models(df, "id", "z", ["v", "t"], "regression", ["linear_regression"])
    assert {r["split"] for r in metrics.collect() if r["metric"] == "r2"} == {"train", "test"}
