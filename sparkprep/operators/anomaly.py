"""Anomaly detection: isolation forest (grown on bounded per-tree samples,
scored over all rows in Arrow batches) and simple flag summaries.

Plan:
1. per-tree samples: about 3 psi rows are drawn for each of the T trees by a hash
   of the key (a row joins a tree only if its hash falls under 3 psi T / n, or
   several trees where that is over 1) and each tree keeps the ``psi`` rows with
   the smallest second hash;
2. trees are grown by ``groupBy(tree).applyInPandas`` (one task per tree,
   <= psi rows each);
3. the forest (T x < 2 psi nodes, independent of n) is shipped once in the task
   closure and every row is scored by ``mapInPandas`` with vectorised numpy
   traversal;
4. the anomaly threshold is the exact (1 - contamination) quantile of the scores
   (``scan.exact_quantiles``). Missing values are replaced by the column's mean
   first, so every row gets a score.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import quoted
from ..session import materialize, ship_package
from . import prep, scan

SVM_ROWS = 8192  # points whose features are held at once
EULER = 0.5772156649015329
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, size long"


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def _grow(pdf: pd.DataFrame, features: list[str], seed: int, psi: int) -> pd.DataFrame:
    tree = int(pdf["tree"].iloc[0])
    rng = np.random.default_rng([seed, tree])
    x = pdf[features].to_numpy(dtype=float)
    limit = int(math.ceil(math.log2(max(psi, 2))))
    rows = []

    def build(idx: np.ndarray, depth: int) -> int:
        node = len(rows)
        rows.append(None)
        sub = x[idx]
        if depth >= limit or len(idx) <= 1:
            rows[node] = (tree, node, -1, 0.0, -1, -1, len(idx))
            return node
        lo, hi = np.nanmin(sub, axis=0), np.nanmax(sub, axis=0)
        cand = np.flatnonzero(hi > lo)
        if cand.size == 0:
            rows[node] = (tree, node, -1, 0.0, -1, -1, len(idx))
            return node
        q = int(rng.choice(cand))
        p = float(rng.uniform(lo[q], hi[q]))
        left = build(idx[sub[:, q] < p], depth + 1)
        right = build(idx[sub[:, q] >= p], depth + 1)
        rows[node] = (tree, node, q, p, left, right, len(idx))
        return node

    build(np.arange(len(x)), 0)
    return pd.DataFrame(rows, columns=["tree", "node", "feature", "threshold", "left", "right", "size"])


def _filled(df: DataFrame, key: str, features: list[str]) -> DataFrame:
    """(key, features as doubles), missing values replaced by the column's mean (0 if it has none)."""
    data = prep.impute(df.select(quoted(key), *[quoted(c).cast("double").alias(c) for c in features]), features)
    return data.withColumns({c: F.nanvl(F.coalesce(quoted(c), F.lit(0.0)), F.lit(0.0)) for c in features})


def isolation_forest(df: DataFrame, key: str, features: list[str], n_trees: int = 100, max_samples: int = 256,
                     contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``score`` (higher = more anomalous) and ``anomaly`` (bool) to (key, features)."""
    ship_package(df.sparkSession)
    data = _filled(df, key, features).toDF("_key", *[f"x{i}" for i in range(len(features))])
    name, key, features = key, "_key", [f"x{i}" for i in range(len(features))]
    n = data.count()
    psi = int(min(max_samples, n))
    # each tree sees ~3 psi candidates and keeps the psi first
    share = 3.0 * psi * n_trees / max(n, 1)
    m = max(1, min(n_trees, math.ceil(share)))
    picks = F.transform(F.sequence(F.lit(0), F.lit(m - 1)),
                        lambda j: F.pmod(F.xxhash64(quoted(key), j, F.lit(seed)), F.lit(n_trees)).cast("int"))
    joins = F.pmod(F.xxhash64(quoted(key), F.lit(seed + 2)), F.lit(1 << 31)) < F.lit(int(min(share, 1.0) * (1 << 31)))
    cand = data.filter(joins).select("*", F.explode(F.array_distinct(picks)).alias("tree")) \
        .withColumn("u", F.xxhash64(quoted(key), F.col("tree"), F.lit(seed + 1)))
    w = Window.partitionBy("tree").orderBy("u", quoted(key))
    sample = cand.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= psi).drop("_rk", "u")
    nodes = sample.groupBy("tree").applyInPandas(lambda pdf: _grow(pdf, features, seed, psi), NODE_SCHEMA)
    forest = nodes.toPandas()  # bounded: n_trees x (< 2 psi) nodes, independent of the data size
    trees = []
    for _, g in forest.groupby("tree"):
        g = g.sort_values("node")
        trees.append((g["feature"].to_numpy(), g["threshold"].to_numpy(), g["left"].to_numpy(),
                      g["right"].to_numpy(), g["size"].to_numpy()))
    cn = c_factor(psi)
    leaf_adj = [np.array([c_factor(s) for s in tr[4]]) for tr in trees]

    def score(batches):
        for pdf in batches:
            x = pdf[features].to_numpy(dtype=float)
            total = np.zeros(len(x))
            for (feat, thr, left, right, _size), adj in zip(trees, leaf_adj):
                node = np.zeros(len(x), dtype=np.int64)
                depth = np.zeros(len(x))
                active = feat[node] >= 0
                while active.any():
                    f = feat[node[active]]
                    go_left = x[np.flatnonzero(active), f] < thr[node[active]]
                    nxt = np.where(go_left, left[node[active]], right[node[active]])
                    node[active] = nxt
                    depth[active] += 1
                    active = feat[node] >= 0
                total += depth + adj[node]
            mean_path = total / max(len(trees), 1)
            out = pdf[[key]].copy()
            out["score"] = np.power(2.0, -mean_path / cn) if cn > 0 else 0.5
            yield out

    key_type = data.schema[key].dataType.simpleString()
    # the scores feed both the threshold and the result: written once to the shared folder
    scored = materialize(data.mapInPandas(score, f"{key} {key_type}, score double").toDF(name, "score"), "forest-scores")
    cut = scan.quantile_values(scored, ["score"], [1.0 - contamination])["score"]
    if cut is None:
        return scored.withColumn("anomaly", F.lit(False))
    cut = cut[0]
    return scored.withColumn("anomaly", F.col("score") > F.lit(cut))


def zscore_flags(df: DataFrame, col: str, threshold: float = 3.0) -> DataFrame:
    """|z| > threshold (sample std) as an ``anomaly`` flag."""
    r = df.agg(F.avg(quoted(col)).alias("m"), F.stddev_samp(quoted(col)).alias("s")).first()
    if not r["s"]:
        return df.withColumn("anomaly", F.lit(False))
    return df.withColumn("anomaly", F.coalesce(F.abs((quoted(col) - F.lit(r["m"])) / F.lit(r["s"])) > threshold,
                                               F.lit(False)))


def anomaly_summary(flagged: DataFrame, flag: str = "anomaly") -> DataFrame:
    """anomalies_detected, n, outlier_ratio."""
    return flagged.agg(F.count_if(F.col(flag)).alias("anomalies_detected"), F.count(F.lit(1)).alias("n"),
                       (F.count_if(F.col(flag)) / F.count(F.lit(1))).alias("outlier_ratio"))


def _svm_features(batch: pa.RecordBatch, W: np.ndarray | None, b: np.ndarray | None, scale: float):
    """The Fourier features of a batch's points x0.. (without ``W`` the points), a bounded number of rows at a time."""
    x = np.column_stack([batch[n].to_numpy(zero_copy_only=False) for n in batch.schema.names if n != "_key"])
    for at in range(0, len(x), SVM_ROWS):
        part = x[at:at + SVM_ROWS]
        if W is None:
            yield part
        else:
            z = part @ W.T
            z += b
            yield np.cos(z, out=z) * scale


def _svm_sums(batches: Iterator[pa.RecordBatch], weights: np.ndarray, rho: float, W, b, scale: float) -> Iterator[pa.RecordBatch]:
    """Number and feature sums of a part's rows whose margin is below ``rho``."""
    cnt, total = 0, np.zeros(len(weights))
    for batch in batches:
        for z in _svm_features(batch, W, b, scale):
            below = z @ weights < rho
            cnt += int(below.sum())
            total += below.astype(float) @ z
    yield pa.RecordBatch.from_arrays([pa.array([cnt], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["cnt", "s"])


def _svm_decisions(batches: Iterator[pa.RecordBatch], weights: np.ndarray, rho: float, W, b, scale: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [z @ weights - rho for z in _svm_features(batch, W, b, scale)]
        yield pa.RecordBatch.from_arrays([batch["_key"], pa.array(np.concatenate(found) if found else [], pa.float64())], names=["_key", "decision"])


def one_class_svm(df: DataFrame, key: str, features: list[str], nu: float = 0.5, kernel: str = "rbf",
                  gamma: str | float = "scale", n_components: int = 100, iterations: int = 300,
                  seed: int = 42, tol: float = 1e-3, patience: int = 10) -> DataFrame:
    """One-class SVM, approximated: random Fourier features for the RBF kernel
    (linear kernel: the features themselves), then the primal objective
    0.5|w|^2 - rho + 1/(nu n) sum max(0, rho - w.phi(x)) minimised by full-batch
    subgradient steps, each step one pass over the points (features are made in numpy
    on the way, so that they lie nowhere), until the best
    objective has not improved by ``tol`` (relative) for ``patience`` steps; the
    best point is kept. Missing values are replaced by the column's mean. Results
    are NOT identical to a libsvm solve; 'poly' and 'sigmoid' kernels are refused.
    Adds ``decision`` and ``anomaly`` (decision < 0)."""
    if kernel not in ("rbf", "linear"):
        raise ValueError(f"kernel '{kernel}' is not supported (rbf, linear)")
    data = _filled(df, key, features)
    d = len(features)
    if kernel == "rbf":
        if gamma == "scale":
            var = data.agg(F.avg(sum(quoted(c) * quoted(c) for c in features) / d).alias("m2"),
                           *[F.avg(quoted(c)).alias(f"m_{c}") for c in features]).first()
            mean_all = sum(var[f"m_{c}"] for c in features) / d  # variance of all values, as X.var()
            g = 1.0 / (d * max(var["m2"] - mean_all ** 2, 1e-12))
        elif gamma == "auto":
            g = 1.0 / d
        else:
            g = float(gamma)
        rng = np.random.default_rng(seed)
        W = rng.normal(0.0, math.sqrt(2 * g), (n_components, d))
        b = rng.uniform(0, 2 * math.pi, n_components)
        scale = math.sqrt(2.0 / n_components)
    else:
        W, b, scale = None, None, 1.0
    k = d if W is None else n_components
    ship_package(df.sparkSession)
    xs = [f"x{i}" for i in range(d)]
    points = materialize(data.toDF("_key", *xs), "svm-points")
    n = max(points.count(), 1)
    w = np.zeros(k)
    rho = 0.0
    best, best_w, best_rho, since = math.inf, w, rho, 0
    for t in range(1, iterations + 1):
        sums = points.select(*xs).mapInArrow(functools.partial(_svm_sums, weights=w, rho=rho, W=W, b=b, scale=scale), "cnt long, s array<double>")
        # one number per component, whatever the number of rows and parts
        found = sums.select("cnt", F.posexplode("s").alias("j", "v")).groupBy("j").agg(F.sum("cnt").alias("cnt"), F.sum("v").alias("v")).collect()
        cnt = found[0]["cnt"] if found else 0
        s = np.zeros(k)
        for r in found:
            s[r["j"]] = r["v"]
        objective = 0.5 * float(w @ w) - rho + (rho * cnt - float(w @ s)) / (nu * n)
        since = 0 if objective < best - tol * max(abs(best) if math.isfinite(best) else 1.0, 1e-6) else since + 1
        if objective < best:
            best, best_w, best_rho = objective, w, rho
        if since >= patience:
            break
        grad_w = w - s / (nu * n)
        grad_rho = -1.0 + cnt / (nu * n)
        lr = 1.0 / math.sqrt(t)
        w = w - lr * grad_w
        rho = rho - lr * grad_rho
    decide = functools.partial(_svm_decisions, weights=best_w, rho=best_rho, W=W, b=b, scale=scale)
    key_type = data.schema[key].dataType.simpleString()
    out = points.mapInArrow(decide, f"_key {key_type}, decision double").withColumnRenamed("_key", key)
    return out.withColumn("anomaly", F.col("decision") < 0)
