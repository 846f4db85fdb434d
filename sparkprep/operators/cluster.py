"""Clustering: k-means (Spark ML), assignment to fixed centroids, and cluster
quality metrics computed from per-cluster summaries.

Vectors are ``array<double>`` columns. Per-cluster summaries (count, vector
sum, sum of squared norms, centroid) are one ``groupBy`` over the exploded
coordinates; they are k x d numbers, bounded by the number of clusters, and
are passed to the row-level expressions as literals.

* Silhouette here uses SQUARED Euclidean distance (like Spark's
  ``ClusteringEvaluator``): the mean squared distance from a point to a
  cluster is ``n_C |x|^2 - 2 x.S_C + Q_C`` over n_C, so no pair of points is
  ever formed. The exact Euclidean silhouette is quadratic in the number of
  rows and is not offered.
* Calinski-Harabasz comes from the summaries alone; Davies-Bouldin needs one
  pass for the mean Euclidean distance to the own centroid.
* ``quality`` gives all three for any number of clusters: more than ``FEW_CLUSTERS``
  stay a table, and other clusters are found through balls around their centroids.
"""

from __future__ import annotations

import itertools
import math

from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import quoted, rnd
from ..session import materialize
from . import balls, knn, prep
from .graph import connected_components

NOISE = -1
GRID_DIMS = 3  # dimensions up to which cells are joined with all places near theirs
ONE_TASK = 2 ** 22  # links of cells that one task may follow
FEW_CLUSTERS = 32  # clusters whose summaries the driver may hold


def _dot(x: Column, arr: list[float]) -> Column:
    lit = F.array(*[F.lit(float(v)) for v in arr])
    return F.aggregate(F.zip_with(x, lit, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def _sqnorm(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v * v)


def summaries(df: DataFrame, label: str, vec: str) -> list[dict]:
    """Per cluster: label, n, sum vector, sum of squared norms, centroid (bounded: k rows)."""
    d = df.filter(quoted(label) != NOISE)
    ex = d.select(quoted(label).alias("l"), F.posexplode(quoted(vec).cast("array<double>")).alias("pos", "v"))
    per = ex.groupBy("l", "pos").agg(F.sum("v").alias("s"))
    sums = per.groupBy("l").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("ps"))
    cnt = d.groupBy(quoted(label).alias("l")).agg(F.count(F.lit(1)).alias("n"),
                                                 F.sum(_sqnorm(quoted(vec).cast("array<double>"))).alias("q"))
    rows = cnt.join(sums, "l").orderBy("l").collect()
    out = []
    for r in rows:
        s = [p["s"] for p in r["ps"]]
        out.append({"label": r["l"], "n": r["n"], "sum": s, "q": r["q"], "centroid": [v / r["n"] for v in s]})
    return out


def silhouette_sq(df: DataFrame, label: str, vec: str, summ: list[dict] | None = None) -> DataFrame:
    """Mean silhouette with squared Euclidean distances (noise rows excluded)."""
    summ = summ if summ is not None else summaries(df, label, vec)
    d = df.filter(quoted(label) != NOISE).select(quoted(label).alias("l"), quoted(vec).cast("array<double>").alias("x"))
    xx = _sqnorm(F.col("x"))
    dist = {c["label"]: (F.lit(float(c["n"])) * xx - 2 * _dot(F.col("x"), c["sum"]) + F.lit(float(c["q"])))
            for c in summ}
    size = {c["label"]: c["n"] for c in summ}
    own_n = F.lit(None).cast("double")
    own_d = F.lit(None).cast("double")
    for lab, e in dist.items():
        own_n = F.when(F.col("l") == lab, F.lit(float(size[lab]))).otherwise(own_n)
        own_d = F.when(F.col("l") == lab, e).otherwise(own_d)
    others = [F.when(F.col("l") != lab, e / F.lit(float(size[lab]))) for lab, e in dist.items()]
    b = F.least(*others) if len(others) > 1 else others[0]
    a = own_d / (own_n - 1)
    s = F.when(own_n <= 1, F.lit(0.0)).otherwise((b - a) / F.greatest(a, b))
    return d.select(s.alias("s")).agg(F.avg("s").alias("silhouette_sq"))


def calinski_harabasz(df: DataFrame, label: str, vec: str, summ: list[dict] | None = None) -> DataFrame:
    summ = summ if summ is not None else summaries(df, label, vec)
    n = sum(c["n"] for c in summ)
    k = len(summ)
    spark = df.sparkSession
    if k < 2 or n <= k:
        return spark.createDataFrame([(None,)], "calinski_harabasz double")
    dim = len(summ[0]["sum"])
    g = [sum(c["sum"][j] for c in summ) / n for j in range(dim)]
    between = sum(c["n"] * sum((c["centroid"][j] - g[j]) ** 2 for j in range(dim)) for c in summ)
    within = sum(c["q"] - c["n"] * sum(v * v for v in c["centroid"]) for c in summ)
    val = None if within == 0 else (between / (k - 1)) / (within / (n - k))
    return spark.createDataFrame([(val,)], "calinski_harabasz double")


def davies_bouldin(df: DataFrame, label: str, vec: str, summ: list[dict] | None = None) -> DataFrame:
    summ = summ if summ is not None else summaries(df, label, vec)
    spark = df.sparkSession
    if len(summ) < 2:
        return spark.createDataFrame([(None,)], "davies_bouldin double")
    x = quoted(vec).cast("array<double>")
    dist = F.lit(None).cast("double")
    for c in summ:
        cen = F.array(*[F.lit(float(v)) for v in c["centroid"]])
        e = F.sqrt(F.aggregate(F.zip_with(x, cen, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v))
        dist = F.when(quoted(label) == c["label"], e).otherwise(dist)
    spread = {r["l"]: r["s"] for r in df.filter(quoted(label) != NOISE)
              .groupBy(quoted(label).alias("l")).agg(F.avg(dist).alias("s")).collect()}  # k rows
    cents = {c["label"]: c["centroid"] for c in summ}
    labs = sorted(cents)
    worst = []
    for i in labs:
        best = 0.0
        for j in labs:
            if i == j:
                continue
            m = math.sqrt(sum((a - b) ** 2 for a, b in zip(cents[i], cents[j])))
            best = max(best, (spread[i] + spread[j]) / m if m > 0 else math.inf)
        worst.append(best)
    return spark.createDataFrame([(sum(worst) / len(worst),)], "davies_bouldin double")


def quality(df: DataFrame, label: str, vec: str, few: int = FEW_CLUSTERS) -> list[tuple[str, float | None]]:
    """(metric, value): squared-distance silhouette, Calinski-Harabasz and Davies-Bouldin of any
    number of clusters, noise rows left out; nothing for fewer than two clusters."""
    rows = df.filter(quoted(label) != NOISE).select(F.monotonically_increasing_id().alias("r"), quoted(label).alias("l"), quoted(vec).cast("array<double>").alias("x"))
    rows = materialize(rows, "quality-rows")
    found = rows.select("l").distinct().limit(few + 1).count()
    if found < 2:
        return []
    if found <= few:
        summ = summaries(rows, "l", "x")
        values = [f(rows, "l", "x", summ).first()[0] for f in (silhouette_sq, calinski_harabasz, davies_bouldin)]
    else:
        dims = rows.select(F.size("x")).first()[0]
        clusters = _summary_table(rows, dims)
        values = [_silhouette_many(rows, clusters, dims), _calinski_harabasz_many(clusters, dims), _davies_bouldin_many(clusters, dims)]
    return list(zip(("silhouette_score", "calinski_harabasz_score", "davies_bouldin_score"), values, strict=True))


def _summary_table(rows: DataFrame, dims: int) -> DataFrame:
    """Per cluster (l, n, c, v, s): rows, centroid, mean squared and mean distance to the centroid."""
    cents = materialize(rows.groupBy("l").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(F.get("x", F.lit(i))) for i in range(dims)]).alias("c")), "quality-centroids")
    gap2 = balls.distance2(F.col("x"), F.col("c"), dims=dims)
    spread = rows.join(cents, "l").groupBy("l").agg(F.avg(gap2).alias("v"), F.avg(F.sqrt(gap2)).alias("s"))
    return materialize(cents.join(spread, "l"), "quality-clusters")


def _silhouette_many(rows: DataFrame, clusters: DataFrame, dims: int) -> float | None:
    """Mean silhouette by squared distances. A point's mean squared distance to a cluster is its
    squared distance to the centroid plus ``v``: the nearest other cluster is the nearest of the points
    (centroid, sqrt(v)) to (point, 0)."""
    xs = [f"x{i}" for i in range(dims + 1)]
    place = lambda x, last: [F.get(x, F.lit(i)).alias(xs[i]) for i in range(dims)] + [last.alias(xs[dims])]
    near = knn.neighbours(clusters.select(F.col("l").alias("id"), *place("c", F.sqrt("v"))), rows.select(F.col("r").alias("id"), *place("x", F.lit(0.0))), "id", xs, 2, leaf_rows=16)
    own = rows.join(clusters, "l").select("r", "l", "n", (balls.distance2(F.col("x"), F.col("c"), dims=dims) + F.col("v")).alias("d2"))
    b = near.join(own, F.col("query") == F.col("r")).filter(F.col("neighbour") != F.col("l")).groupBy("r", "n", "d2").agg(F.min(F.col("distance") * F.col("distance")).alias("b"))
    a = F.col("d2") * F.col("n") / (F.col("n") - 1)
    s = F.when((F.col("n") <= 1) | (F.greatest("d2", "b") == 0), 0.0).otherwise((F.col("b") - a) / F.greatest(a, "b"))
    return b.agg(F.avg(s)).first()[0]


def _calinski_harabasz_many(clusters: DataFrame, dims: int) -> float | None:
    total = clusters.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("within"),
                         *[F.sum(F.col("n") * F.get("c", F.lit(i))).alias(f"m{i}") for i in range(dims)]).first()
    k, n = total["k"], total["n"]
    if n <= k or total["within"] == 0:
        return None
    middle = F.array(*[F.lit(total[f"m{i}"] / n) for i in range(dims)])
    between = clusters.agg(F.sum(F.col("n") * balls.distance2(F.col("c"), middle, dims=dims))).first()[0]
    return (between / (k - 1)) / (total["within"] / (n - k))


def _davies_bouldin_many(clusters: DataFrame, dims: int) -> float:
    """Mean over clusters of the worst (s_i + s_j) / distance of the centroids. The nearest centroid
    gives a first value; balls whose widest cluster can't exceed it, by their distance, are left out."""
    xs = [f"x{i}" for i in range(dims)]
    points = clusters.select(F.col("l").alias("id"), *[F.get("c", F.lit(i)).alias(x) for i, x in enumerate(xs)])
    spread = clusters.select(F.col("l").alias("to"), F.col("s").alias("its"))
    ratio = lambda gap: F.when(gap > 0, (F.col("s") + F.col("its")) / gap).otherwise(F.lit(float("inf")))
    near = knn.neighbours(points, points, "id", xs, 2, leaf_rows=16).filter("query <> neighbour").withColumnsRenamed({"query": "l", "neighbour": "to"})
    least = near.join(spread, "to").join(clusters, "l").groupBy("l", "c", "s").agg(F.max(ratio(F.col("distance"))).alias("least"))
    asked = materialize(least.select("l", F.col("c").alias("x"), "s", "least", F.lit(float("inf")).alias("bound")), "quality-asked")
    tree = balls.build(clusters.select(F.col("l").alias("id"), F.col("c").alias("x"), "s"), leaf_rows=16, dims=dims)
    ups = F.transform(F.sequence(F.lit(0), F.length("ball")), lambda i: F.substring(F.col("ball"), F.lit(1), i))
    widest = materialize(tree.points.select(F.explode(ups).alias("kb"), "s").groupBy("kb").agg(F.max("s").alias("most")), "quality-widest")
    wide = balls.Balls(tree.points, tree.leaves, [
        level.select("ball", F.explode("kids").alias("k")).join(widest, F.col("k.ball") == F.col("kb"))
        .groupBy("ball").agg(F.collect_list(F.struct("k.ball", "k.c", "k.r", "k.n", "k.leaf", "most")).alias("kids")) for level in tree.inner], dims=dims)
    reach = F.when(F.col("least") > 0, (F.col("s") + F.col("kid.most")) / F.col("least")).otherwise(F.lit(float("inf")))
    met = wide.reached(asked, "bound", keep=balls.within(balls.distance(F.col("x"), F.col("kid.c"), dims=dims) - F.col("kid.r"), reach))
    other = tree.points.select("ball", F.col("id").alias("to"), F.col("x").alias("y"), F.col("s").alias("its"))
    pairs = met.join(other, "ball").filter(F.col("l") != F.col("to"))
    worst = pairs.groupBy("l").agg(F.max(F.greatest("least", ratio(balls.distance(F.col("x"), F.col("y"), dims=dims)))).alias("w"))
    return asked.join(worst, "l", "left").agg(F.avg(F.coalesce("w", "least"))).first()[0]


def cluster_sizes(df: DataFrame, label: str) -> DataFrame:
    """Rows per cluster label (noise -1 included)."""
    return df.groupBy(quoted(label).alias("cluster")).agg(F.count(F.lit(1)).alias("size"))


def cluster_stats(df: DataFrame, label: str, vec: str, digits: int = 6) -> DataFrame:
    """Per cluster and dimension: mean, population std, min, max."""
    ex = df.select(quoted(label).alias("cluster"), F.posexplode(quoted(vec).cast("array<double>")).alias("dim", "v"))
    return ex.groupBy("cluster", "dim").agg(
        F.count(F.lit(1)).alias("size"), rnd(F.avg("v"), digits).alias("mean"),
        rnd(F.stddev_pop("v"), digits).alias("std"), rnd(F.min("v"), digits).alias("min"),
        rnd(F.max("v"), digits).alias("max"))


def assign_nearest(df: DataFrame, vec: str, centroids: list[tuple[int, list[float]]], out_col: str = "cluster") -> DataFrame:
    """Nearest fixed centroid by squared distance (smallest label on ties)."""
    x = quoted(vec).cast("array<double>")
    items = []
    for lab, c in centroids:
        cen = F.array(*[F.lit(float(v)) for v in c])
        d2 = F.aggregate(F.zip_with(x, cen, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
        items.append(F.struct(d2.alias("d"), F.lit(lab).alias("l")))
    return df.withColumn(out_col, F.array_min(F.array(*items))["l"])


def kmeans(df: DataFrame, vec: str, k: int = 8, init: str = "k-means++", max_iter: int = 300, seed: int = 42,
           out_col: str = "cluster") -> tuple[DataFrame, list[list[float]]]:
    """Spark ML k-means (``k-means||`` stands in for k-means++); returns (labelled rows, centers)."""
    mode = "random" if init == "random" else "k-means||"
    d = df.withColumn("_features", array_to_vector(quoted(vec).cast("array<double>")))
    model = KMeans(k=k, initMode=mode, maxIter=max_iter, seed=seed, featuresCol="_features",
                   predictionCol=out_col).fit(d)
    return model.transform(d).drop("_features"), [list(map(float, c)) for c in model.clusterCenters()]


def agglomerative(df: DataFrame, vec: str, k: int = 2, micro: int = 1000, seed: int = 42,
                  out_col: str = "cluster") -> DataFrame:
    """Approximate agglomerative clustering: bisecting k-means (divisive, Spark
    ML) to ``k`` clusters. Results are NOT identical to exact linkage."""
    d = df.withColumn("_features", array_to_vector(quoted(vec).cast("array<double>")))
    model = BisectingKMeans(k=k, seed=seed, featuresCol="_features", predictionCol=out_col).fit(d)
    return model.transform(d).drop("_features")


def _dbscan_parts(df: DataFrame, key: str, cols: list[str], eps: float, min_samples: int):
    """(points with cell and cell size, pairs (id, qid) within eps whose id lies in
    a sparse cell, roles (id, core), pairs (a, b) of cells that can hold points within eps)."""
    d = len(cols)
    side = eps / math.sqrt(d)
    pts = df.select(quoted(key).alias("id"), *[quoted(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    pts = prep.impute(pts, [f"x{i}" for i in range(d)])
    cell = [F.floor(quoted(f"x{i}") / F.lit(side)).cast("long").alias(f"c{i}") for i in range(d)]
    pts = pts.select("*", *cell)
    ckeys = [f"c{i}" for i in range(d)]
    counts = pts.groupBy(*ckeys).agg(F.count(F.lit(1)).alias("cell_n"), F.min("id").alias("cell_id"))
    p = materialize(pts.join(counts, ckeys), "dbscan-points")
    near = materialize(_near_cells(p.select("cell_id", *ckeys).distinct(), d, side, eps), "dbscan-cells")
    probe = p.filter(F.col("cell_n") < min_samples).select("id", *[quoted(f"x{i}").alias(f"px{i}") for i in range(d)], F.col("cell_id").alias("a")).join(near, "a")
    other = p.select(F.col("id").alias("qid"), *[quoted(f"x{i}").alias(f"qx{i}") for i in range(d)], F.col("cell_id").alias("b"))
    dist2 = sum((quoted(f"px{i}") - quoted(f"qx{i}")) ** 2 for i in range(d))
    pairs = materialize(probe.join(other, "b").filter(dist2 <= F.lit(eps * eps)).select("id", "qid"), "dbscan-pairs")
    nb = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("neighbours"))
    roles = p.select("id", "cell_n", "cell_id").join(nb, "id", "left").select(
        "id", ((F.col("cell_n") >= min_samples) | (F.coalesce("neighbours", F.lit(0)) >= min_samples)).alias("core"),
        # all points of a full cell are core and of one cluster: one node, named by the least of them
        F.when(F.col("cell_n") >= min_samples, F.col("cell_id")).otherwise(F.col("id")).alias("node"))
    return p, pairs, materialize(roles, "dbscan-roles"), near


def _near_cells(cells: DataFrame, d: int, side: float, eps: float) -> DataFrame:
    """(a, b): pairs of non-empty cells (named by cell_id, each with itself too) that are nowhere farther
    apart than ``eps``. In up to ``GRID_DIMS`` dimensions a cell has few neighbours, joined by place. In more,
    the cells' middles lie in balls, walked down from the root: what is looked at
    follows from the cells that there are, not from the number of neighbours that a cell may have."""
    if d <= GRID_DIMS:
        steps = [k for k in itertools.product(range(-2, 3), repeat=d) if sum(max(abs(i) - 1, 0) ** 2 for i in k) <= d]
        moves = F.explode(F.array(*[F.struct(*[F.lit(i).cast("long").alias(f"s{n}") for n, i in enumerate(k)]) for k in steps])).alias("step")
        asked = cells.select(F.col("cell_id").alias("a"), *[f"c{i}" for i in range(d)], moves)
        asked = asked.select("a", *[F.try_add(f"c{i}", F.col(f"step.s{i}")).alias(f"c{i}") for i in range(d)])
        return asked.join(cells.withColumnRenamed("cell_id", "b"), [f"c{i}" for i in range(d)]).select("a", "b")
    middles = materialize(cells.select(F.col("cell_id").alias("id"), F.array(*[(quoted(f"c{i}") + 0.5) * F.lit(side) for i in range(d)]).alias("x")), "dbscan-middles")
    tree = balls.build(middles)
    asked = middles.select(F.col("id").alias("a"), "x", F.lit(eps + side * math.sqrt(d)).alias("bound"))
    other = tree.points.select("ball", F.col("id").alias("b"), F.col("x").alias("y"))
    gap = F.aggregate(F.zip_with("x", "y", lambda u, v: F.pow(F.greatest(F.abs(u - v) - F.lit(side), F.lit(0.0)), 2)), F.lit(0.0), lambda s, v: s + v)
    return tree.reached(asked, "bound").join(other, "ball").filter(balls.within(F.sqrt(gap), F.lit(eps))).select("a", "b")


def dbscan_points(df: DataFrame, key: str, cols: list[str], eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """DBSCAN point roles (core / border / noise) on numeric columns, exact.

    Grid of side eps / sqrt(d): two points of one cell are always within eps,
    so a cell holding >= min_samples points is all-core with no pair checked.
    Only points of SPARSE cells (< min_samples points) are paired with the
    points of the non-empty cells near theirs. Every point is paired with fewer than
    min_samples points of each of these cells, so the number of pairs is linear
    in n even when one cell holds a third of the rows. Neighbour counts include the point itself (as the reference does).
    Missing values are replaced by the column's mean.
    """
    _p, pairs, roles, _near = _dbscan_parts(df, key, cols, eps, min_samples)
    # border: a non-core point (always in a sparse cell) with a core point within eps
    core_ids = roles.filter("core").select(F.col("id").alias("qid"))
    near_core = pairs.join(core_ids, "qid").groupBy("id").agg(F.lit(True).alias("near_core"))
    out = roles.join(near_core, "id", "left").select(
        F.col("id").alias(key), "core",
        (~F.col("core") & F.coalesce("near_core", F.lit(False))).alias("border"))
    return out.withColumn("noise", ~F.col("core") & ~F.col("border"))


def _touching_cells(p: DataFrame, d: int, near: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """Pairs (a, b) of full cells, named by cell_id, with points within eps of each other, as many
    as connect all such cells.

    Boxes are halved level by level: a pair of boxes with outermost points within eps, or whose tight
    bounds are within eps anywhere, connects its cells, one that is farther apart everywhere
    is dropped, others are looked at again as their halves. A cell pair is left
    alone once it is connected, by itself or by others. No pairs of points are made but of the outermost.
    """
    dims = range(d)
    full = p.filter(F.col("cell_n") >= min_samples).select("cell_id", *[f"x{i}" for i in dims], *[f"c{i}" for i in dims])
    cells = full.select("cell_id").distinct()
    near = near.filter("a < b").join(cells.withColumnRenamed("cell_id", "a"), "a").join(cells.withColumnRenamed("cell_id", "b"), "b").select("a", "b")
    side = eps / math.sqrt(d)
    root = F.lit("")
    active = near.select("a", "b", root.alias("box_a"), root.alias("box_b"))
    point = F.struct(*[f"x{i}" for i in dims])
    done = None
    level = 0
    while True:
        # a box's path: for each level, the half it lies in on each axis
        halves = [F.concat(*[F.expr(f"cast(pmod(floor(x{i} / {side / 2 ** lv!r}D), 2) as int)").cast("string") for i in dims]) for lv in range(1, level + 1)]
        path = F.concat(*halves) if halves else root
        boxes = (full.withColumn("box", path).groupBy("cell_id", "box")
                 .agg(*[f(f"x{i}").alias(f"{n}{i}") for i in dims for f, n in ((F.min, "lo"), (F.max, "hi"))],
                      *[f(point, f"x{i}").alias(f"{n}{i}") for i in dims for f, n in ((F.min_by, "first"), (F.max_by, "last"))]))
        boxes = materialize(boxes, "dbscan-boxes")
        of = lambda s: boxes.select(F.col("cell_id").alias(s), F.col("box").alias(f"box_{s}"),
                                    *[quoted(f"{n}{i}").alias(f"{n}{i}_{s}") for i in dims for n in ("lo", "hi", "first", "last")])
        if level:  # the parents' halves
            parent = lambda s: of(s).withColumn(f"up_{s}", F.expr(f"substr(box_{s}, 1, {d * (level - 1)})"))
            active = (active.withColumnsRenamed({"box_a": "up_a", "box_b": "up_b"})
                      .join(parent("a"), ["a", "up_a"]).join(parent("b"), ["b", "up_b"]).drop("up_a", "up_b"))
        else:
            active = active.join(of("a"), ["a", "box_a"]).join(of("b"), ["b", "box_b"])
        gap = sum(F.greatest(quoted(f"lo{i}_a") - quoted(f"hi{i}_b"), quoted(f"lo{i}_b") - quoted(f"hi{i}_a"), F.lit(0.0)) ** 2 for i in dims)
        span = sum(F.greatest(F.abs(quoted(f"hi{i}_a") - quoted(f"lo{i}_b")), F.abs(quoted(f"hi{i}_b") - quoted(f"lo{i}_a"))) ** 2 for i in dims)
        outermost = [sum((F.col(f"{m}{i}_a.x{j}") - F.col(f"{n}{i}_b.x{j}")) ** 2 for j in dims) for i in dims for m, n in (("first", "last"), ("last", "first"))]
        touch = F.least(span, *outermost) <= eps * eps
        judged = materialize(active.filter(gap <= eps * eps).select("a", "b", "box_a", "box_b", touch.alias("touch")), "dbscan-boxpairs")
        found = judged.filter("touch").select("a", "b").distinct()
        done = found if done is None else done.union(found)
        active = judged.join(found, ["a", "b"], "left_anti").select("a", "b", "box_a", "box_b")
        if active.limit(1).count() == 0:
            return done
        # cells that are connected through others need no look
        roots = connected_components(done, one_task=ONE_TASK)
        for s in ("a", "b"):
            active = active.join(roots.select(F.col("node").alias(s), F.col("root").alias(f"root_{s}")), s, "left")
        apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
        active = materialize(active.filter(apart).select("a", "b", "box_a", "box_b"), "dbscan-active")
        left = active.select(F.explode(F.array("a", "b")).alias("cell_id")).distinct()
        if left.limit(1).count() == 0:
            return done
        full = full.join(left, "cell_id", "left_semi")
        level += 1
        if level > 48:  # boxes of one double: what is left is equal to eps but for rounding
            return done.union(active.select("a", "b").distinct())


def dbscan_labels(df: DataFrame, key: str, cols: list[str], eps: float = 0.5, min_samples: int = 5,
                  out_col: str = "cluster") -> DataFrame:
    """(key, cluster) by DBSCAN, exact: a cluster is named by its least core key;
    a border point takes the least name among its core neighbours; noise is -1.

    Full cells (``dbscan_points``) are single nodes; core points of sparse cells
    are nodes too. Links are the pairs of the role step and the touching full
    cells; their components come from rounds of joins."""
    p, pairs, roles, near = _dbscan_parts(df, key, cols, eps, min_samples)
    core = roles.filter("core").select("id", "node")
    links = (pairs.join(core, "id").select(F.col("node").alias("a"), "qid")
             .join(core.select(F.col("id").alias("qid"), F.col("node").alias("b")), "qid").select("a", "b")
             .union(_touching_cells(p, len(cols), near, eps, min_samples)))
    roots = connected_components(links, one_task=ONE_TASK)
    named = core.join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("name"))
    border = (pairs.join(named.withColumnRenamed("id", "qid"), "qid").groupBy("id").agg(F.min("name").alias("near")))
    return (roles.select("id").join(named, "id", "left").join(border, "id", "left")
            .select(F.col("id").alias(key), F.coalesce("name", "near", F.lit(-1)).alias(out_col)))
