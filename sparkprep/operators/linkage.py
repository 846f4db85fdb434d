"""Agglomerative clustering: single linkage exactly, the other linkages over clustering features.

Single linkage follows from the minimum spanning tree. It grows in rounds (Boruvka's):
every component takes its shortest link to a point outside. Points lie in balls
(``balls``). First each leaf joins its points by itself, as far as links are shorter than
the distance to any other leaf. Then the nearest outsiders within a leaf give each component a bound,
then leaves are paired with the balls within that bound, from the root down, but for
balls whose points are all of one's own component. Only points of pairs of leaves
that remain are compared. Links are ordered by length and then by their ends, so that equal
lengths make no circle; cutting the k - 1 longest leaves k clusters. Neither points nor
links pass the driver. Up to ``WHOLE`` numbers the same rounds run in one task over blocks of a
k-d order (``tree_of``): a round of joins costs far more than its work there.

Ward, complete and average linkage need the distance of every two clusters. They run by
nearest-neighbour chains over clustering features (count, mean, radius) of at most
``max_features`` balls: the balls of greatest radius are split first, until each is one
location or the number is reached. With as many features as locations the result is exact; else
every point counts as if it lay at its feature's mean, and ``error``, the greatest distance
of a point from that mean, bounds how far any distance between two points is off (twice it).

A cluster's number is the rank of its least key. Missing values take the column's mean.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.scalar import quoted as q
from ..session import materialize, ship_package
from . import balls, prep
from .graph import connected_components

LINKAGES = ("ward", "complete", "average", "single")
MAX_FEATURES = 2000
LEAF_ROWS = 256
WHOLE = 2 ** 22  # locations times squared dimensions that one task may take
BLOCK = 64  # points of a block of the k-d order
PAIRS = 256  # pairs of blocks compared at once


def locations(df: DataFrame, key: str, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows (key, loc), points (id, x, n)): every distinct location once, named by its least key."""
    xs = [f"x{i}" for i in range(len(cols))]
    rows = df.select(q(key).alias("key"), *[q(c).cast("double").alias(x) for c, x in zip(cols, xs, strict=True)])
    rows = prep.impute(rows, xs).fillna(0.0, subset=xs).select("key", F.array(*[F.col(x) + F.lit(0.0) for x in xs]).alias("x"))
    points = materialize(rows.groupBy("x").agg(F.min("key").alias("id"), F.count("*").alias("n")), "link-points")
    return rows.join(points.select("x", F.col("id").alias("loc")), "x").select("key", "loc"), points


def _least(rows: DataFrame) -> DataFrame:
    """The shortest link (d, a, b) of each component ``comp``."""
    return rows.groupBy("comp").agg(F.min(F.struct("d", F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b"))).alias("link"))


def _gaps(x: np.ndarray) -> np.ndarray:
    """Distances of all points of a leaf, summed in the order of the dimensions as ``balls.distance`` does; what is no number counts as infinite."""
    total = np.zeros((len(x), len(x)))
    with np.errstate(all="ignore"):
        for i in range(x.shape[1]):
            total += (x[:, None, i] - x[None, :, i]) ** 2
    return np.where(np.isnan(total), np.inf, np.sqrt(total))


def _nearest_outsiders(gaps: np.ndarray, comp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each point the distance and place of the nearest point of another component, the first of equally near ones."""
    other = np.where(comp[:, None] == comp[None, :], np.inf, gaps)
    to = other.argmin(axis=1)
    return other[np.arange(len(comp)), to], to


def joined_inside(x: np.ndarray, gap: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, list[tuple[float, int, int]]]:
    """(component of each point, links) of one leaf whose points are in order of their ids: components
    take their shortest link as long as it is shorter than the gap between them and other leaves, so
    that no point elsewhere can be nearer. Points marked ``alone`` are left out."""
    m = len(x)
    comp, links, gaps = np.arange(m), [], _gaps(x)
    places = np.arange(m)
    while True:
        d, to = _nearest_outsiders(gaps, comp)
        a, b = np.minimum(places, to), np.maximum(places, to)
        order = np.lexsort((b, a, d, comp))
        first = order[np.r_[True, comp[order][1:] != comp[order][:-1]]]
        free = np.full(m, np.inf)
        np.minimum.at(free, comp, gap)
        sure = first[(d[first] < free[comp[first]] * (1 - balls.SLACK)) & ~alone[first] & ~alone[to[first]]]
        if not len(sure):
            return comp, links
        new = {(float(d[i]), int(a[i]), int(b[i])) for i in sure}
        links += sorted(new)
        root = list(range(m))
        for _, i, j in new:
            i, j = sorted((_root(root, int(comp[i])), _root(root, int(comp[j]))))
            root[j] = i
        comp = np.array([_root(root, int(c)) for c in comp])


def _blocks(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """A leaf's points in order of their ids, and their coordinates."""
    pdf = pdf.sort_values("id", kind="stable").reset_index(drop=True)
    return pdf, np.stack([np.asarray(v, float) for v in pdf["x"]])


def _join_leaf(pdf: pd.DataFrame) -> pd.DataFrame:
    """The points of a leaf with their component; the links of ``joined_inside`` stand in some of the rows."""
    pdf, x = _blocks(pdf)
    comp, links = joined_inside(x, pdf["gap"].to_numpy(float), pdf["alone"].to_numpy(bool))
    ids, empty = pdf["id"], len(pdf) - len(links)
    return pd.DataFrame({"ball": pdf["ball"], "id": ids, "x": pdf["x"], "gap": pdf["gap"], "comp": ids.iloc[comp].to_numpy(),
                         "d": [d for d, _, _ in links] + [None] * empty,
                         "a": pd.Series([ids[i] for _, i, _ in links] + [None] * empty, dtype=object),
                         "b": pd.Series([ids[i] for _, _, i in links] + [None] * empty, dtype=object)})


def _ask_leaf(pdf: pd.DataFrame) -> pd.DataFrame:
    """The shortest links (comp, id, to, d) that a leaf's components have inside it."""
    pdf, x = _blocks(pdf)
    comp = pd.factorize(pdf["comp"])[0]
    d, to = _nearest_outsiders(_gaps(x), comp)
    least = np.full(len(pdf), np.inf)
    np.minimum.at(least, comp, d)
    best = np.flatnonzero(np.isfinite(d) & (d == least[comp]))
    return pd.DataFrame({"comp": pdf["comp"].iloc[best].to_numpy(), "id": pdf["id"].iloc[best].to_numpy(), "to": pdf["id"].iloc[to[best]].to_numpy(), "d": d[best]})


def _kd_order(x: np.ndarray) -> np.ndarray:
    """(blocks, BLOCK) places of points that lie close together: halves along the widest side, level by
    level. The last places are filled up with the first point again."""
    blocks = 1
    while blocks * BLOCK < len(x):
        blocks *= 2
    order = np.r_[np.arange(len(x)), np.zeros(blocks * BLOCK - len(x), int)][None]
    while len(order) < blocks:
        part = x[order]
        side = np.argmax(part.max(axis=1) - part.min(axis=1), axis=1)
        along = np.take_along_axis(part, side[:, None, None], axis=2)[:, :, 0]
        order = np.take_along_axis(order, np.argsort(along, axis=1, kind="stable"), axis=1).reshape(2 * len(order), -1)
    return np.sort(order, axis=1)  # equally near points of a block are found in the order of their ids


def tree_of(x: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(d, a, b): the minimum spanning tree of points in order of their nodes (0, 1, ..; points of one
    node are joined from the start), ties by the least and then the greatest end. Every round each
    component takes its shortest link; only pairs of blocks that its best link so far reaches are compared."""
    order = _kd_order(x)
    pts, nodes = x[order], node[order]
    lo, hi = pts.min(axis=1), pts.max(axis=1)
    comp = np.arange(node[-1] + 1)
    out = []

    def near(rows: slice) -> np.ndarray:
        """Least distances between some boxes and all."""
        total = np.zeros((len(lo[rows]), len(lo)))
        for i in range(x.shape[1]):
            total += np.maximum(np.maximum(lo[rows, None, i] - hi[None, :, i], lo[None, :, i] - hi[rows, None, i]), 0.0) ** 2
        return np.sqrt(total) * (1 - balls.SLACK)

    while True:
        own = comp[nodes]
        one = np.where(own.min(axis=1) == own.max(axis=1), own[:, 0], -1)
        if (own == own[0, 0]).all():
            return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0), np.zeros(0, int), np.zeros(0, int))
        best, found = np.full(len(comp), np.inf), []

        def compare(p: np.ndarray, q: np.ndarray) -> None:
            """Shortest links of the points of blocks ``p`` to those of blocks ``q``, and back."""
            for at in range(0, len(p), PAIRS):
                i, j = p[at:at + PAIRS], q[at:at + PAIRS]
                d = np.zeros((len(i), BLOCK, BLOCK))
                for c in range(x.shape[1]):
                    d += (pts[i][:, :, None, c] - pts[j][:, None, :, c]) ** 2
                d = np.sqrt(d)
                d[own[i][:, :, None] == own[j][:, None, :]] = np.inf
                for a, b, axis in ((i, j, 2), (j, i, 1)):
                    to = d.argmin(axis=axis)
                    gap = np.take_along_axis(d, np.expand_dims(to, axis), axis).squeeze(axis)
                    good = np.isfinite(gap) & (gap <= best[own[a]])
                    mine, theirs, gap = nodes[a][good], np.take_along_axis(nodes[b], to, axis=1)[good], gap[good]
                    np.minimum.at(best, comp[mine], gap)
                    still = gap <= best[comp[mine]]
                    found.append((gap[still], mine[still], theirs[still]))

        mixed = np.flatnonzero(one < 0)
        compare(mixed, mixed)
        step = max(1, 2 ** 22 // len(lo))
        for stage in ("nearest", "all"):
            most = np.where(one < 0, best[own].max(axis=1), best[one])
            for at in range(0, len(lo), step):
                rows = np.arange(at, min(at + step, len(lo)))
                gap = near(slice(rows[0], rows[-1] + 1))
                gap[(one[rows, None] == one[None, :]) & (one[rows, None] >= 0)] = np.inf
                gap[rows - at, rows] = np.inf
                if stage == "nearest":  # a first bound for every component
                    to = gap.argmin(axis=1)
                    least = gap[rows - at, to]
                    # of a block of one component only if it comes closest so far
                    asks = np.isfinite(least) & (least <= most[rows])
                    if asks.any():
                        first = np.lexsort((least[asks], one[rows][asks]))
                        r, t, own_one = rows[asks][first], to[asks][first], one[rows][asks][first]
                        keep = (own_one < 0) | np.r_[True, own_one[1:] != own_one[:-1]]
                        compare(r[keep], t[keep])
                else:
                    reach = gap <= np.maximum(most[rows, None], most[None, :])
                    p, q = np.nonzero(reach & (rows[:, None] < np.arange(len(lo))[None, :]))
                    closest = np.argsort(gap[p, q], kind="stable")
                    for part in range(0, len(p), 64 * PAIRS):
                        i, j = p[closest[part:part + 64 * PAIRS]], q[closest[part:part + 64 * PAIRS]]
                        now = lambda b: np.where(one[b] < 0, best[own[b]].max(axis=1), best[one[b]])
                        still = gap[i, j] <= np.maximum(now(rows[i]), now(j))
                        compare(rows[i[still]], j[still])
        d, a, b = (np.concatenate(c) for c in zip(*found, strict=True))
        who, other = comp[a], comp[b]
        a, b = np.minimum(a, b), np.maximum(a, b)
        pick = np.lexsort((b, a, d, who))
        pick = pick[np.r_[True, who[pick][1:] != who[pick][:-1]]]
        up = np.arange(len(comp))
        up[who[pick]] = other[pick]
        twice = up[up] == np.arange(len(comp))  # two that chose the same link: the least is the root, the link counts once
        root = twice & (np.arange(len(comp)) < up)
        drop = root[who[pick]]
        up[root] = np.flatnonzero(root)
        out.append((d[pick][~drop], a[pick][~drop], b[pick][~drop]))
        while (up != up[up]).any():
            up = up[up]
        comp = up[comp]


def cut_tree(d: np.ndarray, a: np.ndarray, b: np.ndarray, nodes: int, k: int) -> np.ndarray:
    """The cluster of each node once the k - 1 longest links are cut, numbered by their least nodes."""
    kept = np.lexsort((b, a, d))[:max(0, len(d) - (k - 1))]
    root = list(range(nodes))
    for i, j in zip(a[kept].tolist(), b[kept].tolist(), strict=True):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        while root[j] != j:
            root[j] = root[root[j]]
            j = root[j]
        root[max(i, j)] = min(i, j)
    for i, up in enumerate(root):  # a root is the least of its nodes
        root[i] = root[up]
    return np.unique(np.array(root), return_inverse=True)[1]


def _linked_in_one_task(points: DataFrame, k: int, dims: int, first: int) -> DataFrame:
    """(id, cluster) of a bounded number of locations, by the spanning tree's cut; clusters from ``first`` on."""
    ship_package(points.sparkSession)
    xs = [f"x{i}" for i in range(dims)]

    def linked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", kind="stable")
        node, ids = pd.factorize(pdf["id"])
        return pd.DataFrame({"id": ids, "cluster": first + cut_tree(*tree_of(pdf[xs].to_numpy(float), node), len(ids), k)})

    named = points.filter("id IS NOT NULL").select("id", *[F.get("x", F.lit(i)).alias(n) for i, n in enumerate(xs)], F.lit(0).alias("all"))
    return named.groupBy("all").applyInPandas(linked, f"id {points.schema['id'].dataType.simpleString()}, cluster int")


def _by_leaf(df: DataFrame):
    """Rows by leaf over all cores: a leaf's work is the square of its rows, far more than its bytes tell."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, "ball").groupBy("ball")


def spanning_tree(points: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(d, a, b): the minimum spanning tree of ``points`` (id, x; all locations distinct),
    ties by the least and then the greatest end. An id of several locations is one node."""
    ship_package(points.sparkSession)
    kind = points.schema["id"].dataType.simpleString()
    named = points.select("id", "x").filter("id IS NOT NULL").withColumn("alone", F.count("*").over(Window.partitionBy("id")) > 1)
    tree = balls.build(named, leaf_rows, gap=True)
    at = materialize(_by_leaf(tree.points.select("ball", "id", "x", "gap", "alone")).applyInPandas(
        _join_leaf, f"ball string, id {kind}, x array<double>, gap double, comp {kind}, d double, a {kind}, b {kind}"), "link-at")
    out = at.filter("d IS NOT NULL").select("d", "a", "b")
    at = at.select("ball", "id", "x", "gap", "comp")
    ends = at.agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).first()
    while ends["lo"] != ends["hi"]:
        other = at.select("ball", F.col("id").alias("to"), F.col("x").alias("y"), F.col("comp").alias("its"))
        d = balls.distance(F.col("x"), F.col("y")).alias("d")
        inside = materialize(_least(_by_leaf(at).applyInPandas(_ask_leaf, f"comp {kind}, id {kind}, to {kind}, d double")), "link-inside")
        bounded = at.join(inside.select("comp", F.col("link.d").alias("bound")), "comp", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
        bounded = materialize(bounded, "link-bounds")
        # each leaf asks as one: its middle, with its widest bound and its radius; its component if it has only one.
        # A point with no other leaf's point within its bound asks nothing
        asks_out = balls.within(F.col("gap"), F.col("bound"))
        leaves = materialize(bounded.groupBy("ball").agg(F.max(F.when(asks_out, F.col("bound"))).alias("most"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).join(tree.leaves, "ball"), "link-leaves")
        asks = leaves.filter("most IS NOT NULL").select(F.col("ball").alias("leaf_a"), F.col("c").alias("x"), (F.col("most") + F.col("r")).alias("bound"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("one"))
        ups = F.transform(F.sequence(F.lit(0), F.length("ball")), lambda n: F.substring(F.col("ball"), F.lit(1), n))
        uniform = (leaves.select(F.explode(ups).alias("ball"), "lo", "hi").groupBy("ball").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
                   .filter("lo = hi").select(F.col("ball").alias("kb"), F.col("lo").alias("own")))
        pruned = balls.Balls(tree.points, tree.leaves, [
            level.select("ball", F.explode("kids").alias("k")).join(uniform, F.col("k.ball") == F.col("kb"), "left")
            .groupBy("ball").agg(F.collect_list(F.struct("k.ball", "k.c", "k.r", "k.n", "k.leaf", "own")).alias("kids")) for level in tree.inner])
        pairs = pruned.reached(asks, "bound", keep=F.col("one").isNull() | F.col("kid.own").isNull() | (F.col("one") != F.col("kid.own")))
        pairs = pairs.filter("leaf_a <> ball OR bound = double('infinity')").select("leaf_a", "ball")
        mine = bounded.filter(asks_out).select(F.col("ball").alias("leaf_a"), "id", "x", "comp", "bound")
        # a point asks a ball only if the ball reaches into its own component's bound
        asked = (mine.join(pairs.join(tree.leaves, "ball"), "leaf_a")
                 .filter(balls.within(balls.distance(F.col("x"), F.col("c")) - F.col("r"), F.col("bound"))).select("id", "x", "comp", "bound", "ball"))
        outside = _least(asked.join(other, "ball").filter("comp <> its").select("comp", "id", "to", d, "bound").filter(F.col("d") <= F.col("bound")))
        links = materialize(inside.union(outside).groupBy("comp").agg(F.min("link").alias("link")).select("link.*").distinct(), "link-round")
        out = out.union(links)
        comps = at.select("id", "comp").distinct()
        met = links.join(comps.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a").join(comps.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b")
        roots = connected_components(met.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        seen = Observation()
        at = at.join(roots.withColumnRenamed("node", "comp"), "comp", "left").select("ball", "id", "x", "gap", F.coalesce("root", "comp").alias("comp"))
        at = materialize(at.observe(seen, F.min("comp").alias("lo"), F.max("comp").alias("hi")), "link-at")
        ends = seen.get
    return out


def _numbered(named: DataFrame) -> DataFrame:
    """(id, cluster): clusters (``name``, k of them) numbered by their least id."""
    order = named.groupBy("name").agg(F.min("id").alias("first"))
    order = order.select("name", (F.row_number().over(Window.orderBy("first")) - 1).alias("cluster"))  # k rows
    return named.join(F.broadcast(order), "name").select("id", "cluster")


def single_linkage(points: DataFrame, k: int, leaf_rows: int = LEAF_ROWS, whole: int = WHOLE) -> DataFrame:
    """(id, cluster) of distinct locations (id, x): k clusters by the spanning tree's cut."""
    widest = points.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dims"), F.max(F.array_max(F.transform("x", F.abs))).alias("most"),
                        F.count_if(F.col("id").isNull()).alias("unnamed")).first()
    # distances of what is no number, or beyond all numbers, are for the general way
    if widest["n"] and widest["n"] * widest["dims"] ** 2 <= whole and widest["most"] < 1e150:
        return _linked_in_one_task(points, k, widest["dims"], int(widest["unnamed"] > 0))  # rows without a key take a number, as below
    links = materialize(spanning_tree(points, leaf_rows), "link-tree")
    cut = links.orderBy(F.desc("d"), F.desc("a"), F.desc("b")).limit(max(0, k - 1))  # k - 1 rows
    kept = links.join(F.broadcast(cut), ["d", "a", "b"], "left_anti")
    roots = connected_components(kept.select("a", "b"))
    return _numbered(points.select("id").join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("name")))


def features_of(points: DataFrame, max_features: int = MAX_FEATURES) -> tuple[DataFrame, list, float]:
    """(points with ``ball``, features (ball, n, mean, first), error): at most ``max_features``
    balls; those of greatest radius are split first."""
    d_mean = lambda size: F.array(*[F.sum(F.col("x")[i] * F.col("n")) / F.sum("n") for i in range(size)])
    row = points.select(F.size("x").alias("d")).first()
    if row is None:
        return points.withColumn("ball", F.lit("")), [], 0.0
    rows = materialize(points.withColumn("ball", F.lit("")), "feature-points")
    while True:
        means = rows.groupBy("ball").agg(d_mean(row.d).alias("mean"), F.count("*").alias("locations"))
        spread = rows.join(F.broadcast(means), "ball").groupBy("ball").agg(F.first("locations").alias("locations"),
                                                                          F.max(balls.distance(F.col("x"), F.col("mean"))).alias("r"))
        now = spread.orderBy(F.desc("r"), "ball").collect()  # max_features rows
        left, split = max_features - len(now), []
        for b in now:
            grows = min(balls.FAN, b.locations) - 1
            if b.locations > 1 and grows <= left:
                split.append(b.ball)
                left -= grows
            elif b.locations > 1:
                break
        if not split:
            break
        chosen = F.col("ball").isin(split)
        draw = Window.partitionBy("ball").orderBy(F.xxhash64("x"), "x")
        pivots = (rows.filter(chosen).withColumn("_r", F.row_number().over(draw)).filter(F.col("_r") <= balls.FAN)
                  .groupBy("ball").agg(F.collect_list("x").alias("pivots")).withColumn("pivots", F.array_sort("pivots")))
        nearest = F.array_min(F.transform("pivots", lambda p, i: F.struct(balls.distance(F.col("x"), p).alias("d"), i.alias("i"))))["i"]
        rows = rows.join(F.broadcast(pivots), "ball", "left")
        rows = materialize(rows.withColumn("ball", F.when(F.col("pivots").isNull(), F.col("ball")).otherwise(F.concat("ball", F.lower(F.hex(nearest))))).drop("pivots"), "feature-points")
    feats = rows.groupBy("ball").agg(F.sum("n").alias("n"), d_mean(row.d).alias("mean"), F.min("id").alias("first")).orderBy("first").collect()
    return rows, feats, max((b.r for b in now), default=0.0)


def chains(means: np.ndarray, counts: np.ndarray, linkage: str) -> list[tuple[int, int, float]]:
    """All merges (a, b, height), lowest first, of the features by nearest-neighbour chains: from any
    cluster to its nearest until two are each other's nearest. These merges are the linkage's own, for
    a merged cluster is never nearer to others than both its parts were."""
    m, n = len(means), counts.astype(float).copy()
    means = means - means.mean(axis=0)
    gaps = ((means[:, None, :] - means[None, :, :]) ** 2).sum(axis=2) if m <= 512 else np.maximum(
        (means ** 2).sum(1)[:, None] + (means ** 2).sum(1)[None, :] - 2 * means @ means.T, 0.0)
    d = 2 * gaps * np.outer(n, n) / np.add.outer(n, n) if linkage == "ward" else np.sqrt(gaps)
    np.fill_diagonal(d, np.inf)
    alive, merges, chain = np.ones(m, bool), [], []
    while alive.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        a = chain[-1]
        b = int(np.argmin(d[a]))
        if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
            b = chain[-2]
        if len(chain) < 2 or b != chain[-2]:
            chain.append(b)
            continue
        chain = chain[:-2]
        a, b = min(a, b), max(a, b)
        height = d[a, b]
        if linkage == "ward":
            new = ((n[a] + n) * d[a] + (n[b] + n) * d[b] - n * height) / (n[a] + n[b] + n)
        elif linkage == "average":
            new = (n[a] * d[a] + n[b] * d[b]) / (n[a] + n[b])
        else:
            new = np.maximum(d[a], d[b])
        merges.append((a, b, float(height)))
        n[a] += n[b]
        alive[b] = False
        new[~alive] = np.inf
        new[a] = np.inf
        d[a, :], d[:, a] = new, new
        d[b, :], d[:, b] = np.inf, np.inf
    return sorted(merges, key=lambda x: x[2])


def agglomerative_labels(df: DataFrame, key: str, cols: list[str], k: int = 2, linkage: str = "ward",
                         max_features: int = MAX_FEATURES, out_col: str = "cluster") -> tuple[DataFrame, float]:
    """((key, cluster) of every row, error): ``k`` clusters by the linkage; fewer locations than
    ``k`` are each a cluster. ``error`` is 0 where the result is exact."""
    if linkage not in LINKAGES:
        raise ValueError(f"linkage must be one of {LINKAGES}")
    if k < 1:
        raise ValueError("k must be at least 1")
    rows, points = locations(df, key, cols)
    error = 0.0
    if linkage == "single":
        found = single_linkage(points, k)
    else:
        placed, feats, error = features_of(points, max_features)
        group = list(range(len(feats)))
        merges = chains(np.array([f["mean"] for f in feats]), np.array([f["n"] for f in feats]), linkage) if len(feats) > 1 else []
        # a chain's clusters keep the lower index; the lowest merges are taken, smaller heights first
        for a, b, _ in merges[:max(0, len(feats) - k)]:
            low, high = sorted((_root(group, a), _root(group, b)))
            group[high] = low
        firsts = sorted({_root(group, i) for i in range(len(feats))})
        named = [(f["ball"], firsts.index(_root(group, i))) for i, f in enumerate(feats)]  # features are in order of their least key
        table = df.sparkSession.createDataFrame(named, "ball string, cluster int")
        found = placed.join(F.broadcast(table), "ball").select("id", "cluster")
    out = rows.join(found.withColumnRenamed("id", "loc"), "loc")
    return out.select(F.col("key").alias(key), F.col("cluster").cast("int").alias(out_col)), float(error)


def _root(group: list[int], i: int) -> int:
    while group[i] != i:
        i = group[i]
    return i
