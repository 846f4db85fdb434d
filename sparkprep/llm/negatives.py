"""Hard-negative mining by Fagin's threshold algorithm.

Vectors become integers (floor of 256 times the entry) and are packed, where they
lie and without a shuffle, into blocks of at most ``BLOCK_ROWS`` rows; a block holds,
for every dimension, its rows sorted by that dimension. Anchors are packed likewise,
``CHUNK_ANCHORS`` at a time, and every block meets every chunk of anchors.

There an anchor reads each dimension's list from its high end where the anchor's own
entry is positive and from its low end where it is negative (sorted access). Rows
met are scored whole, in integers (random access). The products of the anchor's
entries with the last values read add up to the threshold, which no row unread
can exceed. An anchor is done with a block once the threshold lies strictly below
the kth score of each of its windows (or the window's lower end); ties are thus
all read. The kth scores are carried from block to block of a task. When lists
have been read so deep that most rows have been met, the rest is scored at once.

The first pass finds the anchors' positives (one window: the anchor's own label), the
second the negatives (a window for each positive score: other labels, scores between
two percentages of it). Scores are exact; one beyond a long stays at the long's end.

Defined results: rows with a null label, a null or empty vector, or null or non-finite
entries take no part, nor do those whose vector has another length than most
have; a null id orders after all others; a repeated row is another row, also
beside its anchor; repeated anchors each give their rows; a positive of negative
score has no negatives; an empty table gives an empty result; further columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .common import arrow_map

BLOCK_ROWS = 4096
CHUNK_ANCHORS = 512
FIRST_DEPTH = 16
# chunks whose best rows a task holds before it hands them on
HELD_CHUNKS = 64
LONGEST = (1 << 63) - 1

_PACKED = {"id": np.int64, "no_id": np.bool_, "label": np.int64, "uid": np.int64}


def _pack(batches: Iterator[pa.RecordBatch], d: int, size: int) -> Iterator[dict[str, np.ndarray]]:
    """Columns of ``size`` rows at a time (the last time fewer)."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        cols = {name: batch.column(name).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for name in ("id", "label", "uid")}
        cols["no_id"] = batch.column("id").is_null().to_numpy(zero_copy_only=False)
        cols["x"] = vectors.matrix(batch.column("x"), d)
        if "positives" in batch.schema.names:
            cols["positives"] = _lists(batch.column("positives"))
        held.append(cols)
        while sum(len(h["id"]) for h in held) >= size:
            whole = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            yield {c: v[:size] for c, v in whole.items()}
            held = [{c: v[size:] for c, v in whole.items()}]
    if held and sum(len(h["id"]) for h in held):
        yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}


def _lists(column: pa.Array) -> np.ndarray:
    """Lists of longs as an array of objects."""
    out = np.empty(len(column), object)
    out[:] = [list(v) for v in column.to_pylist()]
    return out


def _blocks(rows: DataFrame, d: int) -> DataFrame:
    """One row per block: its columns and, for each dimension, its rows by falling value."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pack(batches, d, BLOCK_ROWS):
            order = np.argsort(part["x"], axis=0)[::-1].astype(np.int32).T
            yield pa.RecordBatch.from_arrays(
                [pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in (*(part[c] for c in _PACKED), part["x"], order)],
                names=[*_PACKED, "x", "sorted"])

    return vectors.stored(arrow_map(rows, run, ", ".join(f"{c} binary" for c in (*_PACKED, "x", "sorted"))), "vector-blocks")


def _chunks(anchors: DataFrame, d: int) -> DataFrame:
    """One row per chunk of anchors: uids, labels, vectors and the scores of their positives."""
    has_positives = "positives" in anchors.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _pack(batches, d, CHUNK_ANCHORS):
            scores = [sorted(set(p)) for p in part["positives"]] if has_positives else [[] for _ in part["uid"]]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([part[c].tobytes()], pa.binary()) for c in ("uid", "label", "x")), pa.array([scores], pa.list_(pa.list_(pa.int64())))],
                names=["a_uid", "a_label", "a_x", "positives"])

    return vectors.stored(arrow_map(anchors, run, "a_uid binary, a_label binary, a_x binary, positives array<array<long>>"), "anchor-chunks")


class Block:
    """Sorted lists of some rows. Scores are doubles while these are exact."""

    def __init__(self, n: dict[str, np.ndarray], x: np.ndarray, order: np.ndarray):
        self.id, self.no_id, self.label, self.uid = (n[c] for c in _PACKED)
        self.x, self.order = x, order
        self.most = max(int(x.max()), -int(x.min()), 1)
        self._typed: dict[type, np.ndarray] = {}

    def typed(self, kind: type) -> np.ndarray:
        if kind not in self._typed:
            self._typed[kind] = self.x.astype(kind)
        return self._typed[kind]


def _exact_kind(d: int, most: int) -> type:
    """The fastest number kind that holds every score: double, long, or Python's integers."""
    return np.float64 if d * most < 1 << 53 else np.int64 if d * most < 1 << 63 else object


class Best:
    """The best ``k`` rows of one window: scores from ``low`` to ``high``."""

    def __init__(self, low: int | None, high: int | None, k: int):
        self.low, self.high, self.k = low, high, k
        self.rows: list[tuple[int, bool, int, int]] = []  # (-score, no id, id, uid)

    def closed(self, threshold: int) -> bool:
        """No row unread, of a score up to ``threshold``, can enter."""
        return (self.low is not None and threshold < self.low) or (len(self.rows) == self.k and threshold < -self.rows[-1][0])

    def offer(self, block: Block, at: np.ndarray, scores: np.ndarray) -> None:
        """Rows ``at`` of the block, of the window's labels, with their scores."""
        low = self.low
        if len(self.rows) == self.k:
            low = max(-self.rows[-1][0], low) if low is not None else -self.rows[-1][0]
        fits = np.ones(len(at), bool)
        if low is not None:
            fits &= scores >= low
        if self.high is not None:
            fits &= scores <= self.high
        at, scores = at[fits], scores[fits]
        if len(at) > self.k:
            kth = np.sort(scores)[-self.k]
            at, scores = at[scores >= kth], scores[scores >= kth]
        if len(at):
            if len(at) > self.k:  # ties
                first = np.lexsort((block.uid[at], block.id[at], block.no_id[at], -scores))[:self.k]
                at, scores = at[first], scores[first]
            new = [(-int(s), bool(block.no_id[i]), int(block.id[i]), int(block.uid[i])) for i, s in zip(at, scores, strict=True)]
            self.rows = sorted(self.rows + new)[:self.k]


def scan(block: Block, anchor: np.ndarray, label: int, uid: int, windows: list[Best], same: bool) -> int:
    """Bring an anchor's windows up to date with a block; the number of rows scored."""
    n, d = block.x.shape
    kind = _exact_kind(d, block.most * max(int(anchor.max()), -int(anchor.min()), 1))
    x, a = block.typed(kind), anchor.astype(kind)
    up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
    fits = (block.label == label) & (block.uid != uid) if same else block.label != label
    met = np.zeros(n, bool)
    read, depth = 0, FIRST_DEPTH
    while True:
        deep = depth >= n or (len(up) + len(down)) * depth >= 2 * n
        if deep:
            new = np.flatnonzero(~met)
        else:
            now = np.zeros(n, bool)
            now[block.order[up, read:depth]] = True
            now[block.order[down, n - depth:n - read]] = True
            new = np.flatnonzero(now & ~met)
            met |= now
        new = new[fits[new]]
        if len(new):
            scores = x[new] @ a
            if kind is object:
                scores = np.array([max(-LONGEST - 1, min(LONGEST, s)) for s in scores], object)
            for w in windows:
                w.offer(block, new, scores)
        if deep:
            return n
        threshold = int((a[up] * x[block.order[up, depth - 1], up]).sum() + (a[down] * x[block.order[down, n - depth], down]).sum())
        if all(w.closed(threshold) for w in windows):
            return int(met.sum())
        read, depth = depth, depth * 4


def _searched(blocks: DataFrame, chunks: DataFrame, d: int, k: int, same: bool, low: int, high: int) -> DataFrame:
    """(uid, window, no_id, id, c_uid, score): the best rows of each anchor and window in
    each task's blocks; ``window`` is the positive's score, 0 where labels are the same."""
    names = ["uid", "window", "no_id", "id", "c_uid", "score"]

    def best_of(held: dict) -> pa.RecordBatch:
        rows = [(uid, key, no_id, i, c, -s)
                for uids, windows in held.values() for uid, of_anchor in zip(uids, windows, strict=True)
                for key, w in of_anchor for s, no_id, i, c in w.rows]
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[list[int], list[list[tuple[int, Best]]]]] = {}
        last, block = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row].as_buffer()  # noqa: E731, B023
                if last is None or get("uid").to_pybytes() != last:
                    last = get("uid").to_pybytes()
                    x = np.frombuffer(get("x"), np.int64).reshape(-1, d)
                    block = Block({c: np.frombuffer(get(c), t) for c, t in _PACKED.items()}, x, np.frombuffer(get("sorted"), np.int32).reshape(d, -1))
                key = get("a_uid").to_pybytes()
                if key not in held:
                    if len(held) >= HELD_CHUNKS:
                        yield best_of(held)
                        held = {}
                    scores = batch.column("positives")[row].as_py()
                    windows = ([[(0, Best(None, None, k))] for _ in scores] if same else
                               [[(p, Best(-(-low * p // 100), high * p // 100, k)) for p in ps if low * p <= high * p] for ps in scores])
                    held[key] = (np.frombuffer(key, np.int64).tolist(), windows)
                uids, windows = held[key]
                labels, anchors = np.frombuffer(get("a_label"), np.int64), np.frombuffer(get("a_x"), np.int64).reshape(-1, d)
                for i, of_anchor in enumerate(windows):
                    if of_anchor:
                        scan(block, anchors[i], int(labels[i]), uids[i], [w for _, w in of_anchor], same)
        if held:
            yield best_of(held)

    # every block meets every chunk: rows of a few megabytes, neither side gathered or broadcast
    met = blocks.crossJoin(chunks.hint("shuffle_replicate_nl"))
    found = vectors.stored(arrow_map(met, run, "uid long, window long, no_id boolean, id long, c_uid long, score long"), "best-rows")
    order = Window.partitionBy("uid", "window").orderBy(F.desc("score"), "no_id", "id", "c_uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mined(df: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", label: Column | None = None,
          positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """For the rows where ``anchor`` holds: each of their first ``positives`` other rows of
    the same label, by falling integer inner product and then rising id, with the first
    ``negatives`` rows of other labels that score ``low`` to ``high`` percent of it.
    ``label`` may give the label instead of the column. One row per anchor, positive and
    negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    named = df.select(vectors.column(df, id_col).cast("long").alias("id"), (label if label is not None else vectors.column(df, label_col)).cast("long").alias("label"),
                      vectors.column(df, vec_col).alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = vectors.integer_vectors(named.filter(F.col("label").isNotNull()), F.col("v")).drop("v")
    rows = vectors.stored(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    rows, d = vectors.of_common_length(rows)
    if not d:
        empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return df.sparkSession.createDataFrame([], empty)
    columns = ("id", "label", "uid", "x")
    blocks, anchors = _blocks(rows.select(*columns), d), rows.filter("anchor").select(*columns)
    known = lambda no_id, value: F.when(~F.col(no_id), F.col(value))
    near = _searched(blocks, _chunks(anchors, d), d, positives, True, low, high)
    near = vectors.stored(near.select(F.col("uid"), known("no_id", "id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = near.groupBy("uid").agg(F.collect_set("positive_score").alias("positives"))
    far = _searched(blocks, _chunks(anchors.join(scores, "uid").select(*columns, "positives"), d), d, negatives, False, low, high)
    far = far.select("uid", F.col("window").alias("positive_score"), "rank", known("no_id", "id").alias("negative_id"), F.col("score").alias("negative_score"))
    return (near.join(far, ["uid", "positive_score"]).join(anchors.select("uid", F.col("id").alias("anchor_id")), "uid")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
