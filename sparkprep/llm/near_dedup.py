"""HyperMinHash near-duplicate groups.

One hash of every shingle picks a bucket and a value; a bucket's register keeps
the leading-zero count and ten mantissa bits of its least value (16 bits).
Empty buckets borrow, for banding only, the register of another bucket in an
order fixed per bucket, so a register of short texts agrees with probability J
as well. Bands of compressed registers make candidates, the collision-corrected
Jaccard estimate drops the hopeless ones, and the rest is confirmed on the full
shingle sets: linked if 100 * intersection >= threshold * union.

Who is compared, without all pairs of a band:

1. Texts with equal shingle sets become one node.
2. Each node is compared with the least node it shares a band with; confirmed
   links form trees, whose roots are found by pointer jumping.
3. Only bands that hold nodes of two or more trees are looked at again. In those
   of more than HOT nodes, nodes outside the band's most frequent tree are first
   compared with one node of it, picked by one of PICKS hashes of the nodes, so
   that over its bands a node meets several of them. Links between trees are
   joined by alternating star contraction.
4. Of the bands that are still mixed, those of up to HOT nodes compare outside
   nodes with all nodes of other trees. Larger ones hold many texts just under
   the threshold; there an exact prefix join finds the partners: of two linked
   sets, ordered by rarity, the first common shingle stands so early that what
   follows it in both suffices for the intersection. Sizes are part of the join
   key, so a shingle too late for partners of a size isn't paired with them.
   Either way a pair is made only if the sets' parity bitmaps allow it: a shingle
   of one set alone changes one bit, so sets that differ in more bits than linked
   sets have unequal shingles are not linked. Of texts just under the threshold
   few pairs are left, and no link is lost.

Only connections are asked for, so pairs inside one tree need no comparison.
At J = 0.8, a pair shares none of the 54 bands with probability 0.738 ** 54 = 7e-8.

Defined results: a text without words has no shingles and is linked with
nothing; with fewer words than a shingle the whole sequence is one; equal rows
get equal results; ids may repeat (each row is judged by its text); a group
whose ids are all null has a null component and its rows are kept; an empty
table gives an empty result; further columns are ignored by ``near_duplicates`` and
kept, whatever their names, by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from . import wordhash as wh
from .common import Packed, arrow_map, small, written

THRESHOLD = 80  # percent
BANDS, ROWS = 54, 6
REGISTERS = BANDS * ROWS
VALUE_BITS, MANTISSA = 40, 10
EMPTY = np.uint16(0xFFFF)
HOT = 32  # nodes of a band up to which its outside nodes meet all others
PICKS = 8
SIZE_STEP = 1.05  # ratio of size classes in the prefix join
PARITY = 16  # 64-bit words of a parity bitmap
# estimates this many standard errors under the threshold are dropped
SIGMAS = 5.0
_PROBES = np.argsort(np.random.Generator(np.random.PCG64(7)).random((REGISTERS, REGISTERS)), axis=0)


def shingle_sets(batch: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = wh.text_buffers(batch.column("text"))
    words, _, _, at = wh.word_hashes(data, offsets)
    for a, b in zip(at[:-1], at[1:], strict=True):
        w = words[a:b]
        if 0 < len(w) < k:  # the whole sequence, apart from any of k words
            yield wh.gram_hashes(w, len(w)) ^ np.uint64(len(w))
        else:
            yield np.unique(wh.gram_hashes(w, k))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of compressed registers per set."""
    least = np.full(len(sets) * REGISTERS, 1 << VALUE_BITS, np.uint64)
    for i, s in enumerate(sets):
        bucket = ((s >> np.uint64(VALUE_BITS)) * np.uint64(REGISTERS)) >> np.uint64(64 - VALUE_BITS)
        np.minimum.at(least[i * REGISTERS: (i + 1) * REGISTERS], bucket.astype(np.intp), s & np.uint64((1 << VALUE_BITS) - 1))
    width = np.frexp(least.astype(np.float64))[1]  # bits of the value
    zeros = np.maximum(VALUE_BITS - width, 0).astype(np.uint64)
    mantissa = ((least << zeros) >> np.uint64(VALUE_BITS - 1 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    code = ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)
    code[least == 1 << VALUE_BITS] = EMPTY
    return code.reshape(len(sets), REGISTERS)


def parities(sets: list[np.ndarray]) -> np.ndarray:
    """One row of PARITY words per set: a bit for every residue of the hashes, set if
    an odd number of the shingles has it."""
    odd = np.zeros((len(sets), PARITY * 64), np.uint8)
    for i, s in enumerate(sets):
        odd[i] = np.bincount((s % np.uint64(PARITY * 64)).astype(np.intp), minlength=PARITY * 64) & 1
    return np.packbits(odd, axis=1).view(np.int64)


def densified(regs: np.ndarray) -> np.ndarray:
    """Registers whose empty places hold that of the first full bucket in the
    place's own probe order. Every row must have a full one."""
    out = regs.copy()
    left = np.flatnonzero((out == EMPTY).any(axis=1))
    for probe in _PROBES:
        if not len(left):
            break
        part = out[left]
        part = np.where(part == EMPTY, regs[left][:, probe], part)
        out[left] = part
        left = left[(part == EMPTY).any(axis=1)]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key per row and band."""
    full = densified(regs).reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(regs), BANDS)).copy()
    for r in range(ROWS):
        h = wh.mix(h * np.uint64(0x9E3779B97F4A7C15) + full[:, :, r])
    return h


def jaccard_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimates for rows of registers, less the share of unequal least values
    that compress alike, and the number of buckets they rest on."""
    either = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    alike = ((a == b) & (a != EMPTY)).sum(axis=1)
    # least values are nearly exponential with rates n/K; a cell is about 0.72 * x / 2**mantissa wide at x
    chance = 0.7213 * 2.0 ** -MANTISSA * n_a * n_b / (n_a + n_b) ** 2.0
    share = alike / np.maximum(either, 1)
    return (share - chance) / (1 - chance), either


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in wh.slices(whole, "text"):
                sets = list(shingle_sets(batch, k))
                prints = [(int(s.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(wh.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))) if len(s) else 0) for s in sets]
                regs = registers(sets)
                bits = pa.ListArray.from_arrays(np.arange(0, (len(sets) + 1) * PARITY, PARITY, dtype=np.int32), pa.array(parities(sets).reshape(-1)))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), batch.column("text_hash"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(np.array([p[0] for p in prints], np.uint64).view(np.int64)),
                    pa.array(np.array([p[1] for p in prints], np.uint64).view(np.int64)),
                    pa.array([r.tobytes() for r in regs], pa.binary()), bits], names=["doc_id", "text_hash", "n", "fp1", "fp2", "regs", "bits"])
    return run


def _regs_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for first in range(0, whole.num_rows, 1024):
            batch = whole.slice(first, 1024)
            keys = band_keys(_regs_of(batch.column("regs")))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(batch.column("node").to_numpy(), BANDS)), pa.array(keys.reshape(-1).view(np.int64))], names=["node", "key"])


def _hopeful(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                n_a, n_b = (batch.column(c).to_numpy().astype(np.float64) for c in ("n_a", "n_b"))
                j, rests_on = jaccard_estimate(_regs_of(batch.column("regs_a")), _regs_of(batch.column("regs_b")), n_a, n_b)
                t = threshold / 100
                keep = (j >= t - SIGMAS * np.sqrt(t * (1 - t) / np.maximum(rests_on, 1))) & (100 * np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))
    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in wh.slices(whole, "text"):
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in shingle_sets(batch, k)], pa.binary())],
                                                 names=["node", "shingles"])
    return run


def _confirmed(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("s_a"), batch.column("s_b"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _links(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """The pairs (a, b) of nodes that are linked: estimated, then confirmed."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"))
    with_regs = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "regs_a", "regs_b")
    hopeful = written(arrow_map(with_regs, _hopeful(threshold), "a long, b long"), "hopeful-pairs")
    asked = hopeful.select(F.col("a").alias("node")).union(hopeful.select("b")).distinct()
    places = written(nodes.select("node", "rep", "rep_hash").join(asked, "node"), "asked-nodes")
    sets = written(arrow_map(_set_texts(places, docs), _sets(k), "node long, shingles binary").dropDuplicates(["node"]), "shingle-sets")
    with_sets = (hopeful.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s_a")), "a")
                 .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("s_b")), "b").select("a", "b", "s_a", "s_b"))
    return arrow_map(with_sets, _confirmed(threshold), "a long, b long")


def _tree_roots(parents: DataFrame) -> DataFrame:
    """(node, root) for a forest of (node, up) with up < node, by pointer jumping."""
    parents = written(parents, "tree-links")  # every step reads its links twice
    while True:
        up = parents.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = written(parents.join(up, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("__moved")), "tree-step")
        parents = step.select("node", "up")
        if step.filter("__moved").limit(1).count() == 0:
            return parents.select("node", F.col("up").alias("root"))


def _mixed(spots: DataFrame, tree: DataFrame) -> DataFrame:
    """(key, node, root, main, pick, nodes) of the bands whose nodes lie in two or
    more trees: the root of most nodes, one node of that tree, the band's size."""
    rooted = spots.select("node", "key").join(tree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mass = rooted.groupBy("key", "root").agg(F.count("*").alias("c"), F.min(F.struct(F.xxhash64("node", F.pmod("key", F.lit(PICKS))), "node")).alias("p"))
    of_key = (mass.groupBy("key").agg(F.count("*").alias("roots"), F.sum("c").alias("nodes"),
                                      F.max(F.struct("c", "root", "p.node")).alias("m"))
              .filter("roots > 1").select("key", F.col("m.root").alias("main"), F.col("m.node").alias("pick"), "nodes"))
    return rooted.join(of_key, "key").select("key", "node", "root", "main", "pick", "nodes")


def _joined(tree: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) after the trees of linked nodes are joined."""
    root_of = lambda x: tree.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    between = (links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left")
               .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    up = connected_components(between)
    moved = tree.join(up.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    alone = up.join(tree.select("node"), "node", "left_anti").filter("node != root")
    return written(moved.select("node", F.coalesce("top", "root").alias("root")).union(alone.select("node", "root")), "trees")


def _set_texts(places: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of nodes given with their representative row."""
    return docs.join(small(places), F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))).select("node", "text")


def _tokens(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in wh.slices(whole, "text", 1 << 18):
                sets = list(shingle_sets(batch, k))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("node").to_numpy(), [len(s) for s in sets])),
                                                  pa.array(np.concatenate(sets).view(np.int64))], names=["node", "token"])
    return run


def _may_link(a: str, b: str, n_a: str, n_b: str, threshold: int) -> Column:
    """Whether sets of these bitmaps and sizes can reach the threshold."""
    apart = reduce(add, (F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(PARITY)))
    return apart * (100 + threshold) <= (F.col(n_a) + F.col(n_b)) * (100 - threshold)


def _prefix_pairs(crowd: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, threshold: int) -> DataFrame:
    """Pairs (a, b) of different trees that can reach the threshold, one of them
    ``outer``, by an exact prefix and position join over ``crowd`` (node, root, outer, n, bits)."""
    t = threshold
    places = written(nodes.select("node", "rep", "rep_hash").join(crowd.select("node").distinct(), "node"), "crowd-nodes")
    tokens = written(arrow_map(_set_texts(places, docs), _tokens(k), "node long, token long").distinct(), "crowd-tokens")
    seen = tokens.groupBy("token").agg(F.count("*").alias("df"))
    ordered = tokens.join(seen, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("all"))
    prefix = (ordered.withColumn("n", F.size("all"))
              .select("node", "n", F.posexplode(F.expr(f"slice(all, 1, n - (n * {t} + 99) div 100 + 1)")).alias("pos", "s"))
              .select("node", "n", "pos", F.col("s.token").alias("token")))
    # a node is outer if it is so in any band
    marks = crowd.groupBy("node", "root").agg(F.max("outer").alias("outer"), F.first("bits").alias("bits"))
    prefix = written(prefix.join(marks, "node"), "crowd-prefixes")
    size_class = lambda n: F.floor(F.log(n.cast("double")) / F.log(F.lit(SIZE_STEP)))
    low = F.ceil(F.col("n") * t / 100)
    high = F.least(F.floor(F.col("n") * 100 / t), F.floor((F.col("n") - F.col("pos")) * (100 + t) / t) - F.col("n"))
    x = (prefix.filter("outer").withColumn("low", low).withColumn("high", high).filter("low <= high")
         .select("token", F.explode(F.sequence(size_class(F.col("low")), size_class(F.col("high")))).alias("class"), F.col("node").alias("x"),
                 F.col("n").alias("nx"), F.col("pos").alias("i"), F.col("root").alias("rx"), F.col("bits").alias("bx")))
    y = prefix.select("token", size_class(F.col("n")).alias("class"), F.col("node").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("j"),
                      F.col("root").alias("ry"), F.col("outer").alias("oy"), F.col("bits").alias("by"))
    reach = (F.least(F.col("nx") - F.col("i"), F.col("ny") - F.col("j")) * (100 + t) >= t * (F.col("nx") + F.col("ny")))
    pairs = x.join(y, (x["token"] == y["token"]) & (x["class"] == y["class"]) & (F.col("rx") != F.col("ry")) & reach & (~F.col("oy") | (F.col("x") < F.col("y")))
                   & _may_link("bx", "by", "nx", "ny", t))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def near_duplicates(df: DataFrame, k: int = 4, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept for every row."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = written(arrow_map(docs, _signatures(k), f"doc_id {kind}, text_hash long, n long, fp1 long, fp2 long, regs binary, bits array<long>"), "signatures")
    nodes = written(signed.filter("n > 0").groupBy("fp1", "fp2", "n")
                    .agg(F.min(F.struct("doc_id", "text_hash")).alias("r"), F.min("doc_id").alias("least_id"), F.first("regs").alias("regs"), F.first("bits").alias("bits"))
                    # numbered by id: the least of a band is often the text that the others were made from
                    .orderBy("r").select(F.monotonically_increasing_id().alias("node"), "fp1", "fp2", "n", F.col("r.doc_id").alias("rep"),
                            F.col("r.text_hash").alias("rep_hash"), "least_id", "regs", "bits"), "nodes")
    bands = arrow_map(nodes.select("node", "regs"), _bands, "node long, key long")
    shared = bands.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("__most")).filter("__most > pivot").drop("__most")
    spots = written(bands.join(shared, "key").select("node", "key", "pivot"), "bands")
    first = spots.groupBy("node").agg(F.min("pivot").alias("p")).filter("p < node").select(F.col("p").alias("a"), F.col("node").alias("b"))
    tree = _tree_roots(_links(first, nodes, docs, k, threshold).select(F.col("b").alias("node"), F.col("a").alias("up")))
    first_mixed = _mixed(spots, tree)
    picked = (first_mixed.filter(F.col("nodes") > HOT).filter("root != main").select(F.least("node", "pick").alias("a"), F.greatest("node", "pick").alias("b")).distinct())
    tree = _joined(tree, _links(picked, nodes, docs, k, threshold))
    mixed = written(_mixed(spots, tree).join(nodes.select("node", "n", "bits"), "node"), "mixed-bands")
    cool, hot = mixed.filter(F.col("nodes") <= HOT), mixed.filter(F.col("nodes") > HOT)
    outer = cool.filter("root != main").select("key", F.col("node").alias("x"), F.col("root").alias("root_x"), F.col("n").alias("nx"), F.col("bits").alias("bx"))
    inner = cool.select("key", F.col("node").alias("y"), F.col("root").alias("root_y"), (F.col("root") == F.col("main")).alias("is_main"),
                        F.col("n").alias("ny"), F.col("bits").alias("by"))
    met = (outer.join(inner, "key").filter("root_x != root_y AND (is_main OR x < y)").filter(_may_link("bx", "by", "nx", "ny", threshold))
           .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    crowd = written(hot.groupBy("node", "root", "n").agg(F.max(F.col("root") != F.col("main")).alias("outer"), F.first("bits").alias("bits")), "crowd")
    rest = met.union(_prefix_pairs(crowd, nodes, docs, k, threshold)).distinct()
    tree = _joined(tree, _links(rest, nodes, docs, k, threshold)).withColumnRenamed("root", "top")
    placed = (nodes.select("node", "fp1", "fp2", "n", "least_id").join(tree, "node", "left")
              .withColumn("top", F.coalesce("top", "node")))
    placed = written(placed, "placed")
    names = placed.groupBy("top").agg(F.min("least_id").alias("component_id"), F.count("*").alias("__c")).filter("__c > 1").drop("__c")
    named = (placed.join(names, "top", "left")
             .select("fp1", "fp2", "n", F.coalesce("component_id", "least_id").alias("component_id"), F.lit(True).alias("__linked")))
    out = signed.select("doc_id", "text_hash", "n", "fp1", "fp2").join(named, ["fp1", "fp2", "n"], "left")
    return (out.withColumn("component_id", F.when(F.col("__linked"), F.col("component_id")).otherwise(F.col("doc_id")))
            .select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def one_of_each(df: DataFrame, k: int = 5, threshold: int = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of each group: that of the least id and, of rows with
    this id, of the least text hash; equal rows stay once. Rows without words and
    groups without an id stay as they are."""
    packed = Packed(df, doc_id=id_col, text=text_col)
    found = written(near_duplicates(packed.df, k, threshold), "near-duplicates")
    stays = found.filter("kept AND n_shingles > 0 AND component_id IS NOT NULL")
    first = stays.groupBy("component_id").agg(F.min("text_hash").alias("__first"), F.count("*").alias("__c")).filter("__c > 1")
    later = stays.join(small(written(first, "first-hashes")), "component_id").filter("text_hash != __first")
    gone = found.filter("NOT kept").select("doc_id", "text_hash").union(later.select("doc_id", "text_hash")).distinct()
    gone = written(gone.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__th")), "gone")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th"))
    rows = packed.df.withColumn("__h", F.xxhash64("text")).join(small(gone), same, "left_anti")
    twice = written(stays.groupBy("doc_id", "text_hash").agg(F.count("*").alias("__c")).filter("__c > 1")
                    .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__th")), "twice")
    if twice.limit(1).count():
        again = rows.join(small(twice), same, "left_semi").dropDuplicates(["doc_id", "__h"])
        rows = rows.join(small(twice), same, "left_anti").unionByName(again)
    return packed.unpacked(rows)
