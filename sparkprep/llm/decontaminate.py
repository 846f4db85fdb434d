"""Benchmark decontamination by greedy string tiling.

Seeds are runs of ``k`` words (lower-cased A-Z). One pass over the documents
keeps only the word runs whose seeds pass a Bloom filter of the benchmark's
seeds (sized by their number); these join the
benchmark on the seed. For each document and item that share a seed, tiles are
placed greedily: the longest matches, found by running Karp-Rabin hashes of
falling window lengths, are marked first and marked words take part in no other
match. A test item is leaked if tiles cover ``threshold`` of its words, in
whatever order they stand in the document.

Every match of ``k`` words or more consists of seeds, so the kept runs hold all
matches of a document.

Defined results: null or blank documents and items match nothing; an item of
fewer than ``k`` words is a seed as a whole; rows with equal id and text are one
document; ids may be null; empty tables give no matches; ``decontaminated`` keeps
further columns, but for those of its own names, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as wh
from .common import Packed, arrow_map, reliable, small, written

SEED_WORDS = 5
THRESHOLD = 0.5
# bits of the filter: 16 a seed (of other words two in a hundred pass), from one megabyte to 32
SEED_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 23, 1 << 28
BROADCAST_BYTES = 64 << 20
FIRST_WINDOW = 20
_MODULUS = (1 << 61) - 1


def _grams(words: np.ndarray, length: int) -> np.ndarray:
    return wh.gram_hashes(words, length) ^ np.uint64(length)


def _passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have both their bits in the filter."""
    mask = np.uint64(8 * len(bitmap) - 1)

    def bit(at: np.ndarray) -> np.ndarray:
        return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
    return (bit(hashes & mask) & bit((hashes >> np.uint64(32)) & mask)).astype(bool)


def _item_seeds(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in wh.slices(whole, "text"):
                data, offsets = wh.text_buffers(batch.column("text"))
                words, _, _, at = wh.word_hashes(data, offsets)
                rows, seeds, sizes = [], [], []
                for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    if b > a:
                        g = np.unique(_grams(words[a:b], min(k, b - a)))
                        rows += [i] * len(g)
                        seeds.append(g)
                        sizes += [min(k, b - a)] * len(g)
                seeds = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(rows, pa.int64())), pa.array(seeds.view(np.int64)),
                                                  pa.array(sizes, pa.int32())], names=["item", "seed", "size"])
    return run


def seed_bitmap(seeds: DataFrame) -> bytes:
    """Two bits set for each seed, in a filter sized by their number; a row for each 32768 bits reaches the driver."""
    bits = LEAST_BITS
    n = seeds.count()
    while bits < min(SEED_BITS * n, MOST_BITS):
        bits *= 2
    mask = bits - 1
    spots = seeds.select(F.explode(F.array(F.col("seed").bitwiseAND(F.lit(mask).cast("long")),
                                           F.shiftrightunsigned("seed", 32).bitwiseAND(F.lit(mask).cast("long")))).alias("p"))
    rows = spots.select(F.expr("p div 32768").alias("part"), F.expr("p % 32768").alias("bit")) \
        .groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()
    bitmap = bytearray(bits // 8)
    for r in rows:
        bitmap[r["part"] * 4096: (r["part"] + 1) * 4096] = r["bits"]
    return bytes(bitmap)


def _shared_runs(bitmap: bytes, sizes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(bitmap, np.uint8)
        for whole in batches:
            for batch in wh.slices(whole, "text"):
                data, offsets = wh.text_buffers(batch.column("text"))
                words, starts, ends, at = wh.word_hashes(data, offsets)
                inside = np.zeros(len(words) + 1, np.int64)  # +1 where a seed begins, -1 behind its end
                found: dict[int, list[int]] = {}
                for size in sizes:
                    g = _grams(words, size)
                    hits = np.flatnonzero(_passes(bits, g))
                    hits = hits[hits + size <= at[np.searchsorted(at, hits, "right")]]
                    np.add.at(inside, hits, 1)
                    np.add.at(inside, hits + size, -1)
                    for h in hits.tolist():
                        found.setdefault(h, []).append(int(g[h].view(np.int64)))
                edges = np.diff(np.concatenate([[False], np.cumsum(inside[:-1]) > 0, [False]]).astype(np.int8))
                rows, begin, text, seeds = [], [], [], []
                for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
                    while a < b:  # a run ends with its document
                        row = int(np.searchsorted(at, a, "right")) - 1
                        stop = min(b, int(at[row + 1]))
                        rows.append(row)
                        begin.append(int(a - at[row]))
                        text.append(bytes(data[starts[a]: ends[stop - 1]]).lower())
                        seeds.append(sorted({s for w in range(a, stop) for s in found.get(w, ())}))
                        a = stop
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(take), batch.column("text_hash").take(take), pa.array(begin, pa.int64()),
                    pa.array(text, pa.binary()).cast(pa.string()), pa.array(seeds, pa.list_(pa.int64()))],
                    names=["doc_id", "text_hash", "start", "run", "seeds"])
    return run


def _windows(ids: list[int], marked: list[bool], length: int) -> Iterator[tuple[int, int]]:
    """(hash, start) of the unmarked windows of ``length``, by a running hash."""
    if len(ids) < length:
        return
    top = pow(1_000_003, length - 1, _MODULUS)
    h, last_marked = 0, -1
    for i, x in enumerate(ids):
        if i >= length:
            h = (h - ids[i - length] * top) % _MODULUS
        h = (h * 1_000_003 + x) % _MODULUS
        if marked[i]:
            last_marked = i
        if i >= length - 1 and i - last_marked >= length:
            yield h, i - length + 1


def tiles(item: list, doc: list, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (item start, doc start, length) of ``least`` words or more.
    A ``None`` in ``doc`` matches nothing."""
    number: dict = {}
    a = [number.setdefault(w, len(number) + 1) for w in item]
    b = [number.get(w, 0) if w is not None else 0 for w in doc]
    gone_a, gone_b = [False] * len(a), [x == 0 for x in b]
    placed, window = [], max(least, min(FIRST_WINDOW, len(a)))
    while True:
        index: dict[int, list[int]] = {}
        for h, i in _windows(a, gone_a, window):
            index.setdefault(h, []).append(i)
        matches = []
        for h, j in _windows(b, gone_b, window):
            for i in index.get(h, ()):
                if a[i: i + window] != b[j: j + window] or (i and j and a[i - 1] == b[j - 1] and not gone_a[i - 1] and not gone_b[j - 1]):
                    continue  # unequal, or part of a match that begins earlier
                n = window
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not gone_a[i + n] and not gone_b[j + n]:
                    n += 1
                matches.append((n, i, j))
        longest = max(matches, default=(0,))[0]
        if longest > 2 * window:  # longer matches first
            window = longest
            continue
        queue = sorted(matches, key=lambda m: (-m[0], m[1], m[2]))
        while queue:
            n, i, j = queue.pop(0)
            free = [not gone_a[i + d] and not gone_b[j + d] for d in range(n)]
            if all(free):
                placed.append((i, j, n))
                gone_a[i: i + n] = gone_b[j: j + n] = [True] * n
                continue
            d = 0
            while d < n:  # what an earlier tile leaves of the match
                e = d
                while e < n and free[e]:
                    e += 1
                if e - d >= window:
                    queue.append((e - d, i + d, j + d))
                d = e + 1
            queue.sort(key=lambda m: (-m[0], m[1], m[2]))
        if window <= least:
            return sorted(placed)
        window = max(window // 2, least)


def _tiled(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int64()), ("length", pa.int32())]))
        for batch in batches:
            covered, sizes, placed = [], [], []
            for item, runs in zip(batch.column("item_text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                words, doc, at = item.encode().lower().split(), [], []
                for r in runs:
                    w = r["run"].encode().split()
                    doc += [*w, None]
                    at += [*range(r["start"], r["start"] + len(w)), -1]
                found = tiles(words, doc, min(k, len(words)))
                covered.append(sum(n for _, _, n in found))
                sizes.append(len(words))
                placed.append([{"item_start": i, "doc_start": at[j], "length": n} for i, j, n in found])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text_hash"), batch.column("item"), pa.array(covered, pa.int32()), pa.array(sizes, pa.int32()),
                pa.array([c / s for c, s in zip(covered, sizes, strict=True)], pa.float64()), pa.array(placed, kind)],
                names=["doc_id", "text_hash", "item", "covered", "item_words", "coverage", "tiles"])
    return run


def matches(df: DataFrame, benchmark: DataFrame, k: int = SEED_WORDS, id_col: str = "doc_id", text_col: str = "text",
            item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, text_hash, item, covered, item_words, coverage and tiles of every
    document and item that share a seed."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    # an item is known by a number of its own: its id may be null or repeat
    items = written(benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.col(item_text).alias("text")), "items")
    seeds = reliable(arrow_map(items.select("item", "text"), _item_seeds(k), "item long, seed long, size int"))
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())  # at most k rows
    kind = docs.schema["doc_id"].dataType.simpleString()
    runs = written(arrow_map(docs, _shared_runs(seed_bitmap(seeds), sizes),
                             f"doc_id {kind}, text_hash long, start long, run string, seeds array<long>").withColumn("at", F.monotonically_increasing_id()), "shared-runs")
    # runs and items meet by number; the runs' texts are fetched once for each item that they meet
    met = runs.select("at", F.explode("seeds").alias("seed")).join(small(seeds.select("item", "seed")), "seed").select("at", "item").distinct()
    pairs = (runs.select("at", "doc_id", "text_hash", "start", "run").join(met, "at")
             .groupBy("doc_id", "text_hash", "item").agg(F.array_sort(F.collect_set(F.struct("start", "run"))).alias("runs")))
    texts = items.select("item", "item_id", F.col("text").alias("item_text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tiled = arrow_map(pairs.join(small(texts) if size <= BROADCAST_BYTES else texts, "item").select("doc_id", "text_hash", "item", "item_text", "runs"), _tiled(k),
                      f"doc_id {kind}, text_hash long, item long, covered int, item_words int, coverage double, "
                      "tiles array<struct<item_start: int, doc_start: long, length: int>>")
    return tiled.join(small(texts.select("item", "item_id")), "item").drop("item")


def decontaminated(df: DataFrame, benchmark: DataFrame, k: int = SEED_WORDS, threshold: float = THRESHOLD,
                   id_col: str = "doc_id", text_col: str = "text", **names: str) -> DataFrame:
    """``df`` with ``__coverage`` (of the most covered item), ``__items`` (leaked
    item ids, sorted) and ``__leaked``."""
    packed = Packed(df, doc_id=id_col, text=text_col)
    found = matches(packed.df, benchmark, k, **names)
    leaked = F.col("coverage") >= threshold
    by_doc = reliable(found.groupBy("doc_id", "text_hash").agg(
        F.max("coverage").alias("__coverage"), F.array_sort(F.collect_set(F.when(leaked, F.col("item_id")))).alias("__items"),
        F.bool_or(leaked).alias("__leaked")).withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"}))
    rows = packed.df.withColumn("__h", F.xxhash64("text"))
    out = rows.join(small(by_doc), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")), "left")
    out = (out.withColumn("__coverage", F.coalesce("__coverage", F.lit(0.0))).withColumn("__leaked", F.coalesce("__leaked", F.lit(False)))
            .withColumn("__items", F.coalesce("__items", F.array().cast(by_doc.schema["__items"].dataType)))
            .drop("__h", "__id", "__hash"))
    return packed.unpacked(out, ("__coverage", "__items", "__leaked"))
