"""Byte pairs, whitening and hard negatives: libraries, brute force, odd rows."""

import hashlib
import random

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F
from sparkprep.llm import byte_pairs, negatives, qd, queries, vectors, whitening
from test_sets import ODD, SCHEMA


@pytest.fixture(scope="module")
def merger():
    return byte_pairs.PairMerger(byte_pairs.read_vocabulary())


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path(byte_pairs.MODEL_NAME))


def ids_of(merger, text):
    return np.frombuffer(merger.encode(text), np.int32).tolist()


def test_byte_pairs_equal_the_library(merger, library):
    rnd = random.Random(3)
    alphabet = "abehtsin \n\t.,'é中\U0001f600́\x00 　͸\x85\U0003d0001²½<|>"
    texts = ["", "a" * 1001, "a" * 20_000, " " * 3000 + "x", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>", "<|endoftext|",
             "I'll we've 'S 'T  two  spaces \n\n end \n"]
    texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(2000)]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        ids = ids_of(merger, text)
        assert ids == want
        assert merger.decode(ids) == library.decode(want, skip_special_tokens=False) == text


def test_classes_of_all_characters(merger, library):
    """Every code point, next to letters, digits, signs, spaces and itself."""
    for low in range(0, 0x110000, 64):
        text = "".join(f"a{c}a {c}1{c}!{c} {c}  {c}{c}a" for c in map(chr, range(low, low + 64)) if not "\ud800" <= c <= "\udfff")
        assert ids_of(merger, text) == library.encode(text, add_special_tokens=False).ids, hex(low)


def test_merges_by_brute_force(merger):
    """The segment tree's order against a scan for the leftmost lowest rank."""
    rnd = random.Random(5)
    for _ in range(300):
        symbols = [merger.first[b] for b in "".join(rnd.choice("abcenrt hio") for _ in range(rnd.randint(0, 40))).encode()]
        want = list(symbols)
        while True:
            ranks = [(merger.rank[p], i) for i, p in enumerate(zip(want, want[1:], strict=False)) if p in merger.rank]
            if not ranks:
                break
            r, i = min(ranks)
            want[i:i + 2] = [merger.made[r]]
        assert merger.merged(list(symbols)) == want


def test_long_texts_in_blocks(merger, monkeypatch):
    text = "one two  three\n" * 5000
    whole = merger.encode(text)
    monkeypatch.setattr(byte_pairs, "LONG_TEXT", 100)
    monkeypatch.setattr(byte_pairs, "WORD_BLOCK", 7)
    assert merger.encode(text) == whole


def test_byte_pairs_query_on_all_rows(spark, library):
    out = {r.doc_id: r for r in queries.op11(spark, SF_SMALL).collect()}
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        r = out[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_byte_pairs_odd_rows(spark):
    odd = spark.createDataFrame([(*r, "k", "s", "x", "w", "h") for r in ODD], SCHEMA)
    clash = odd.withColumns({"decoded": F.lit("old"), "k0": F.lit(1), "a.b": F.lit(2)})
    out = byte_pairs.encoded(clash, byte_pairs.read_vocabulary())
    assert [c for c in out.columns if c not in byte_pairs.OUTPUTS] == [c for c in clash.columns if c != "decoded"]
    rows = out.collect()
    assert len(rows) == len(ODD)
    assert all(r.decoded == (r.text or "") and r.n_tokens == len(r.token_ids) and r["a.b"] == 2 for r in rows)
    assert byte_pairs.encoded(odd.limit(0), byte_pairs.read_vocabulary()).collect() == []


VECTORS = "vec_id long, embedding array<float>, label int, uid string, x string, component int, `a.b` string"
INF, NAN = float("inf"), float("nan")


def vector_rows(n, seed, d=6, labels=3):
    """Clustered vectors with ties, copies and odd rows."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lab = rnd.randrange(labels)
        rows.append((i, [round(rnd.gauss(1.0 if j == lab else 0.0, 0.4), 1) for j in range(d)], lab))
    rows += [rows[3], (rows[5][0], rows[6][1], rows[5][2]), (n, None, 1), (n + 1, [None] * d, 1), (n + 2, [NAN] + [0.0] * (d - 1), 1), (n + 3, [INF] * d, 0),
             (n + 4, [], 2), (n + 5, [1.0] * (d + 1), 1), (n + 6, rows[0][1], None), (None, rows[1][1], rows[1][2]), (None, rows[2][1], rows[2][2])]
    return [(*r, "u", "x", 7, "dot") for r in rows]


def integers(rows, d=6):
    """The rows that take part, as (id, label, integer vector)."""
    return [(r[0], r[2], np.floor(256 * np.array(r[1], np.float32).astype(float)).astype(np.int64)) for r in rows
            if r[1] is not None and len(r[1]) == d and None not in r[1] and np.isfinite(r[1]).all()]


def test_whitening_by_eigenvectors(spark):
    rows = vector_rows(300, 1)
    out = whitening.whitened(spark.createDataFrame(rows, VECTORS).repartition(5), k=4)
    assert [c for c in out.columns if c not in whitening.OUTPUTS] == ["vec_id", "embedding", "label", "uid", "x", "a.b"]
    found = out.collect()
    kept = integers(rows)
    x = np.stack([v for _, _, v in kept])
    distinct = np.unique(x, axis=0)
    n, sums = len(distinct), distinct.sum(axis=0)
    centred = distinct - sums / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    want = sorted((i is None, i or 0, int(((n * v - sums) ** 2).sum()), j + 1, abs(round((v - sums / n) @ directions[:, j] / values[j] ** 0.5, 9)))
                  for i, _, v in kept for j in range(4))
    got = sorted((r.vec_id is None, r.vec_id or 0, r.deviation, r.component, abs(round(r.whitened, 9))) for r in found)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[4] for g in got], [w[4] for w in want], atol=1e-8)
    assert {r.n for r in found} == {n} and max(r.identity_error for r in found) < 1e-10
    assert all(abs(r.explained - values[r.component - 1] / values.sum()) < 1e-12 for r in found)


def test_whitening_far_from_zero_and_without_variance(spark):
    """A large common offset costs no digits; directions without variance are left out."""
    rnd = random.Random(2)
    data = [(i, [4096.0 * 1024 + rnd.randrange(64) / 64, 3.0, rnd.random()], 0) for i in range(200)]
    out = whitening.whitened(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).collect()
    assert {r.component for r in out} == {1, 2} and all(r.identity_error < 1e-10 for r in out)
    one = [(i, [1.0, 2.0], 0) for i in range(5)]
    schema = "vec_id long, embedding array<float>, label int"
    assert whitening.whitened(spark.createDataFrame(one, schema)).collect() == []
    assert whitening.whitened(spark.createDataFrame([], schema)).collect() == []
    wild = [(i, [1e300 * (-1) ** i, float(i)], 0) for i in range(6)]
    assert all(r.deviation is None for r in whitening.whitened(spark.createDataFrame(wild, "vec_id long, embedding array<double>, label int")).collect())


def test_singular_vectors():
    rng = np.random.default_rng(1)
    turn = lambda n: np.linalg.qr(rng.normal(size=(n, n)))[0]
    wilkinson = np.diag(np.abs(np.arange(-10, 11.0)) + 1) + np.diag(np.ones(20), 1)
    twice = np.hstack([rng.normal(size=(50, 6))] * 2)
    cases = [rng.normal(size=(300, 40)), np.diag(np.arange(1, 9.0)), np.eye(10) * 3, turn(40) @ np.diag([5.0] * 20 + [1.0] * 20) @ turn(40),
             turn(30) @ np.diag(10.0 ** -np.arange(30)) @ turn(30), wilkinson, twice, np.zeros((4, 4)), np.array([[2.0]]),
             *(rng.integers(-3, 4, size=(rng.integers(1, 12), rng.integers(1, 12))).astype(float) for _ in range(40))]
    for m in cases:
        r = whitening._triangle(m)
        values, v = qd.leading(r, 8)
        want = np.linalg.svd(r, compute_uv=False) ** 2
        assert np.allclose(values, want, rtol=1e-12, atol=1e-25 * max(want[0], 1.0))
        assert v.shape[1] == min(8, int((want > 1e-22 * max(want[0], 1e-300)).sum()))
        assert np.abs(v.T @ v - np.eye(v.shape[1])).max(initial=0) < 1e-12
        assert np.abs(r.T @ (r @ v) - v * values[:v.shape[1]]).max(initial=0) < 1e-12 * max(want[0], 1.0)


def mined_by_brute_force(rows, every, k_pos=5, k_neg=5):
    out = []
    order = lambda c: (-c[0], c[1] is None, c[1] or 0)
    for p, (i, lab, a) in enumerate(rows):
        if i is None or i % every:
            continue
        scored = [(int(a @ v), j, other) for q, (j, other, v) in enumerate(rows) if q != p]
        near = sorted((c for c in scored if c[2] == lab), key=order)[:k_pos]
        for score, j, _ in near:
            far = sorted((c for c in scored if c[2] != lab and 80 * score <= 100 * c[0] <= 100 * score), key=order)[:k_neg]
            out += [(i, j, rank, f[1], score, f[0]) for rank, f in enumerate(far, 1)]
    return out


@pytest.mark.parametrize("block", [4096, 64])
def test_hard_negatives_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", block)
    monkeypatch.setattr(negatives, "CHUNK_ANCHORS", 7)
    monkeypatch.setattr(negatives, "HELD_CHUNKS", 2)
    rows = vector_rows(400, 4)
    out = negatives.mined(spark.createDataFrame(rows, VECTORS).repartition(3), F.col("vec_id") % 10 == 0).collect()
    want = mined_by_brute_force([r for r in integers(rows) if r[1] is not None], 10)
    key = lambda r: tuple((c is None, c or 0) for c in r)
    # of rows of one score and id (copies) any may come first
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key) and len(want) > 200


def test_threshold_stops_early_and_ties_are_read():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 5, size=(3000, 8))
    x[100:110] = 50
    names = {"id": np.arange(3000), "no_id": np.zeros(3000, bool), "label": np.zeros(3000, np.int64), "uid": np.arange(3000)}
    block = negatives.Block(names, x, np.argsort(x, axis=0)[::-1].T)
    best = negatives.Best(None, None, 5)
    scored = negatives.scan(block, np.ones(8, np.int64), 0, 2000, [best], same=True)
    assert scored < 1000 and [i for _, _, i, _ in best.rows] == [100, 101, 102, 103, 104]


def test_hard_negatives_of_few_and_of_huge_rows(spark):
    schema = "vec_id long, embedding array<double>, label int"
    always = F.lit(True)
    assert negatives.mined(spark.createDataFrame([], schema), always).collect() == []
    assert negatives.mined(spark.createDataFrame([(0, [1.0], 1)], schema), always).collect() == []
    huge = [(0, [1e300, -1e300], 1), (1, [1e300, -1e300], 1), (2, [1e300, -1e300], 2), (3, [-1e300, 1.0], 2)]
    out = negatives.mined(spark.createDataFrame(huge, schema), always).collect()
    assert {(r.anchor_id, r.negative_id) for r in out} == {(0, 2), (1, 2)} and {r.positive_score for r in out} == {2 ** 63 - 1}


def test_vector_queries_on_all_rows(spark):
    rows = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    out = queries.op12(spark, SF_SMALL)
    assert out.columns == ["vec_id", *whitening.OUTPUTS] and out.count() == 4 * rows.count()
    blocks = negatives._blocks(vectors.integer_vectors(rows.select(F.col("vec_id").alias("id"), F.col("label").cast("long"), F.lit(1).cast("long").alias("uid"), "embedding"), F.col("embedding")), 64)
    plan = blocks.crossJoin(blocks.hint("shuffle_replicate_nl"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_merging_by_a_tree_of_any_fan_out(merger, monkeypatch, fan):
    monkeypatch.setattr(byte_pairs, "FAN", fan)
    rng = np.random.default_rng(fan)
    for size in (2, 3, 15, 17, 18, 40, 257, 1200):
        for letters in ("ab", "etaoinshr", "0123456789abcdef", "aaaaaab", "é中a"):
            symbols = [merger.first[b] for b in "".join(rng.choice(list(letters), size)).encode()]
            want = list(symbols)
            while len(want) > 1 and (best := min((merger.rank.get(p, byte_pairs.NEVER), i) for i, p in enumerate(zip(want, want[1:], strict=False))))[0] != byte_pairs.NEVER:
                want[best[1]:best[1] + 2] = [merger.made[best[0]]]
            assert merger.merged(symbols) == want
