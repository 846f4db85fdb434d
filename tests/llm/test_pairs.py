"""Near-duplicates and decontamination: brute force and odd rows."""

import collections
import random

import numpy as np
import pytest
from conftest import SF_CHECK, SF_SMALL
from sparkprep.llm import decontaminate, near_dedup, queries
from sparkprep.llm import wordhash as wh
from test_sets import LONG, ODD, SCHEMA


def low(text):
    return (text or "").encode().lower().split()


def shingles(text, k):
    w = low(text)
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(docs, k, threshold=80):
    """{row number: least id reachable} over all pairs that share a shingle."""
    sets = [shingles(t, k) for _, t in docs]
    up = list(range(len(docs)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    seen = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in seen[x]}:
            both = len(s & sets[j])
            if 100 * both >= threshold * len(s | sets[j]):
                up[find(i)] = find(j)
        for x in s:
            seen[x].append(i)
    least = collections.defaultdict(list)
    for i, (doc, _) in enumerate(docs):
        least[find(i)].append(doc)
    return [(len(sets[i]), docs[i][0] if not sets[i] else min((d for d in least[find(i)] if d is not None), default=None)) for i in range(len(docs))]


def compare(spark, docs, k=4):
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k).collect()
    want = [(d, n, c, d == c) for (d, _), (n, c) in zip(docs, components(docs, k), strict=True)]
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == collections.Counter(want)


def test_near_duplicates_by_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in queries.op2(spark, SF_CHECK).collect()}
    for (i, _), (n, c) in zip(docs, components(docs, 4), strict=True):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, c, i == c)


def test_links_of_trees_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    links = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (9, 8)], "node long, up long").mapInArrow(counted, "node long, up long")
    assert sorted(map(tuple, near_dedup._tree_roots(links).collect())) == [(1, 0), (2, 0), (3, 0), (9, 8)]
    assert made.value == 4


def test_chains_copies_and_borderline_pairs(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    docs, i = [], 0
    for _ in range(25):  # chains: neighbours are near, ends are not
        text = [rnd.choice(words) for _ in range(rnd.choice([12, 60, 300]))]
        for _ in range(8):
            docs.append((i, " ".join(text)))
            i += 1
            text = text[:]
            for _ in range(max(1, len(text) // 60)):
                text[rnd.randrange(len(text))] = rnd.choice(words)
    passage = " ".join(rnd.choice(words) for _ in range(60))
    for n in range(60):  # a passage in many texts makes no link
        docs.append((i, passage + " " + " ".join(rnd.choice(words) for _ in range(20 + n))))
        i += 1
    docs += [(i + n, "copy of one text in many rows " + passage) for n in range(40)]
    rnd.shuffle(docs)
    compare(spark, docs)


def test_texts_just_under_the_threshold_make_few_pairs(spark, monkeypatch):
    rnd = random.Random(11)
    base = [f"w{rnd.randrange(4000)}" for _ in range(300)]
    docs = []
    for i in range(80):
        text = base[:]
        for at in rnd.sample(range(300), 12 if i else 0):
            text[at] = f"v{rnd.randrange(100000)}"
        docs.append((i, " ".join(text)))
    made, links = [], near_dedup._links
    monkeypatch.setattr(near_dedup, "_links", lambda pairs, *rest: made.append(pairs.count()) or links(pairs, *rest))
    compare(spark, docs)
    assert len(made) == 3 and made[2] < 100  # of over 3000 pairs


def test_parity_bitmaps_lose_no_link(spark):
    rng = np.random.Generator(np.random.PCG64(9))
    x = rng.integers(0, 1 << 63, 40000, dtype=np.uint64)
    rows = []
    for n in (1, 5, 9, 130, 1000, 20000):
        for m in (n, n * 9 // 10, n * 8 // 10):
            for both in {0, m, m * 9 // 10, -(-8 * (n + m) // 18), -(-8 * (n + m) // 18) - 1}:
                if 0 <= both <= m:
                    a, b = near_dedup.parities([x[:n], x[n - both: n - both + m]]).tolist()
                    rows.append((a, b, n, m, 100 * both >= 80 * (n + m - both), 100 * both < 70 * (n + m - both)))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, n long, m long, linked boolean, far boolean")
    got = df.select("n", "linked", "far", near_dedup._may_link("a", "b", "n", "m", 80).alias("may")).collect()
    assert any(r.linked for r in got) and all(r.may for r in got if r.linked)
    assert not any(r.may for r in got if r.far and 5 <= r.n <= 1000)


def test_near_duplicates_odd_rows(spark):
    compare(spark, [(r[0], r[1]) for r in ODD])
    compare(spark, [(1, "A b"), (2, "a B"), (3, "a b c"), (4, "a b c d"), (5, "A\tb\nc d"), (6, ""), (7, None), (8, LONG), (9, LONG + "x")])
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_of_each_group_stays(spark):
    rows = [(5, "a b c d e f g", "x"), (3, "a b c d e f g", "y"), (3, "a b c d e f g", "y"), (9, "other text of some words here", "z"),
            (9, "other text of some words here", "q"), (7, "", "e"), (8, None, "e"), (None, "alone without any id at all", "n")]
    out = near_dedup.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, kept string")).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in out) == [-1, 3, 7, 8, 9]
    assert out[0].asDict().keys() == {"doc_id", "text", "kept"}


@pytest.mark.parametrize("share", [0.3, 0.6, 0.8, 0.95])
def test_collision_corrected_estimate(share):
    rng = np.random.Generator(np.random.PCG64(5))
    errors = []
    for _ in range(40):
        n = 3000
        both = int(round(2 * n * share / (1 + share)))
        x = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        a, b = x[:n], x[n - both:]
        regs = near_dedup.registers([wh.mix(a), wh.mix(b)])
        j, _ = near_dedup.jaccard_estimate(regs[:1], regs[1:], np.array([float(n)]), np.array([float(n)]))
        errors.append(j[0] - share)
    assert abs(np.mean(errors)) < 0.02


def test_word_hashes_ignore_case_and_blocks(monkeypatch):
    texts = ["The quick  brown", "", "fox\njumps", "THE quick", "x" * 5000, "the quick the"]
    import pyarrow as pa
    data, offsets = wh.text_buffers(pa.array(texts + [None]))
    whole = wh.word_hashes(data, offsets)
    monkeypatch.setattr(wh, "BLOCK", 7)
    parts = wh.word_hashes(data, offsets)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    h, _, _, at = whole
    assert [b - a for a, b in zip(at[:-1], at[1:], strict=True)] == [3, 0, 2, 2, 1, 2, 0]
    assert (h[:2] == h[5:7]).all() and h[9] == h[0] and len(set(h.tolist())) == 7


def covered_by_brute_force(item, doc, least):
    """Greedy tiling as defined: again and again the longest match that is left."""
    gone_a, gone_b, out = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and i + n not in gone_a and j + n not in gone_b:
                    n += 1
                if n > best[0]:
                    best = (n, -i, -j)
        if best[0] < least:
            return out
        n, i, j = best[0], -best[1], -best[2]
        gone_a |= set(range(i, i + n))
        gone_b |= set(range(j, j + n))
        out += n


def test_tiles_by_brute_force():
    rnd = random.Random(1)
    for _ in range(150):
        item = [rnd.choice("abcdefg") for _ in range(rnd.randint(1, 40))]
        doc = [rnd.choice("abcdefg") for _ in range(rnd.randint(0, 30))]
        for _ in range(3):
            a = rnd.randrange(len(item))
            doc[len(doc) // 2:len(doc) // 2] = item[a:a + rnd.randint(1, 30)]
        least = rnd.choice([2, 3, 5])
        found = decontaminate.tiles(item, doc, least)
        assert all(item[i:i + n] == doc[j:j + n] and n >= least for i, j, n in found)
        assert len({x for i, _, n in found for x in range(i, i + n)}) == sum(n for *_, n in found)
        assert sum(n for *_, n in found) == covered_by_brute_force(item, doc, least)


def test_reordered_and_clean_documents(spark):
    item = [f"w{i}" for i in range(40)]
    swapped = item[30:] + ["pad"] * 3 + item[10:30] + ["x y"] + item[:10]
    docs = [(1, "start " + " ".join(item).upper() + " end"), (2, " ".join(swapped)), (3, " ".join(item[:12]) + " and no more"), (4, " ".join(reversed(item))),
            (5, None), (6, ""), (1, "an id twice"), (None, " ".join(item)), (8, "only four words of it"), (8, "only four words of it"), (9, "four words")]
    bench = [(10, " ".join(item)), (11, "four words"), (12, None), (13, ""), (None, "only four words of it")]
    out = decontaminate.decontaminated(spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, coverage string"),
                                       spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert len(out) == len(docs)
    leaked = collections.Counter((r.doc_id, tuple(r["__items"])) for r in out if r["__leaked"])
    assert leaked == collections.Counter([(1, (10,)), (2, (10,)), (None, (10,)), (8, (11,)), (8, (11,)), (9, (11,))]) or \
        leaked == collections.Counter([(1, (10,)), (2, (10,)), (None, (10,)), (8, ()), (8, ()), (9, (11,))])
    assert {r.doc_id: round(r["__coverage"], 3) for r in out if r.doc_id in (2, 3)} == {2: 1.0, 3: 0.3}


def test_leaks_by_brute_force(spark):
    bench = [(r.item_id, low(r.text)) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    seeds = collections.defaultdict(set)
    for i, w in bench:
        for a in range(len(w) - 4):
            seeds[tuple(w[a:a + 5])].add(i)
    items = dict(bench)
    got = {r.doc_id: r for r in queries.op9(spark, SF_SMALL).collect()}
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect():
        w = low(r.text)
        near = {i for a in range(len(w) - 4) for i in seeds.get(tuple(w[a:a + 5]), ())}
        share = {i: covered_by_brute_force(items[i], w, 5) / len(items[i]) for i in near}
        assert got[r.doc_id].leaked_items == sorted(i for i, c in share.items() if c >= 0.5)
        assert abs(got[r.doc_id].coverage - max(share.values(), default=0)) < 1e-5


def test_leaks_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    assert decontaminate.decontaminated(docs, none).first()["__leaked"] is False
    assert decontaminate.decontaminated(docs.limit(0), none).count() == 0
