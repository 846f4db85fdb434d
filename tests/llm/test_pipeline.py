"""The pipeline: contracts of its stages, and each stage against brute force on its own input."""

import collections

import corpus_pipeline as cp
import pytest
from conftest import SF_SMALL
from sparkprep.llm import line_dedup, queries
from sparkprep.llm.common import written
from test_pairs import components, covered_by_brute_force, low
from test_sets import ODD, SCHEMA, boilerplate_by_hand

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), []
    for name, stage in cp.STAGES:
        after = written(stage(spark, docs, SF_SMALL), f"test-{name}")
        out.append((name, docs, after))
        docs = after
    return out


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_names_and_registration(stages):
    assert [n for n, *_ in stages] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "sentence_pieces"]
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(queries.QUERIES) | {"pipeline"} <= set(q) and set(queries.SQL) <= set(sql)
    assert [sum(k.startswith(f"op{n}_") for k in q) for n in range(1, 14)] == [1] * 13
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns


def test_every_stage_on_its_own_input(spark, stages):
    (_, docs, good), (_, _, lines), (_, _, single), (_, _, clean), (_, _, last) = stages
    verdict = {r.doc_id: r.kept for r in queries.op1(spark, SF_SMALL).collect()}
    assert set(by_id(good)) == {i for i, k in verdict.items() if k}
    before, after = by_id(good), by_id(lines)
    gone = boilerplate_by_hand([(r.doc_id, r.source, r.text) for r in before.values()], line_dedup.MIN_SITES)
    assert set(after) == set(before)
    for i, r in after.items():
        assert r.text == "\n".join(x for x in before[i].text.split("\n") if x.strip(" \t\n\x0b\x0c\r").lower() not in gone)
        assert r.n_chars == len(r.text)
    rows = [(r.doc_id, r.text) for r in after.values()]
    assert set(by_id(single)) == {i for (i, _), (_, c) in zip(rows, components(rows, 5), strict=True) if i == c}
    bench = [low(r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    leaked = {r.doc_id for r in by_id(single).values() if any(covered_by_brute_force(b, low(r.text), 5) >= 0.5 * len(b) for b in bench if set(b) & set(low(r.text)))}
    assert set(by_id(clean)) == set(by_id(single)) - leaked
    assert by_id(last).keys() == by_id(clean).keys() and all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in by_id(last).values())


def test_run_gives_the_last_stage(spark, stages):
    got = cp.run(spark, SF_SMALL).select("doc_id", "n_pieces").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, stages[-1][2].select("doc_id", "n_pieces").collect()))


def test_stages_on_odd_rows(spark):
    odd = spark.createDataFrame([(*r, "k", "s", "x", "w", "h") for r in ODD], SCHEMA)
    for docs in (odd, odd.limit(0)):
        for name, stage in cp.STAGES:
            out = stage(spark, docs, SF_SMALL)
            assert set(docs.columns) <= set(out.columns), name
            assert out.count() <= docs.count()
