from __future__ import annotations

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from tests.llm import brute
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"


def test_registered():
    names = set(contract.queries())
    assert {f"op{n}" for n in range(1, 11)} == {x.split("_")[0] for x in names if x.startswith("op")}
    assert "pipeline" in names


@pytest.mark.parametrize("name", ["op4_contamination", "op6_quality_rules", "op7_mixing"])
def test_against_sql(spark, name):
    assert compare(spark, connect(SF), name, SF) == ""


def test_stages_against_brute_force(spark, documents):
    docs, stages = documents, dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in documents.collect()}
    docs = stages["quality_rules"](spark, docs, SF)
    kept = {r.doc_id for r in docs.collect()}
    for i in set(rows) - kept:
        n, chars, symbols, dup, repeated = brute.quality_base(rows[i].text)
        lines = [x for x in rows[i].text.split("\n") if x.strip()]
        letters = [c for c in rows[i].text if c.isascii() and c.isalpha()]
        assert (
            n < 50 or 100 * repeated > 50 * n or chars < 2 * n or chars > 15 * n or 5 * symbols > n
            or 10 * dup > 3 * len(lines) or 2 * sum(c.isupper() for c in letters) > len(letters)
        )
    docs = stages["simhash_near_dedup"](spark, docs, SF)
    prints = {i: brute.fingerprint(rows[i].text) for i in kept}
    roots = brute.components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    single = {r.doc_id for r in docs.collect()}
    assert single == set(roots.values())
    docs = stages["benchmark_decontamination"](spark, docs, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    verdict = brute.contamination([(i, rows[i].text) for i in single], items)
    assert {r.doc_id for r in docs.collect()} == {i for i in single if not verdict[i][4]}
    assert docs.columns == documents.columns


def test_run(spark, documents):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*documents.columns, "shard", "slot"]
    rows = out.collect()
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert rows and all(sorted(v) == list(range(len(v))) for v in slots.values())
