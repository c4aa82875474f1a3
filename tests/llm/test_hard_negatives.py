from __future__ import annotations

import random

import numpy as np
import pytest

from replyloom.llm import gnat, hard_negatives
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<float>, label int"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _rows(table):
    return sorted((tuple(r[c] for c in COLUMNS) for r in table.collect()), key=repr)


def _given(table):
    return [(r.vec_id, r.embedding, r.label) for r in table.select("vec_id", "embedding", "label").collect()]


def _vectors(kind, n, rng):
    if kind == "even":
        return rng.integers(-90, 90, (n, 12))
    if kind == "clusters":
        return np.repeat(rng.integers(-90, 90, (n // 20 + 1, 12)), 20, axis=0)[:n] + rng.integers(-2, 3, (n, 12))
    return np.tile(rng.integers(-90, 90, (3, 12)), (n, 1))[:n]


@pytest.mark.parametrize("kind", ["even", "clusters", "copies"])
@pytest.mark.parametrize("leaf_rows", [4, 40, 10_000])
def test_windows_against_a_scan(kind, leaf_rows):
    rng = np.random.default_rng(leaf_rows)
    rows, labels = _vectors(kind, 400, rng), rng.integers(0, 3, 400)
    some = rng.integers(0, 400, 60)
    low, high = rng.integers(-40_000, 10_000, 60), rng.integers(10_000, 90_000, 60)
    asked = gnat.Windows(rows[some], labels[some], rng.integers(0, 2, 60).astype(bool), low, high, rng.integers(1, 6, 60))
    radius = float(np.sqrt((rows**2).sum(1).max()))
    q, r, s = gnat.first_rows(rows, labels, asked, radius, 5, leaf_rows)
    for k in range(60):
        want = rows @ rows[some[k]]
        fits = ((labels == asked.labels[k]) == asked.same[k]) & (want >= low[k]) & (want <= high[k])
        last = np.sort(want[fits])[::-1][: asked.n[k]][-1:]
        expected = set(np.flatnonzero(fits & (want >= (last[0] if len(last) else 0)))) if fits.any() else set()
        assert set(r[q == k]) == expected and (want[r[q == k]] == s[q == k]).all()


def test_siblings_are_left_out():
    rng = np.random.default_rng(1)
    rows = _vectors("clusters", 4000, rng).astype(float)
    radius = float(np.sqrt((rows**2).sum(1).max()))
    tree, leaf = gnat.grow(rows, radius, 8, 64)
    assert (gnat.note_ranges(tree, rows) == leaf).all() and tree.leaves > 30
    asked = rows[::100]
    near = (asked**2).sum(1) * 0.95
    visits = sum(len(some) for _, some in gnat.reach(tree, asked, near, np.full(len(asked), 1e12)))
    assert len(asked) <= visits < len(asked) * tree.leaves / 3


def test_large_products_are_exact():
    rng = np.random.default_rng(2)
    a = rng.integers(-(1 << 22), 1 << 22, (5, 700))
    assert gnat.products(a, a).tolist() == [[sum(x * y for x, y in zip(u, v)) for v in a.tolist()] for u in a.tolist()]


def test_table_against_brute_force(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert _rows(hard_negatives.negative_table(given)) == brute.hard_negatives(_given(given))


def test_many_leaves_and_cells(spark, monkeypatch):
    for name, value in (("LEAF_ROWS", 30), ("CELL_QUERIES", 4), ("FAN", 4), ("CELL_LEAF_ROWS", 5)):
        monkeypatch.setattr(hard_negatives, name, value)
    given = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    assert _rows(hard_negatives.negative_table(given)) == brute.hard_negatives(_given(given))


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 25)
    rng = random.Random(3)
    vector = lambda n=6: [rng.choice([-0.5, -0.1, 0.0, 0.2, 0.25, 0.7]) for _ in range(n)]
    rows = [(i, vector(), rng.randrange(10)) for i in range(160)]
    rows += [(i, [0.5] * 6, i % 2) for i in range(200, 260)]
    rows += [(400, [0.5] * 6, 1), (400, [0.5] * 6, 1), (450, [0.5] * 6, 1), (None, [0.5] * 6, 1), (None, vector(), 2), (None, None, None)]
    rows += [(500, None, 1), (550, vector(), None), (600, [0.1, None], 1), (650, [float("nan")] * 6, 1), (700, [float("inf")] * 6, 2)]
    rows += [(750, [], 3), (800, [0.0] * 6, 3), (850, [0.3], 3), (900, vector(), 4)]
    given = spark.createDataFrame(rows, SCHEMA)
    want = brute.hard_negatives([(i, [0.0] * 6 if v == [] else (list(v) + [0.0] * 6)[:6] if v is not None else v, y) for i, v, y in _given(given)])
    for name in ("qid", "leaf", "vector", "rank", "low", "n", "product"):
        given = given.withColumn(name, given["vec_id"])
    assert want and _rows(hard_negatives.negative_table(given.repartition(3))) == want
    assert hard_negatives.negative_table(given.limit(0)).count() == 0
    assert hard_negatives.negative_table(given.where("label is null")).count() == 0


def test_huge_components_do_not_fail(spark):
    rows = [(50 * i, [1e38, -1e38, 1.0], i % 2) for i in range(1, 9)]
    got = hard_negatives.negative_table(spark.createDataFrame(rows, SCHEMA))
    assert got.count() == 0 or got.columns == list(COLUMNS)
