from __future__ import annotations

import hashlib
import statistics

import pytest
from pyspark.sql import functions as F

from replyloom.operators import rows


def test_keep_first_and_last(spark):
    df = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), ("a", 2, "z"), ("b", 5, "w")], "k string, o int, v string")
    assert {r.v for r in rows.keep_first(df, ["k"], [F.col("o")]).collect()} == {"y", "w"}
    assert {r.v for r in rows.keep_last(df, ["k"], ["o"]).collect()} == {"x", "w"}


def test_keep_first_filters_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    plan = rows.keep_first(df, ["k"], [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


@pytest.mark.parametrize("many", [False, True])
def test_keep_first_wide_leaves_rows_where_they_are(spark, monkeypatch, many):
    data = [("a", "x", 3), ("a", "x", 1), ("a", "y", 2), (None, "x", 4), (None, "x", None), ("", "x", 6), ("", None, 7)]
    df = spark.createDataFrame(data, "k string, l string, o int")
    few = rows.keep_first_wide(df.coalesce(1), ["k", "l"], "o")
    assert "WindowGroupLimit" in few._jdf.queryExecution().executedPlan().toString()
    if many:
        monkeypatch.setattr(rows.session, "BROADCAST_ROWS", 0)
    got = rows.keep_first_wide(df, ["k", "l"], "o")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, rows.keep_first(df, ["k", "l"], [F.col("o")]).collect()), key=key)
    assert ("WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()) == many


def test_keep_first_wide_keeps_one_of_tied_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "k string, o int")
    assert sorted(map(tuple, rows.keep_first_wide(df, ["k"], "o").collect())) == [("a", 1), ("b", 1)]
    assert rows.keep_first_wide(df.repartition(3).where(F.col("o") > 1), ["k"], "o").count() == 0


def test_exact_n_with_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 5 + 10).otherwise(1).alias("k"), "id")
    df = df.withColumn("h", rows.hash_order(7, F.col("id")))
    got = {}
    for r in rows.exact_n(df, ["k"], 40, ["h", "id"]).collect():
        got.setdefault(r.k, set()).add(r.id)
    want = {}
    for r in df.collect():
        want.setdefault(r.k, []).append((r.h, r.id))
    assert got == {k: {i for _, i in sorted(v)[:40]} for k, v in want.items()}


def test_hash_order_is_md5(spark):
    assert spark.range(1).select(rows.hash_order(42, F.lit(5)).alias("h")).first().h == hashlib.md5(b"42:5").hexdigest()


def test_number_rows(spark):
    df = spark.range(997).select((F.col("id") * 7919 % 997).alias("o"), F.lit("x").alias("v")).repartition(7)
    got = {r.o: r.sample_id for r in rows.number_rows(df, ["o"]).collect()}
    assert got == {o: o + 1 for o in range(997)}


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 2, "c": 3, "d": 7, "e": 100}, {"hot": 4000, "cold": 10}])
def test_hash_cuts(spark, sizes):
    data = [(label, i * 31 + j) for j, (label, n) in enumerate(sizes.items()) for i in range(n)]
    df = spark.createDataFrame(data, "label string, id long")
    cuts = {(r.label, r.cut): (r.at_hash, r.at_key) for r in rows.hash_cuts(df, "label", "id", 42, (70, 85)).collect()}
    for label, n in sizes.items():
        ordered = sorted((hashlib.md5(f"42:{i}".encode()).hexdigest(), i) for name, i in data if name == label)
        for percent in (70, 85):
            target = (n * percent + 50) // 100
            assert cuts.get((label, percent)) == (ordered[target - 1] if target else None)


@pytest.mark.parametrize("values", [[0.5], [0.1, 0.9], [0.0] * 50 + [1.0, 0.25], [i / 1000 for i in range(1000)], [0.3, 0.30001, 0.30002, 0.7]])
def test_unit_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert rows.unit_median(df, "v").first().median == pytest.approx(statistics.median(values), abs=1e-15)


def test_top_n_ranked(spark):
    out = rows.top_n(spark.range(50), 3, [F.col("id").desc()], rank="rank").collect()
    assert [(r["rank"], r.id) for r in out] == [(1, 49), (2, 48), (3, 47)]
