from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from replyloom.functions.lexicon import INTENTS
from replyloom.operators import sampling


def pair_rows(spark, texts):
    data = [(f"c{i}", f"b{i}", t, "a proper reply", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(
        data, "customer_tweet_id string, brand_tweet_id string, customer_text string, brand_response string, src_ord long"
    )


def test_intent_sample_lengths(spark):
    texts = ["x" * 9, "y" * 10, "z" * 80, "a" * 81, "b" * 200, "c" * 201, None, "Y" * 10, "@someone_long hi"]
    sheet = sampling.intent_sample(pair_rows(spark, texts)).collect()
    assert sorted(len(r.customer_text) for r in sheet) == [10, 80, 81, 200, 201]
    assert [r.sample_id for r in sheet] == [1, 2, 3, 4, 5]
    assert all(r.final_intent == "" for r in sheet)
    assert {r.customer_tweet_id for r in sheet if len(r.customer_text) == 10} == {"c1"}


def test_intent_sample_caps(spark):
    texts = [f"short text number {i}" for i in range(40)] + [f"{i} " + "long " * 45 for i in range(5)]
    sheet = sampling.intent_sample(pair_rows(spark, texts), caps=(7, 7, 9), total=10).collect()
    sizes = Counter(len(r.customer_text) > 200 for r in sheet)
    assert len(sheet) == 10 and sizes[True] + sizes[False] == 10
    full = sampling.intent_sample(pair_rows(spark, texts), caps=(7, 7, 9)).collect()
    assert Counter(len(r.customer_text) > 200 for r in full) == {False: 7, True: 5}


def labelled(spark, sizes):
    data = []
    for label, n in sizes.items():
        for _ in range(n):
            i = len(data)
            data.append((i, f"c{i}", f"b{i}", f"text {i}", "reply", label, "", "", i))
    return spark.createDataFrame(
        data,
        "sample_id int, customer_tweet_id string, brand_tweet_id string, customer_text string, "
        "brand_response string, final_intent string, label_confidence string, label_notes string, src_ord long",
    )


def test_golden_quota(spark):
    df = labelled(spark, {"order_delivery": 90, "account_security": 3, "payment_billing": 25, "unknown": 40})
    golden = sampling.golden_quota(df, n=60).collect()
    counts = Counter(r.gold_intent for r in golden)
    assert len(golden) == 60 and len({r.sample_id for r in golden}) == 60
    assert counts["account_security"] == 3 and "unknown" not in counts
    assert counts["order_delivery"] >= 10 and counts["payment_billing"] >= 10
    assert all(r.human_review_status == "pending" and r.gold_escalate == "" for r in golden)


def test_golden_quota_smaller_than_quotas(spark):
    df = labelled(spark, {name: 12 for name in INTENTS})
    assert sampling.golden_quota(df, n=30).count() == 30


def test_golden_quota_needs_columns(spark):
    with pytest.raises(ValueError, match="label_notes"):
        sampling.golden_quota(labelled(spark, {"order_delivery": 1}).drop("label_notes"))


def test_stratified_split(spark):
    sizes = {"order_delivery": 100, "account_security": 7, "payment_billing": 3, "device_technical": 2, "digital_content": 1}
    split = sampling.stratified_split(labelled(spark, sizes)).collect()
    counts = Counter((r.final_intent, r.split) for r in split)
    assert len(split) == sum(sizes.values()) == len({r.sample_id for r in split})
    assert [counts["order_delivery", s] for s in ("train", "validation", "test")] == [70, 15, 15]
    assert [counts["account_security", s] for s in ("train", "validation", "test")] == [5, 1, 1]
    assert [counts["payment_billing", s] for s in ("train", "validation", "test")] == [2, 1, 0]
    assert [counts["device_technical", s] for s in ("train", "validation", "test")] == [1, 1, 0]
    assert counts["digital_content", "train"] == 1


def test_split_drops_and_excludes(spark):
    df = labelled(spark, {"order_delivery": 20, "nonsense": 5})
    df = df.withColumn(
        "customer_text",
        F.when(F.col("src_ord") == 1, "text 0").when(F.col("src_ord") == 2, " ").otherwise(F.col("customer_text")),
    )
    exclude = spark.createDataFrame([("  text 5 ",)], "customer_text string")
    kept = sampling.stratified_split(df, exclude=exclude)
    assert {r.src_ord for r in kept.collect()} == set(range(20)) - {1, 2, 5}
    assert sampling.overlap_count(df, exclude).first().overlap == 1
    assert sampling.overlap_count(kept, exclude).first().overlap == 0


def test_review_template(spark):
    df = spark.createDataFrame([(30, "c", None), (10, None, "r1"), (20, "b", "r2")], "o long, customer_text string, brand_response string")
    sheet = sampling.review_template(df, ["o"]).orderBy("sample_id").collect()
    assert [(r.sample_id, r.customer_text, r.brand_response) for r in sheet] == [(1, "", "r1"), (2, "b", "r2"), (3, "c", "")]
    assert sheet[0].review_status == "pending"


def test_split_keeps_texts_by_column_and_shuffles_none(spark):
    texts = [(i, "en", f"text {i % 30}") for i in range(40)]
    df = spark.createDataFrame(texts, "src_ord long, final_intent string, customer_text string").repartition(8)
    split = sampling.stratified_split(df, taxonomy=["en"], exclude=df.where("src_ord = 3"))
    assert sorted(r.src_ord for r in split.collect()) == [i for i in range(30) if i != 3]
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "LogicalRDD" not in plan
