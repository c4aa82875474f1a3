from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from replyloom.operators import failures, index, judging, triage
from replyloom.plans import views

# Message, intent, confidence, similarity; then escalate and reason.
CASES = [
    ("", "product_question", 0.14, 0.9, True, "low_intent_confidence"),
    (None, "product_question", 0.6, 0.7, False, "safe_to_auto_handle"),
    ("Which colours does the blue kettle come in", "product_question", 0.55, 0.61, False, "safe_to_auto_handle"),
    ("Which colours does the kettle come in", "product_question", 0.31, 0.02, True, "low_historical_similarity"),
    ("Which colours does the kettle come in", "product_question", 0.03, 0.02, True, "low_intent_confidence"),
    ("They sent a courtesy note", "product_question", 0.7, 0.7, True, "legal_or_high_risk"),
    ("Somebody HACKED my login, get me a supervisor", "product_question", 0.7, 0.7, True, "security_or_account_risk"),
    ("Let a supervisor call me", "product_question", 0.02, 0.02, True, "explicit_human_request"),
    ("Cannot log in", "account_security", 0.66, 0.42, True, "high_risk_intent"),
    ("Cannot log in", "account_security", 0.01, 0.01, True, "high_risk_intent"),
]


def test_cascade(spark):
    df = spark.createDataFrame(
        [(i, *c[:4]) for i, c in enumerate(CASES)],
        "i int, customer_text string, predicted_intent string, intent_confidence double, retrieval_similarity double",
    )
    got = triage.decide_escalation(df).orderBy("i").collect()
    assert [(r.predicted_escalate, r.escalation_reason) for r in got] == [c[4:] for c in CASES]


@pytest.mark.parametrize(
    ("reply", "similarity", "fallback", "expected"),
    [
        ("All good ^AB", 0.5, True, "All good"),
        ("All good ^AB", 0.19, True, triage.NO_REPLY),
        ("All good ^AB", 0.2, True, "All good"),
        ("@12 ^AB", 0.9, True, triage.NO_REPLY),
        (None, 0.0, True, triage.NO_REPLY),
        ("All good ^AB", 0.0, False, "All good"),
        ("@12 ^AB", 0.9, False, ""),
    ],
)
def test_draft_reply(spark, reply, similarity, fallback, expected):
    df = spark.createDataFrame([(reply, similarity)], "retrieved_brand_response string, retrieval_similarity double")
    assert triage.draft_reply(df, fallback=fallback).first().draft_reply == expected


def evaluated(spark):
    docs = spark.createDataFrame(
        [(1, "late parcel again", "Sorry ^AB"), (2, "late parcel", "Soon"), (3, "late movie again", "Enjoy")],
        "src_ord long, customer_text string, brand_response string",
    )
    gold = spark.createDataFrame(
        [
            (1, "late parcel again", "order_delivery", False, "order_delivery", 0.9),
            (2, "unknown words", "order_delivery", False, "digital_content", 0.4),
            (3, "late movie again", "digital_content", True, "digital_content", 0.8),
        ],
        "sample_id long, customer_text string, gold_intent string, gold_escalate boolean, "
        "predicted_intent string, intent_confidence double",
    )
    return triage.evaluate(gold, index.build_index(docs))


def test_evaluate_and_failures(spark):
    rows = {r.sample_id: r for r in evaluated(spark).collect()}
    assert rows[1].intent_correct and rows[1].escalation_correct and rows[1].draft_reply == "Sorry"
    assert rows[1].retrieval_similarity == pytest.approx(1.0)
    assert rows[2].escalation_reason == "low_historical_similarity" and rows[2].draft_reply is None
    assert not rows[3].escalation_correct
    table = evaluated(spark).withColumns({"src_ord": F.col("sample_id"), "gold_escalation_reason": F.lit(None).cast("string")})
    failed = failures.failure_rows(table)
    assert {(r.sample_id, r.error_type) for r in failed.collect()} == {
        (2, "intent_misclassification"), (2, "escalation_error"), (3, "escalation_error"),
    }
    assert failed.columns == failures.COLUMNS
    top = {r.sample_id: r for r in failures.failure_top(failed).collect()}
    assert top[2].error_type == "intent_misclassification" and top[2].confidence_gap == pytest.approx(0.6)
    assert top[3].confidence_gap is None


def test_failure_order_and_repeats(spark):
    data = [(i, i, "t", "a", "b", 0.5 - i / 100, 0.5, True, True, "r") for i in range(30)]
    data.append((5, 99, "t", "a", "b", 0.0, 0.5, True, True, "r"))
    df = spark.createDataFrame(
        data,
        "sample_id int, src_ord int, customer_text string, gold_intent string, predicted_intent string, "
        "intent_confidence double, retrieval_similarity double, gold_escalate boolean, predicted_escalate boolean, "
        "gold_escalation_reason string",
    )
    failed = failures.failure_rows(df)
    assert failed.count() == 30
    assert sorted(r.sample_id for r in failures.failure_top(failed).collect()) == list(range(10, 30))


def test_judge_prompt(spark):
    df = spark.createDataFrame([(1, "50% off?", None, "hist", "draft")], "sample_id int, customer_text string, retrieved_customer_text string, retrieved_brand_response string, draft_reply string")
    prompt = judging.judge_prompts(df).first().prompt
    assert "Customer wrote:\n50% off?\n" in prompt and "Draft answer:\ndraft\n" in prompt


@pytest.mark.parametrize(
    ("response", "status"),
    [
        ('Sure {"grounded": 5, "relevant": 4, "helpful": 3, "unsupported_claim": 0, "overall": 4, "reason": "a {b}"} ok', "ok"),
        ("no braces", "no_json"),
        ("} {", "no_json"),
        (None, "no_json"),
        ('{"grounded": }', "malformed"),
        ('{"grounded": 5.0, "relevant": 4.0, "helpful": 3, "unsupported_claim": false, "overall": 4, "reason": "a {b}"}', "ok"),
        ('{"grounded": 4.5, "relevant": 4, "helpful": 3, "unsupported_claim": 0, "overall": 4, "reason": "x"}', "malformed"),
        ('{"grounded": 5}', "missing_field"),
        ('{"grounded": 6, "relevant": 4, "helpful": 3, "unsupported_claim": 0, "overall": 4, "reason": "x"}', "out_of_range"),
    ],
)
def test_judge_parse(spark, response, status):
    df = spark.createDataFrame([(1, response)], "sample_id int, response string")
    row = judging.judge_parse(df).first()
    assert row.status == status
    if status == "ok":
        assert (row.grounded, row.unsupported_claim, row.reason) == (5, 0, "a {b}")


def test_judge_means(spark):
    df = spark.createDataFrame(
        [(1, 5, 4, 3, 1, 4, "r", "ok"), (2, 1, 2, 3, 0, 4, "r", "ok"), (3, 9, 9, 9, 0, 9, "r", "out_of_range")],
        "sample_id int, grounded int, relevant int, helpful int, unsupported_claim int, overall int, reason string, status string",
    )
    assert tuple(judging.judge_means(df).first()) == (2, 1, 3.0, 3.0, 3.0, 4.0, 0.5)


def test_texts_do_not_meet_the_matches_unless_asked_for(spark):
    pairs = spark.createDataFrame(
        [(i, f"kettle colour {i % 3} blue", f"reply {i}") for i in range(9)], "src_ord long, customer_text string, brand_response string"
    )
    waiting = spark.createDataFrame(
        [(1, "blue kettle colour", "product_question", 0.9), (2, "hacked blue kettle", "product_question", 0.9)],
        "query_id long, customer_text string, predicted_intent string, intent_confidence double",
    )
    decided = triage.triage(waiting, index.build_index(pairs), "query_id")
    reasons = {r.query_id: r.escalation_reason for r in decided.select("query_id", "escalation_reason").collect()}
    assert reasons == {1: "safe_to_auto_handle", 2: "security_or_account_risk"}
    assert {r.customer_text for r in decided.collect()} == {"blue kettle colour", "hacked blue kettle"}
    plan = decided.select("query_id", "escalation_reason")._jdf.queryExecution().optimizedPlan().toString()
    assert not any("customer_text#" in line for line in plan.splitlines() if "Relation [" not in line)


def test_labelled_documents_are_not_shuffled(spark):
    plan = views.gold_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
