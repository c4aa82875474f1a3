from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from replyloom.functions.lexicon import INTENT_LEXICON, INTENTS, RISK_LEXICON, Lexicon, risk_flag, weak_label


def flags(spark, values, **options):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.r for r in df.select("i", risk_flag(F.col("x"), **options).alias("r")).orderBy("i").collect()]


def labels(spark, values, lexicon=INTENT_LEXICON):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, customer_text string")
    rows = weak_label(df, lexicon=lexicon).orderBy("i").collect()
    return [(r.suggested_intent, r.suggestion_score) for r in rows]


def test_sizes():
    assert INTENT_LEXICON.categories == INTENTS
    assert sum(len(t) for _, t in INTENT_LEXICON.entries) == 119
    assert sum(len(t) for _, t in RISK_LEXICON.entries) == 26


def test_terms_that_each_list_must_hold():
    intents, risks = dict(INTENT_LEXICON.entries), dict(RISK_LEXICON.entries)
    assert {"hack", "hacked"} <= set(intents["account_security"])
    assert "hi" in intents["other_non_actionable"]
    assert "refund" in {t for _, terms in INTENT_LEXICON.entries for t in terms}
    assert {"sue", "court", "lawyer"} <= set(risks["legal_or_high_risk"])
    assert list(risks)[0] == "security_or_account_risk" and "fraud" in risks["security_or_account_risk"]


def test_risk_order_and_substrings(spark):
    got = flags(
        spark,
        ["This issue", "Credit card FRAUD", "I was charged twice", "get me a supervisor", "Where is it?", None, ""],
    )
    assert got == [
        "legal_or_high_risk",  # a term inside a word counts
        "security_or_account_risk",  # the earlier category wins
        "payment_or_financial_risk",
        "explicit_human_request",
        None,
        None,
        None,
    ]


def test_risk_word_mode(spark):
    assert flags(spark, ["This issue", "I will sue.", "sue_me"], mode="word") == [None, "legal_or_high_risk", None]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("zzz", ("other_non_actionable", 0)),
        (None, ("other_non_actionable", 0)),
        ("my parcel", ("order_delivery", 1)),
        ("refund my invoice", ("ambiguous", 1)),
        ("refund the invoice for a movie", ("ambiguous", 1)),
        ("this", ("other_non_actionable", 1)),
        ("hacked", ("account_security", 2)),  # overlapping terms both count
        ("@delivery https://refund.example", ("other_non_actionable", 0)),
    ],
)
def test_weak_label(spark, text, expected):
    assert labels(spark, [text]) == [expected]


def test_share_and_table_round_trip(spark):
    lexicon = Lexicon.of({"b": ["x", "y"], "a": ["z"]})
    df = spark.createDataFrame([("x y z",)], "customer_text string")
    assert weak_label(df, lexicon=lexicon).first().suggestion_share == pytest.approx(2 / 3)
    assert Lexicon.from_table(lexicon.to_table(spark)) == lexicon


def test_filter_on_label_keeps_values(spark):
    df = spark.createDataFrame([("parcel",), ("zzz",)], "customer_text string")
    kept = weak_label(df).where(F.col("suggested_intent") == "order_delivery").collect()
    assert [r.customer_text for r in kept] == ["parcel"]
