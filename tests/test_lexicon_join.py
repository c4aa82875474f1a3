from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from replyloom import session
from replyloom.functions.lexicon import INTENT_LEXICON, RISK_LEXICON, risk_flag, weak_label
from replyloom.operators import lexicon_join

TEXTS = [
    None, "", "zzz", "my parcel", "refund my invoice", "refund the invoice for a movie", "this", "hacked", "HI there",
    "@delivery https://refund.example", "thank you for the great customer service", "This issue", "I will sue.", "sue_me",
    "Credit card FRAUD", "I was charged twice", "get me a supervisor", "hi", "h", "no response, nobody replied; refund parcel",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS + TEXTS[:5])], "i int, customer_text string")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("small", [True, False])
def test_equals_the_expressions(spark, texts, monkeypatch, small):
    if not small:
        monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    intents = lexicon_join.gram_index(INTENT_LEXICON.to_table(spark))
    assert _rows(lexicon_join.weak_labels(texts, intents)) == _rows(weak_label(texts))
    risks = lexicon_join.gram_index(RISK_LEXICON.to_table(spark))
    for mode in ("substring", "word"):
        want = texts.withColumn("risk", risk_flag(F.col("customer_text"), mode=mode))
        assert _rows(lexicon_join.risk_flags(texts, risks, "customer_text", "risk", mode)) == _rows(want)


def test_each_term_has_one_rare_gram(spark):
    rows = [("a", 0, "abcd"), ("a", 0, "abce"), ("b", 1, "xy"), ("b", 1, "abcd"), ("b", 5, "abcd"), ("c", 2, None), ("c", 2, "")]
    got = _rows(lexicon_join.gram_index(spark.createDataFrame(rows, "category string, priority int, term string")))
    assert got == [("bcd", "a", 0, "abcd"), ("bcd", "b", 1, "abcd"), ("bce", "a", 0, "abce"), ("xy", "b", 1, "xy")]


def test_fifty_thousand_terms(spark, monkeypatch):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 9)))
    terms = sorted({word() for _ in range(50_600)})[:50_000]
    lexicon = [(f"c{i % 40}", i % 40, t) for i, t in enumerate(terms)]
    texts = [" ".join(rng.choice(terms) if rng.random() < 0.5 else word() for _ in range(12)) for _ in range(300)]
    want = []
    for i, text in enumerate(texts):
        scores = {}
        for category, priority, term in lexicon:
            if term in text:
                scores[priority] = scores.get(priority, 0) + 1
        best = max(scores.values(), default=0)
        named = [p for p, s in scores.items() if s == best]
        label = "none" if not named else f"c{named[0]}" if len(named) == 1 else "ambiguous"
        want.append((i, label, best, round(best / sum(scores.values()), 9) if scores else 0.0))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, customer_text string")
    table = spark.createDataFrame(lexicon, "category string, priority int, term string")
    index = lexicon_join.gram_index(table)
    assert index.count() == 50_000
    for rows in (session.BROADCAST_ROWS, 1000):
        monkeypatch.setattr(session, "BROADCAST_ROWS", rows)
        got = lexicon_join.weak_labels(df, index, fallback="none").select("i", "suggested_intent", "suggestion_score", F.round("suggestion_share", 9))
        assert _rows(got) == sorted(want, key=repr)


def test_no_terms_and_odd_columns(spark, texts):
    nothing = lexicon_join.gram_index(spark.createDataFrame([], "category string, priority int, term string"))
    got = lexicon_join.weak_labels(texts, nothing)
    assert {(r.suggested_intent, r.suggestion_score, r.suggestion_share) for r in got.collect()} == {("other_non_actionable", 0, 0.0)}
    clashing = texts.withColumns({c: F.lit("x") for c in ("key", "text", "term", "gram", "category")})
    full = lexicon_join.gram_index(INTENT_LEXICON.to_table(spark))
    assert lexicon_join.weak_labels(clashing, full).select("i", "suggested_intent").count() == texts.count()
    with pytest.raises(ValueError):
        lexicon_join.risk_flags(texts, full, "customer_text", "risk", "prefix")


def test_small_lexicons_make_no_row_per_gram(spark, monkeypatch):
    """Texts are walked down the tree of terms: neither grams nor copies of a text become rows."""
    monkeypatch.setattr(lexicon_join, "WALK_CHARS", 10)
    terms = ["a", "ab", "abc", "bab", "b c", "\U0001d538b", "zz", "c\n", "é"]
    texts = ["ababc", "b c\n", "", None, "x\U0001d538b\U0001d538", "z", "zzz", "é ab" * 5, "a", "bc"]
    lexicon = lexicon_join.gram_index(spark.createDataFrame([("n", 0, t) for t in terms], "category string, priority int, term string"))
    df = spark.createDataFrame(list(enumerate(texts)), "key int, text string")
    found = lexicon_join.found_terms(df, lexicon)
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.key, r.term) for r in found.collect()) == sorted((i, t) for i, x in enumerate(texts) for t in terms if t in (x or ""))
