from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from replyloom.functions import text as tx


def run(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_strip_is_unicode_aware(spark):
    values = ["\ta\xa0", "  b\x1c\x85", " 　 ", "", "c d"]
    assert run(spark, tx.strip, values) == [v.strip() for v in values]


def test_blank(spark):
    assert run(spark, tx.is_blank, [None, "", " \xa0\n", "x"]) == [True, True, True, False]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("See HTTPS://x.y/z?q=1 now", "see now"),
        ("ends with http://a.b", "ends with"),
        ("@Jörg_1!hello\t there", "!hello there"),
        ("mail@host.org", "mail .org"),
        ("  Ünï\nCode ", "ünï code"),
    ],
)
def test_normalize(spark, raw, expected):
    assert run(spark, tx.normalize_text, [raw]) == [expected]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("@115712 Please wait ^JB", "Please wait"),
        ("Please wait JB\xa0 ", "Please wait"),
        ("Shipped from the USA", "Shipped from the U"),
        ("Look https://t.co/abc ^XY https://t.co/def", "Look"),
        ("Track it. You can check here: https://t.co/q1 .", "Track it."),
        ("Help: SEE HERE. Thanks , all !", "Help: Thanks, all!"),
        ("check here", ""),
        ("keep http://other.co/x @name", "keep http://other.co/x @name"),
    ],
)
def test_clean_response(spark, raw, expected):
    assert run(spark, tx.clean_response, [raw]) == [expected]


def test_fold_accents_equals_decomposition(spark):
    values = ["plain", "café İ", "ﬁsh ½", "한글 가", "\U0001d5dbï ™", "नमस्ते", ""]
    expected = [
        "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)) for v in values
    ]
    assert run(spark, tx.fold_accents, values) == expected


def test_tokens_and_ngrams(spark):
    assert run(spark, tx.tokens, ["A bb c_1 Été, x9!", "", "a b"]) == [["bb", "c_1", "ete", "x9"], [], []]
    two = run(spark, lambda c: tx.ngrams(tx.tokens(c), 2), ["one two six", "one", ""])
    assert two == [["one", "two", "six", "one two", "two six"], ["one"], []]
    three = run(spark, lambda c: tx.ngrams(tx.tokens(c), 3), ["aa bb cc dd"])
    assert three[0][-2:] == ["aa bb cc", "bb cc dd"]


def test_term_counts(spark):
    got = run(spark, lambda c: tx.text_terms(c, 2), ["go go go on", None, "x"])
    assert {(r.term, r.tf) for r in got[0]} == {("go", 3), ("on", 1), ("go go", 2), ("go on", 1)}
    assert got[1] is None and got[2] is None
