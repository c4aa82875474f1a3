from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from replyloom.operators import metrics


def labelled(spark, pairs):
    return spark.createDataFrame(pairs, "gold string, predicted string")


def confusion(spark, tp, fp, fn, tn):
    rows = [(True, True)] * tp + [(False, True)] * fp + [(True, False)] * fn + [(False, False)] * tn
    return spark.createDataFrame(rows, "g boolean, p boolean")


@pytest.mark.parametrize(
    ("cells", "expected"),
    [
        ((26, 137, 0, 37), (0.1595, 1.0, 0.2751, 0.815, 0.185)),
        ((64, 99, 3, 34), (0.3926, 0.9552, 0.5565, 0.815, 0.185)),
        ((67, 133, 0, 0), (0.335, 1.0, 0.5019, 1.0, 0.0)),
        ((0, 0, 5, 5), (0.0, 0.0, 0.0, 0.0, 1.0)),
        ((0, 3, 0, 5), (0.0, 0.0, 0.0, 0.375, 0.625)),
    ],
)
def test_binary(spark, cells, expected):
    row = metrics.binary_metrics(confusion(spark, *cells), F.col("g"), F.col("p")).first()
    assert tuple(row) == pytest.approx(expected, abs=5e-5)


def test_macro_f1_counts_absent_labels(spark):
    df = labelled(spark, [("a", "a")] * 8 + [("b", "a")] * 2)
    row = metrics.macro_f1(df, "gold", "predicted").first()
    assert (row.accuracy, row.macro_f1) == pytest.approx((0.8, 0.444444), abs=1e-6)
    wider = labelled(spark, [("a", "a"), ("b", "c")])
    assert metrics.macro_f1(wider, "gold", "predicted").first().macro_f1 == pytest.approx(1 / 3, abs=1e-6)


def test_majority_baseline(spark):
    """27 of 75 test rows carry the majority label among ten labels."""
    labels = [f"l{i}" for i in range(10)]
    test = [("l0",)] * 27 + [(labels[1 + i % 9],) for i in range(48)]
    train = spark.createDataFrame([("l0",)] * 5 + [("l1",)] * 5 + [("l2",)], "y string")
    row = metrics.majority_baseline(train, spark.createDataFrame(test, "y string"), "y").first()
    assert (row.majority, row.test_rows) == ("l0", 75)
    assert (row.accuracy, row.macro_f1) == pytest.approx((0.36, 0.0529), abs=5e-5)


def test_class_metrics(spark):
    df = labelled(spark, [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")])
    got = {r.label: r for r in metrics.class_metrics(df, "gold", "predicted").collect()}
    assert (got["a"].precision, got["a"].recall, got["a"].support) == (0.5, 0.5, 2)
    assert (got["c"].precision, got["c"].recall, got["c"].f1) == (0.0, 0.0, 0.0)
    assert got["accuracy"].f1 == 0.5
    assert got["macro avg"].recall == 0.5
    assert got["weighted avg"].f1 == pytest.approx((2 * 0.5 + 2 / 3) / 4, abs=1e-6)


def test_confusion(spark):
    df = labelled(spark, [("a", "a"), ("a", "b"), ("a", "b"), ("b", "a"), ("b", "c")])
    matrix = {r.gold: (r.a, r.b, r.c) for r in metrics.confusion_matrix(df, "gold", "predicted", ["a", "b", "c"]).collect()}
    assert matrix == {"a": (1, 2, 0), "b": (1, 0, 1)}
    assert [tuple(r) for r in metrics.confusion_pairs(df, "gold", "predicted", 2).collect()] == [("a", "b", 2), ("b", "a", 1)]


def rated(spark, values):
    return spark.createDataFrame(
        [(i, v, v, 3, v) for i, v in enumerate(values)],
        "sample_id int, grounded int, relevant int, helpful int, overall int",
    )


def test_kappa(spark):
    judge, human = rated(spark, [1, 2, 3, 1]), rated(spark, [1, 2, 3, 1])
    got = {r.field: r.kappa for r in metrics.rater_kappa(judge, human).collect()}
    assert got == {"grounded": 1.0, "relevant": 1.0, "overall": 1.0, "helpful": None}
    constant = {r.field: r.kappa for r in metrics.rater_kappa(judge, rated(spark, [1, 1, 1, 1])).collect()}
    assert constant["grounded"] == 0.0
    # po = 3/5, pe = (3*2 + 2*3)/25
    mixed = {r.field: r.kappa for r in metrics.rater_kappa(rated(spark, [1, 1, 2, 2, 2]), rated(spark, [1, 2, 2, 1, 2])).collect()}
    po, pe = 3 / 5, (2 * 2 + 3 * 3) / 25
    assert mixed["grounded"] == pytest.approx((po - pe) / (1 - pe), abs=1e-6)


def sweep_rows(spark):
    rows = [(i / 37 % 1, i / 53 % 1, i % 11 == 0, i % 3 == 0) for i in range(300)]
    rows += [(0.3, 0.3, False, True), (0.2, 0.2, False, False), (0.6, 0.6, False, True)]
    return rows, spark.createDataFrame(
        rows, "intent_confidence double, retrieval_similarity double, always_escalate boolean, gold_escalate boolean"
    )


def test_sweep_equals_row_by_row(spark):
    rows, df = sweep_rows(spark)
    got = {(r[0], r[1]): tuple(r)[2:] for r in metrics.threshold_sweep(df).collect()}
    assert len(got) == 110
    for ct in metrics.CONFIDENCE_GRID:
        for st in metrics.SIMILARITY_GRID:
            flags = [a or c < ct or s < st for c, s, a, _ in rows]
            tp = sum(f and g for f, (*_, g) in zip(flags, rows))
            p, r = tp / sum(flags), tp / sum(g for *_, g in rows)
            want = (p, r, 2 * p * r / (p + r), sum(flags) / len(rows))
            assert got[round(ct, 2), round(st, 2)] == pytest.approx(want, abs=6e-5)


def test_sweep_is_monotone_and_reports(spark):
    _, df = sweep_rows(spark)
    sweep = metrics.threshold_sweep(df)
    rates = {(r[0], r[1]): r.escalation_rate for r in sweep.collect()}
    confidences, similarities = sorted({c for c, _ in rates}), sorted({s for _, s in rates})
    for a, b in zip(confidences, confidences[1:]):
        assert all(rates[a, s] <= rates[b, s] for s in similarities)
    for a, b in zip(similarities, similarities[1:]):
        assert all(rates[c, a] <= rates[c, b] for c in confidences)
    best = metrics.threshold_best(sweep).collect()
    assert len(best) == 10 and [r.f1 for r in best] == sorted((r.f1 for r in best), reverse=True)
    assert metrics.threshold_balanced(sweep, 2.0, 0.0).count() == 0


def test_metric_lines(spark):
    df = labelled(spark, [("a", "a"), ("b", "a")])
    lines = metrics.metric_lines(metrics.class_metrics(df, "gold", "predicted"), "label").collect()
    assert ("support", "b", 1.0) in {tuple(r) for r in lines}
    plain = metrics.metric_lines(metrics.macro_f1(df, "gold", "predicted")).collect()
    assert ("accuracy", "", 0.5) in {tuple(r) for r in plain}


def test_unlisted_labels_are_counted(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "zzz"), ("a", None)], "g string, p string")
    assert [r.asDict() for r in metrics.confusion_matrix(df, "g", "p", ["a"]).collect()] == [{"gold": "a", "a": 1, "other": 2}]


def test_missing_scores_and_flags(spark):
    df = spark.createDataFrame(
        [(True, False, None, 0.9), (True, False, 0.05, 0.9)],
        "gold_escalate boolean, always_escalate boolean, intent_confidence double, retrieval_similarity double",
    )
    first = metrics.threshold_sweep(df).orderBy("intent_confidence_threshold", "retrieval_similarity_threshold").first()
    assert (first.precision, first.recall) == (1.0, 0.5)
    flags = spark.createDataFrame([(True, None), (True, True), (None, True)], "g boolean, p boolean")
    row = metrics.binary_metrics(flags, F.col("g"), F.col("p")).first()
    assert (row.precision, row.recall) == (0.5, 0.5)


def test_a_label_named_other_keeps_its_column(spark):
    df = spark.createDataFrame([("a", "other"), ("a", "x"), ("other", "other")], "g string, p string")
    rows = {r.gold: r.asDict() for r in metrics.confusion_matrix(df, "g", "p", ["a", "other"]).collect()}
    assert rows["a"] == {"gold": "a", "a": 0, "other": 1, "_other": 1} and rows["other"]["other"] == 1
