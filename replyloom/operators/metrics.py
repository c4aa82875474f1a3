"""Metric tables. Everything derives from small grouped counts, never from whole rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom.operators.rows import top_n

DIGITS = 6


def ratio(num: Column, den: Column) -> Column:
    """Quotient as double; 0.0 when the denominator is zero."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def f1_of(precision: Column, recall: Column) -> Column:
    return ratio(F.lit(2.0) * precision * recall, precision + recall)


def value_counts(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def majority_label(df: DataFrame, label: str) -> DataFrame:
    """One row: the most frequent label, the smaller name on a tie."""
    counts = value_counts(df, label)
    return counts.orderBy(F.col("n").desc(), label).limit(1).select(F.col(label).alias("majority"))


def confusion_counts(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(gold, predicted, n): at most labels squared lines."""
    return df.groupBy(F.col(gold).alias("gold"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(df: DataFrame, gold: str, predicted: str, labels: Sequence[str]) -> DataFrame:
    """Cross-tabulation with one column per label, one for all the rest, and zero cells.

    The column of the rest is ``other``, with as many underscores before it as keep it apart from
    a label of that name.
    """
    rest = "other"
    while rest in labels:
        rest = f"_{rest}"
    listed = F.when(F.col("predicted").isin(*labels), F.col("predicted")).otherwise(rest)
    return (
        confusion_counts(df, gold, predicted)
        .withColumn("predicted", listed)
        .groupBy("gold")
        .pivot("predicted", list(dict.fromkeys([*labels, rest])))
        .sum("n")
        .na.fill(0)
    )


def confusion_pairs(df: DataFrame, gold: str, predicted: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent kinds of error."""
    errors = confusion_counts(df.where(F.col(gold) != F.col(predicted)), gold, predicted)
    return top_n(errors, n, [F.col("n").desc(), F.col("gold"), F.col("predicted")])


def label_report(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(label, precision, recall, f1, support) over the union of gold and predicted labels."""
    counts = confusion_counts(df, gold, predicted)
    hit = F.when(F.col("gold") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = counts.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("gold").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("named"), hit.alias("tp")
                ),
                F.struct(
                    F.col("predicted").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("named"), F.lit(0).cast("long").alias("tp")
                ),
            )
        ).alias("s")
    ).select("s.*")
    totals = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "named")])
    rates = totals.select(
        "label",
        ratio(F.col("tp"), F.col("named")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        "support",
        "tp",
    )
    return rates.select(
        "label", "precision", "recall", f1_of(F.col("precision"), F.col("recall")).alias("f1"), "support", "tp"
    )


def class_metrics(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Per-label report plus the lines accuracy, macro avg and weighted avg."""
    names = ("precision", "recall", "f1")
    one, support = F.lit(1.0), F.col("support").cast("double")

    def line(kind: int, label: Column, weight: Column, *values: str) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"),
            label.alias("label"),
            weight.alias("weight"),
            *[F.col(v).alias(name) for name, v in zip(names, values)],
            F.col("support"),
        )

    # Every line is a weighted mean over labels; accuracy is recall weighted by support.
    lines = label_report(df, gold, predicted).select(
        F.explode(
            F.array(
                line(0, F.col("label"), one, *names),
                line(1, F.lit("accuracy"), support, "recall", "recall", "recall"),
                line(2, F.lit("macro avg"), one, *names),
                line(3, F.lit("weighted avg"), support, *names),
            )
        ).alias("l")
    ).select("l.*")
    weighted = [
        F.round(ratio(F.sum(F.col(n) * F.col("weight")), F.sum("weight")), DIGITS).alias(n) for n in names
    ]
    return lines.groupBy("kind", "label").agg(*weighted, F.sum("support").alias("support")).drop("kind")


def macro_f1(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """One row: accuracy and unweighted mean F1 over the union of labels."""
    return label_report(df, gold, predicted).agg(
        F.round(ratio(F.sum("tp"), F.sum("support")), DIGITS).alias("accuracy"),
        F.round(F.coalesce(F.avg("f1"), F.lit(0.0)), DIGITS).alias("macro_f1"),
    )


def binary_rates(tp: Column, fp: Column, fn: Column, total: Column) -> dict[str, Column]:
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1": f1_of(precision, recall),
        "escalation_rate": ratio(tp + fp, total),
    }


def binary_metrics(df: DataFrame, gold: Column, predicted: Column) -> DataFrame:
    """One row: precision, recall, F1, share escalated and share handled; NULL flags count as false."""
    flags = df.select(F.coalesce(gold, F.lit(False)).alias("g"), F.coalesce(predicted, F.lit(False)).alias("p"))
    counts = flags.agg(
        F.count_if(F.col("g") & F.col("p")).alias("tp"),
        F.count_if(~F.col("g") & F.col("p")).alias("fp"),
        F.count_if(F.col("g") & ~F.col("p")).alias("fn"),
        F.count(F.lit(1)).alias("total"),
    )
    rates = binary_rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("total"))
    rates["auto_handle_rate"] = F.lit(1.0) - rates["escalation_rate"]
    return counts.select(*[F.round(c, DIGITS).alias(name) for name, c in rates.items()])


def evaluation_summary(rows: DataFrame) -> DataFrame:
    """Evaluated rows as one long table (metric, label, value).

    Accuracy, macro F1, the escalation rates, rows per reason, and rows per pair of labels, whose
    line is named gold>predicted. All lines are taken from the same rows, one pass per kind.
    """
    scores = macro_f1(rows, "gold_intent", "predicted_intent")
    rates = binary_metrics(rows, F.col("gold_escalate"), F.col("predicted_escalate"))
    out = None
    for table in (scores, rates):
        lines = [F.struct(F.lit(c).alias("metric"), F.lit("").alias("label"), F.col(c).cast("double").alias("value")) for c in table.columns]
        part = table.select(F.inline(F.array(*lines)))
        out = part if out is None else out.unionByName(part)
    reasons = value_counts(rows, "escalation_reason")
    pairs = confusion_counts(rows, "gold_intent", "predicted_intent")
    return out.unionByName(
        reasons.select(F.lit("reason").alias("metric"), F.col("escalation_reason").alias("label"), F.col("n").cast("double").alias("value"))
    ).unionByName(
        pairs.select(F.lit("pair").alias("metric"), F.concat("gold", F.lit(">"), "predicted").alias("label"), F.col("n").cast("double").alias("value"))
    )


def majority_baseline(train: DataFrame, test: DataFrame, label: str) -> DataFrame:
    """Metrics of always predicting the most frequent training label."""
    majority = majority_label(train, label).scalar()
    predicted = test.select(F.col(label).alias("gold")).withColumn("predicted", majority)
    scores = macro_f1(predicted, "gold", "predicted")
    examples = predicted.agg(F.count(F.lit(1)).alias("test_rows"), F.first("predicted").alias("majority"))
    return scores.withColumns(
        {"majority": examples.select("majority").scalar(), "test_rows": examples.select("test_rows").scalar()}
    )


# Fields rated by both judge and human; the unsupported-claim flag is not compared.
RATED_FIELDS = ("grounded", "relevant", "helpful", "overall")


def rater_kappa(
    judge: DataFrame, human: DataFrame, key: str = "sample_id", fields: Sequence[str] = RATED_FIELDS
) -> DataFrame:
    """Cohen's kappa per field as (field, n, kappa); NULL when chance agreement is total."""

    def rated(df: DataFrame, side: str) -> DataFrame:
        return df.select(key, *[F.col(f).alias(f"{f}_{side}") for f in fields])

    both = rated(judge, "judge").join(rated(human, "human"), key)
    pairs = both.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(f).alias("field"),
                        F.col(f"{f}_human").cast("string").alias("a"),
                        F.col(f"{f}_judge").cast("string").alias("b"),
                    )
                    for f in fields
                ]
            )
        ).alias("p")
    ).select("p.*")
    cells = pairs.groupBy("field", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    # From here on one line per field and pair of ratings.
    none = F.lit(0).cast("long")
    same = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(none)
    margins = (
        cells.select(
            "field",
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("rating"), F.col("n").alias("by_a"), none.alias("by_b"), same.alias("same")),
                    F.struct(F.col("b").alias("rating"), none.alias("by_a"), F.col("n").alias("by_b"), none.alias("same")),
                )
            ).alias("m"),
        )
        .select("field", "m.*")
        .groupBy("field", "rating")
        .agg(*[F.sum(c).alias(c) for c in ("by_a", "by_b", "same")])
    )
    totals = margins.groupBy("field").agg(
        F.sum("by_a").alias("n"),
        F.sum("same").alias("same"),
        F.sum(F.col("by_a").cast("double") * F.col("by_b")).alias("chance"),
    )
    n = F.col("n").cast("double")
    observed, expected = F.col("same") / n, F.col("chance") / (n * n)
    return totals.select(
        "field", "n", F.round(F.try_divide(observed - expected, 1.0 - expected), DIGITS).alias("kappa")
    )


# The grid of the sweep, in the floating-point form the comparisons need.
CONFIDENCE_GRID = [float(x) for x in np.arange(0.15, 0.61, 0.05)]
SIMILARITY_GRID = [float(x) for x in np.arange(0.10, 0.61, 0.05)]


def _steps_passed(value: Column, grid: Sequence[float]) -> Column:
    """How many grid thresholds the value is not below."""
    passed = F.lit(0)
    for threshold in grid:
        passed = passed + (value >= F.lit(threshold)).cast("int")
    return passed


def threshold_sweep(
    scored: DataFrame,
    gold: str = "gold_escalate",
    always: str = "always_escalate",
    confidence: str = "intent_confidence",
    similarity: str = "retrieval_similarity",
    confidence_grid: Sequence[float] = CONFIDENCE_GRID,
    similarity_grid: Sequence[float] = SIMILARITY_GRID,
) -> DataFrame:
    """Escalation metrics for every pair of thresholds; a NULL score is below none of them.

    A row's outcome depends only on how many thresholds each of its scores passes, so the
    rows are first counted per such cell; only cells meet the grid.
    """
    cells = scored.groupBy(
        _steps_passed(F.col(confidence), confidence_grid).alias("c"),
        _steps_passed(F.col(similarity), similarity_grid).alias("s"),
        F.coalesce(F.col(always), F.lit(False)).alias("always"),
        F.coalesce(F.col(gold), F.lit(False)).alias("gold"),
    ).agg(F.count(F.lit(1)).alias("n"))
    points = F.array(
        *[
            F.struct(F.lit(i).alias("ci"), F.lit(ct).alias("ct"), F.lit(j).alias("si"), F.lit(st).alias("st"))
            for i, ct in enumerate(confidence_grid)
            for j, st in enumerate(similarity_grid)
        ]
    )
    graded = cells.withColumn("at", F.explode(points))
    # The score is below threshold number i exactly when it passes at most i of them.
    below = [F.coalesce(F.col(x) <= F.col(f"at.{x}i"), F.lit(False)) for x in ("c", "s")]
    escalated = F.col("always") | below[0] | below[1]
    graded = graded.withColumn("p", escalated).groupBy("at.ct", "at.st")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    counts = graded.agg(
        total(F.col("gold") & F.col("p")).alias("tp"),
        total(~F.col("gold") & F.col("p")).alias("fp"),
        total(F.col("gold") & ~F.col("p")).alias("fn"),
        F.sum("n").alias("total"),
    )
    rates = binary_rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("total"))
    return counts.select(
        F.bround("ct", 2).alias("intent_confidence_threshold"),
        F.bround("st", 2).alias("retrieval_similarity_threshold"),
        *[F.bround(c, 4).alias(name) for name, c in rates.items()],
    )


def threshold_best(sweep: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` best pairs by F1, then precision; ties by the lower thresholds."""
    return top_n(
        sweep,
        n,
        [
            F.col("f1").desc(),
            F.col("precision").desc(),
            F.col("intent_confidence_threshold"),
            F.col("retrieval_similarity_threshold"),
        ],
    )


def threshold_balanced(
    sweep: DataFrame, min_recall: float = 0.85, min_precision: float = 0.40, n: int = 10
) -> DataFrame:
    """The best pairs among those that reach both floors."""
    return threshold_best(
        sweep.where((F.col("recall") >= min_recall) & (F.col("precision") >= min_precision)), n
    )


def metric_lines(df: DataFrame, label: str | None = None) -> DataFrame:
    """Any metric table as the long form (metric, label, value)."""
    keep = [] if label is None else [label]
    values = [c for c in df.columns if c not in keep and dict(df.dtypes)[c] != "string"]
    wide = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in values])
    long = wide.unpivot(keep, values, "metric", "value")
    return long.select("metric", (F.col(label) if label else F.lit("")).alias("label"), "value")
