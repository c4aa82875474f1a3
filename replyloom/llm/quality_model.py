"""Quality score: a generalised additive model with pairwise interactions.

Each numeric feature is cut into bins. Boosting goes round the features; a turn fits a shallow
tree to the gradients of one feature's bins and adds a small step of it to the feature's table.
Then the pairs with the best gain on what is left get tables over two features, boosted the
same way. A score is the sum of one entry per table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom.llm.common import carry_along
from replyloom.llm.labelled import fold, training_rows

carry_along(__name__)

FOLDS = 3
# Labelled documents per class that the model is fitted on at most.
PER_CLASS = 10_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAF_WEIGHT, DEPTH = 150, 60, 0.1, 5.0, 2
FEATURES = (
    "log_words", "word_length", "longest_word", "distinct_words", "repeated_triples", "repeated_lines",
    "line_words", "capitals", "digits", "symbols", "exclamations", "full_stops", "short_words", "beyond_ascii",
    "words_ending_in_symbols",
)
_CLASSES = np.zeros((6, 256), np.float64)
for _row, _set in enumerate((range(65, 91), range(48, 58), b"#*$%&|<>@^~{}[]=+_\\/", b"!", b".?", range(128, 256))):
    _CLASSES[_row, list(_set)] = 1
_LETTERS = np.zeros(256, np.float64)
_LETTERS[[*range(65, 91), *range(97, 123), *range(192, 256)]] = 1


def measure(text: str | None) -> list[float]:
    """The features of a whole text; all zero without words."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, digits, symbols, bangs, stops, beyond = (_CLASSES @ counts).tolist()
    letters = max(float(_LETTERS @ counts), 1.0)
    lines = [x for x in text.split("\n") if x.strip()]
    triples = len(set(zip(words, words[1:], words[2:])))
    lengths = Counter(map(len, words))
    size = sum(k * v for k, v in lengths.items())
    return [
        float(np.log1p(n)),
        size / n,
        float(max(lengths)),
        len(set(words)) / n,
        1 - triples / max(n - 2, 1) if n > 2 else 0.0,
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        upper / letters,
        digits / size,
        symbols / size,
        bangs / n,
        stops / n,
        sum(v for k, v in lengths.items() if k <= 3) / n,
        beyond / len(data),
        sum(not w[-1].isalnum() for w in words) / n,
    ]


@dataclass
class QualityModel:
    """Bin edges per feature and the tables; a plain sum of entries is the log odds."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)


def _bins(x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
    return [np.searchsorted(e, x[:, i], "right") for i, e in enumerate(edges)]


def log_odds(model: QualityModel, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model.base)
    for table, b in zip(model.tables, _bins(x, model.edges)):
        out += table[b]
    coarse = _bins(x, model.pair_edges)
    for (i, j), table in zip(model.pairs, model.pair_tables):
        out += table[coarse[i], coarse[j]]
    return out


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Newton step per bin of a tree of this depth over ordered bins with these gradient sums."""
    G, H = g.sum(), h.sum()
    value = np.full(len(g), -G / (H + 1.0))
    if depth == 0 or len(g) < 2:
        return value
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = G - left_g, H - left_h
    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - G**2 / (H + 1)
    gain[(left_h < LEAF_WEIGHT / 4) | (right_h < LEAF_WEIGHT / 4)] = -1
    at = int(np.argmax(gain))
    if gain[at] <= 1e-9:
        return value
    return np.concatenate([_tree(g[: at + 1], h[: at + 1], depth - 1), _tree(g[at + 1 :], h[at + 1 :], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Best tree that cuts one side once and each half of the other once; its gain too."""
    best, gain = np.full(g.shape, -g.sum() / (h.sum() + 1)), 0.0
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for cut in range(1, len(a)):
            value = np.empty(a.shape)
            won = -(g.sum() ** 2) / (h.sum() + 1)
            for part in (slice(0, cut), slice(cut, None)):
                gg, hh = a[part].sum(axis=0), b[part].sum(axis=0)
                step = _tree(gg, hh, 1)
                value[part] = step
                won += -(2 * (gg * step).sum() + ((hh + 0.0) * step**2).sum())
            if won > gain:
                best, gain = (value.T if flip else value), float(won)
    return best, gain


def fit_table(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> QualityModel:
    """Fit on a matrix of features, labels and row weights."""
    if not len(y) or y.min() == y.max():
        share = float(np.average(y, weights=weight)) if len(y) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return QualityModel(float(np.log(share / (1 - share))))
    quantiles = lambda k: [np.unique(np.quantile(x[:, i], np.linspace(0, 1, k + 1)[1:-1])) for i in range(x.shape[1])]
    model = QualityModel(0.0, quantiles(BINS), pair_edges=quantiles(PAIR_BINS))
    weight = weight / weight.mean()
    share = np.average(y, weights=weight)
    model.base = float(np.log(share / (1 - share)))
    bins, coarse = _bins(x, model.edges), _bins(x, model.pair_edges)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    f = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-f))
        return weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for i, table in enumerate(model.tables):
            g, h = slopes()
            size = len(table)
            step = RATE * _tree(np.bincount(bins[i], g, size), np.bincount(bins[i], h, size), DEPTH)
            table += step
            f += step[bins[i]]

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        a, b = len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1
        return np.bincount(coarse[i] * b + coarse[j], values, a * b).reshape(a, b)

    g, h = slopes()
    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: -_pair_tree(grid(*p, g), grid(*p, h))[1])
    model.pairs = ranked[:PAIRS]
    model.pair_tables = [np.zeros((len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1)) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            step = RATE * _pair_tree(grid(i, j, g), grid(i, j, h))[0]
            table += step
            f += step[coarse[i], coarse[j]]
    return model


def fit(docs: DataFrame, labels: DataFrame, seen: Column, per_class: int = PER_CLASS) -> QualityModel:
    """Train on at most ``per_class`` labelled documents of each class, measured by the tasks.

    Without labels of both classes every document gets the share of ones, 0.5 without labels.
    """

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = [measure(t) for t in batch["text"]]
            yield pd.DataFrame({"x": x, "label": batch["label"], "weight": batch["weight"]})

    drawn = training_rows(docs, labels, "quality", seen, per_class, seed=37)
    rows = drawn.mapInPandas(measured, "x array<double>, label int, weight double").collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit_table(x, np.array([r["label"] for r in rows], float), np.array([r["weight"] for r in rows], float))


def score(docs: DataFrame, model: QualityModel, name: str = "score") -> DataFrame:
    """``docs`` with the probability of good quality, replacing a column of that name.

    A null text is measured as the empty one, whose features are all zero.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))  # tables of fixed size

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = QualityModel(**sent.value)
        for texts in batches:
            x = np.array([measure(t) for t in texts], float).reshape(len(texts), len(FEATURES))
            yield pd.Series(1 / (1 + np.exp(-log_odds(model, x))))

    return docs.withColumn(name, scores("text"))


def quality_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Held-out flag, score and prediction per document; a null id counts as held out."""
    held = F.coalesce(fold(FOLDS) == 1, F.lit(True))
    model = fit(docs, labels, ~held)
    scored = score(docs.select("doc_id", "text", held.alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
