"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence has the probability sigmoid(bias + sum of the
weights of its distinct words); a document is toxic if any sentence is, so its score is the
noisy-or of its sentences, 1 - product(1 - p). Only documents are labelled; the gradient of the
noisy-or shares a label out among the sentences, which then can be scored and located. A word
weighs by itself and by its first letters, which carry over to inflected forms.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom.llm.common import carry_along
from replyloom.llm.labelled import fold, training_rows

carry_along(__name__)

FOLDS = 5
# Labelled documents per class that the model is fitted on at most.
PER_CLASS = 4000
FEATURE_BITS = 20
PREFIXES = (4, 5)
EPOCHS, RATE, DECAY, BIAS = 120, 0.1, 1e-3, -4.0
# Chi-square of a feature and the label from which it takes part; invented rare words stay below.
TELLING = 25.0
# Words whose weight a task remembers before it starts anew.
MEMORY = 300_000
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def sentences(text: str | None) -> list[tuple[int, int, set[str]]]:
    """(start, end, distinct lower-case words) of each sentence that has a word."""
    out = []
    for m in _SENTENCE.finditer(text or ""):
        words = set(_WORD.findall(m[0].lower()))
        if words:
            out.append((m.start(), m.end(), words))
    return out


def word_features(word: str) -> list[int]:
    """Hashed features of a word: itself and its first letters."""
    names = ["w " + word, *[f"{n} {word[:n]}" for n in PREFIXES if len(word) >= n]]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) & ((1 << FEATURE_BITS) - 1) for n in names]


@dataclass
class ToxicityModel:
    features: np.ndarray
    weights: np.ndarray
    bias: float

    def parts(self) -> tuple[dict[int, float], float]:
        return dict(zip(self.features.tolist(), self.weights.tolist())), self.bias


def _telling(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Features that stand in toxic documents more often than chance would have it."""
    n = n_toxic + n_clean
    every = toxic + clean
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = n * (toxic * n_clean - clean * n_toxic) ** 2 / (every * (n - every) * n_toxic * n_clean)
    # A feature of all documents tells nothing.
    return np.flatnonzero((every < n) & (toxic * n_clean > clean * n_toxic) & (np.nan_to_num(chi) >= TELLING))


def fit_bags(features: np.ndarray, sentence: np.ndarray, doc: np.ndarray, label: np.ndarray, weight: np.ndarray) -> ToxicityModel:
    """Fit on feature occurrences, the sentence of each, the document of each sentence."""
    seen = np.zeros((2, 1 << FEATURE_BITS))
    ends = np.searchsorted(doc[sentence], np.arange(len(label) + 1)) if len(sentence) else np.zeros(len(label) + 1, np.int64)
    for kind, first, last in zip(label, ends, ends[1:]):
        seen[kind, np.unique(features[first:last])] += 1
    known = _telling(seen[1], seen[0], (label == 1).sum(), (label == 0).sum())
    if not len(known) or label.min() == label.max():
        share = float((label * weight).sum() / weight.sum()) if len(label) else 0.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), float(np.log(share / (1 - share))))
    place = np.full(1 << FEATURE_BITS, -1, np.int32)
    place[known] = np.arange(len(known))
    at = place[features]
    at, sentence = at[at >= 0], sentence[at >= 0]
    n_sentences, n_docs = len(doc), len(label)
    w, bias = np.zeros(len(known)), BIAS
    m, v = np.zeros(len(known) + 1), np.zeros(len(known) + 1)
    total = weight.sum()
    for step in range(1, EPOCHS + 1):
        z = bias + np.bincount(sentence, weights=w[at], minlength=n_sentences)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.bincount(doc, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n_docs))
        any_ = np.maximum(1 - none, 1e-9)
        # d(-log likelihood)/dz: p for a clean document, -p * none / any for a toxic one.
        factor = np.where(label == 1, -none / any_, 1.0) * weight / total
        g = p * factor[doc]
        grad = np.append(np.bincount(at, weights=g[sentence], minlength=len(known)) + DECAY * w / len(known), g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
    return ToxicityModel(known, w, float(bias))


def fit(docs: DataFrame, labels: DataFrame, seen: Column, per_class: int = PER_CLASS) -> ToxicityModel:
    """Train on at most ``per_class`` labelled documents of each class.

    Features are made by the tasks and fitted in one of them. Without labels of both classes
    every sentence gets the same score.
    """

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, label, weight in zip(batch["text"], batch["label"], batch["weight"]):
                found, ends = [], []
                for _, _, words in sentences(text):
                    for word in words:
                        found.extend(word_features(word))
                    ends.append(len(found))
                rows.append((np.array(found, np.int32).tobytes(), np.array(ends, np.int32).tobytes(), label, weight))
            yield pd.DataFrame(rows, columns=["features", "ends", "label", "weight"]).assign(part=0)

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["label", "features"], kind="stable")
        features = np.concatenate([np.frombuffer(f, np.int32) for f in rows["features"]])
        lengths = [np.diff(np.frombuffer(e, np.int32), prepend=0) for e in rows["ends"]]
        each = np.array([len(x) for x in lengths], np.int64)
        size = np.concatenate(lengths).astype(np.int64)
        model = fit_bags(
            features,
            np.repeat(np.arange(len(size), dtype=np.int32), size),
            np.repeat(np.arange(len(rows), dtype=np.int32), each),
            rows["label"].to_numpy(np.int64),
            rows["weight"].to_numpy(np.float64),
        )
        return pd.DataFrame({"features": [model.features], "weights": [model.weights], "bias": [model.bias]})

    drawn = training_rows(docs, labels, "toxic", seen, per_class, seed=31)
    rows = drawn.mapInPandas(bags, "features binary, ends binary, label int, weight double, part int")
    # One task holds the whole sample, which per_class bounds.
    fitted = rows.groupBy("part").applyInPandas(train, "features array<long>, weights array<double>, bias double").first()
    if fitted is None:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), -30.0)
    return ToxicityModel(np.array(fitted["features"], np.int64), np.array(fitted["weights"]), fitted["bias"])


class _Scorer:
    """Sentence probabilities with the weights of words seen so far kept at hand."""

    def __init__(self, weights: dict[int, float], bias: float):
        self.weights, self.bias, self.memory = weights, bias, {}

    def word(self, word: str) -> float:
        if len(self.memory) > MEMORY:
            self.memory = {}
        out = self.memory[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return out

    def sentence(self, words: set[str]) -> float:
        memory, total = self.memory, self.bias
        for w in words:
            known = memory.get(w)
            total += self.word(w) if known is None else known
        return 1 / (1 + np.exp(-min(max(total, -30.0), 30.0)))

    def document(self, text: str | None) -> float:
        none = 1.0
        for _, _, words in sentences(text):
            none *= 1 - self.sentence(words)
        return float(1 - none)


def score(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text, replacing a column of that name.

    A text without words, null or empty, has no sentence that could be toxic and scores 0.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())  # at most 2^FEATURE_BITS weights

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _Scorer(*sent.value)
        for texts in batches:
            yield pd.Series([scorer.document(t) for t in texts], dtype=float)

    return docs.withColumn(name, scores("text"))


def locate(docs: DataFrame, model: ToxicityModel, at_least: float = 0.5) -> DataFrame:
    """The offending sentences: (doc_id, first, last, sentence, score), places in characters."""
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = _Scorer(*sent.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                for start, end, words in sentences(text):
                    p = scorer.sentence(words)
                    if p >= at_least:
                        rows.append((None if pd.isna(doc_id) else int(doc_id), start, end, text[start:end].strip(), float(p)))
            out = pd.DataFrame(rows, columns=["doc_id", "first", "last", "sentence", "score"])
            yield out.astype({"doc_id": "Int64"})

    schema = "doc_id long, first long, last long, sentence string, score double"
    return docs.select("doc_id", "text").mapInPandas(find, schema)


def toxicity_table(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Held-out flag, score and prediction per document; a null id counts as held out."""
    held = F.coalesce(fold(FOLDS) == 0, F.lit(True))
    model = fit(docs, labels, ~held)
    scored = score(docs.select("doc_id", "text", held.alias("held_out")), model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
