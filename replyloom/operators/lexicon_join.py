"""Weak labels and risk flags by a lexicon of any size, as a join instead of one expression per term.

A text can only contain a term if it contains each of the term's q-grams. Every term is listed
once, under the one of its q-grams that the fewest terms have; a text is looked up under its own
distinct q-grams, and the terms that it meets are verified. Terms of a bounded number go to the tasks
as a tree of characters instead, which all positions of the texts walk down at once: the time follows
the length of the texts, not their number times that of the terms. No query plan ever holds the terms.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, SparkContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from replyloom import session
from replyloom.functions.lexicon import AMBIGUOUS, FALLBACK_INTENT
from replyloom.functions.text import W, blank_if_null, normalize_text

# Executors get these functions with the job, so none needs this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Length of the grams; a shorter term is its own gram.
GRAM = 3
# Characters of text walked through at once, and a character that no text has to end each of them.
WALK_CHARS = 1 << 20
END = 0x110000


def _grams(text: Column, size: int) -> Column:
    """All substrings of ``size`` characters, found in one pass; none if the text is shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{size}}}))"), 1)


def gram_index(lexicon: DataFrame) -> DataFrame:
    """(gram, category, priority, term): each distinct term of a (category, priority, term) table under its rarest gram.

    Equal counts are decided by the gram. A category listed with several priorities has the least;
    a null or empty term is no term.
    """
    whole = Window.partitionBy("category")
    rows = (
        lexicon.where(F.col("category").isNotNull() & (F.length("term") > 0))
        .withColumn("priority", F.min("priority").over(whole))
        .select("category", "priority", "term")
        .distinct()
    )
    terms = rows.select("term").distinct()
    own = F.array_distinct(F.when(F.length("term") < GRAM, F.array("term")).otherwise(_grams(F.col("term"), GRAM)))
    listed = terms.select("term", F.explode(own).alias("gram"))
    counts = listed.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = listed.join(counts, "gram").groupBy("term").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    return session.checkpoint(rows.join(rarest, "term").select("gram", "category", "priority", "term"))


def _has_word(text: Column, term: Column) -> Column:
    quoted = F.concat(F.lit(r"\Q"), F.replace(term, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return F.regexp_like(text, F.concat(F.lit(f"(?<!{W})"), quoted, F.lit(f"(?!{W})")))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _tree(sc: SparkContext, terms: list[str]) -> Broadcast:
    """The characters of the terms in order, the edges (node, character) in order with what they lead to, and the term of each node."""
    letters = np.unique(np.concatenate([_codes(t) for t in terms]))
    node = np.zeros(len(terms), np.int64)
    codes = [np.searchsorted(letters, _codes(t)) for t in terms]
    size, alive, edges, targets, ends = 1, np.arange(len(terms)), [], [], [np.full(1, -1)]
    for depth in range(max(map(len, codes))):
        alive = alive[[len(codes[i]) > depth for i in alive]]
        keys, at = np.unique(node[alive] * len(letters) + [codes[i][depth] for i in alive], return_inverse=True)
        node[alive] = size + at
        edges.append(keys)
        targets.append(np.arange(size, size + len(keys)))
        size += len(keys)
    term = np.full(size, -1)
    term[node] = np.arange(len(terms))
    # A node's number grows with its depth and so do its edges: the keys are in order.
    return sc.broadcast((letters, np.concatenate(edges), np.concatenate(targets), term, pa.array(terms, pa.string())))


def _walked(batches: Iterator[pa.RecordBatch], tree: Broadcast) -> Iterator[pa.RecordBatch]:
    """(key, term) for every distinct term in a text of (key, text)."""
    letters, edges, targets, term, names = tree.value

    def found(keys: pa.Array, texts: list[np.ndarray]) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
        chars = np.concatenate([x for t in texts for x in (t, [END])]).astype(np.int64)
        code = np.minimum(np.searchsorted(letters, chars), len(letters) - 1)
        code = np.where(letters[code] == chars, code, -1)
        at, node, hits = np.arange(len(code)), np.zeros(len(code), np.int64), []
        while len(at):
            here = code[at]
            key = node * len(letters) + here
            edge = np.minimum(np.searchsorted(edges, key), len(edges) - 1)
            goes = (here >= 0) & (edges[edge] == key)
            start, node = at[goes], targets[edge[goes]]
            ended = term[node] >= 0
            hits.append(owner[start[ended]] * len(names) + term[node[ended]])
            # The next character; a text's end matches no edge, so no walk leaves its text.
            at = start + 1
        pairs = np.unique(np.concatenate(hits))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(pairs // len(names))), names.take(pa.array(pairs % len(names)))], ["key", "term"])

    for batch in batches:
        held, size, first = [], 0, 0
        for i, text in enumerate(batch.column("text").to_pylist()):
            held.append(_codes(text or ""))
            size += len(held[-1])
            if size >= WALK_CHARS or i + 1 == batch.num_rows:
                yield found(batch.column("key").slice(first, len(held)), held)
                held, size, first = [], 0, i + 1


def found_terms(texts: DataFrame, index: DataFrame, mode: str = "substring") -> DataFrame:
    """(key, category, priority, term) for every term of the index in a text of ``texts`` (key, text).

    ``key`` must be unique. The terms of a small index go to the tasks as a tree and texts stay where
    they are; words are verified afterwards. Otherwise only keys and grams are shuffled; texts join the terms that they met to be verified.
    """
    if mode not in ("substring", "word"):
        raise ValueError(f"unknown mode: {mode}")
    sizes = [r["n"] for r in index.select(F.length("gram").alias("n")).distinct().collect()]  # 1 to GRAM
    if not sizes:
        return texts.select("key").limit(0).join(index.drop("gram"), F.lit(True), "inner")
    grams = F.array_distinct(F.concat(*[_grams(F.col("text"), n) for n in sizes]))
    verified = F.contains("text", "term") if mode == "substring" else _has_word(F.col("text"), F.col("term"))
    out = ["key", "category", "priority", "term"]
    if session.is_small(index):
        tree = _tree(index.sparkSession.sparkContext, [r["term"] for r in index.select("term").distinct().collect()])
        met = texts.select("key", "text").mapInArrow(partial(_walked, tree=tree), f"key {texts.schema['key'].dataType.simpleString()}, term string")
        met = met.join(F.broadcast(index.drop("gram")), "term")
        return (met if mode == "substring" else met.join(texts, "key").where(verified)).select(out)
    met = texts.select("key", F.explode(grams).alias("gram")).join(index, "gram").drop("gram")
    return met.join(texts, "key").where(verified).select(out)


def _once(df: DataFrame, text: Column) -> tuple[DataFrame, DataFrame]:
    """``df`` with the digest of ``text``, and its distinct texts by digest."""
    keyed = df.withColumn("__text", text).withColumn("__key", F.md5("__text"))
    texts = keyed.select(F.col("__key").alias("key"), F.col("__text").alias("text")).dropDuplicates(["key"])
    return keyed.drop("__text"), session.checkpoint(texts)


def weak_labels(
    df: DataFrame,
    index: DataFrame,
    text: str = "customer_text",
    fallback: str = FALLBACK_INTENT,
    ambiguous: str = AMBIGUOUS,
) -> DataFrame:
    """The columns of ``functions.lexicon.weak_label`` from a ``gram_index``; equal texts are judged once."""
    keyed, texts = _once(df, normalize_text(blank_if_null(F.col(text))))
    scores = found_terms(texts, index).groupBy("key", "category", "priority").agg(F.count(F.lit(1)).cast("int").alias("score"))
    # The best category seen from either end of the priorities: two names mean a tie.
    first, last = (F.max(F.struct("score", (F.col("priority") * sign).alias("at"), "category")) for sign in (-1, 1))
    judged = scores.groupBy("key").agg(first.alias("first"), last.alias("last"), F.sum("score").alias("total"))
    verdict = judged.select(
        F.col("key").alias("__key"),
        F.when(F.col("first.category") != F.col("last.category"), F.lit(ambiguous)).otherwise(F.col("first.category")).alias("name"),
        F.col("first.score").alias("best"),
        (F.col("first.score").cast("double") / F.col("total")).alias("share"),
    )
    return keyed.join(verdict, "__key", "left").select(
        *[F.col(c) for c in df.columns],
        F.coalesce("name", F.lit(fallback)).alias("suggested_intent"),
        F.coalesce("best", F.lit(0)).alias("suggestion_score"),
        F.coalesce("share", F.lit(0.0)).alias("suggestion_share"),
    )


def risk_flags(df: DataFrame, index: DataFrame, text: str, name: str, mode: str = "substring") -> DataFrame:
    """``df`` with ``name``: the first category by priority with a term in the lower-cased text, else NULL."""
    keyed, texts = _once(df, F.lower(blank_if_null(F.col(text))))
    first = found_terms(texts, index, mode).groupBy("key").agg(F.min(F.struct("priority", "category"))["category"].alias(name))
    return keyed.join(first.withColumnRenamed("key", "__key"), "__key", "left").select(*df.columns, name)
