"""Words to weights and exact top-k products, whole arrays at a time in tasks that Spark deals out.

A vocabulary of bounded size goes to the tasks as a tree of words. Texts come as words joined with
spaces; a task counts and weighs the terms of a slice of some megabytes at once. For a product both
sides are packed into blocks, every block of queries meets every block of documents, and a pair of
blocks passes on the k best documents of each query. What is kept or shuffled is thus the term counts
themselves, compressed, and k rows per query and block, never a row per query and document.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Executors get these functions with the job, so none needs this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Bytes of text that a task takes apart at once.
SLICE_BYTES = 2 << 20
# Scores and products of a pair of blocks held at once.
CELLS = 2 << 20
UNIT = 10**6
# Share of all pairs that have a term in common, from which on it is multiplied in a dense matrix.
DENSE = 0.01
# How the numbers of a block are kept.
CODEC = "zstd"


def _slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``SLICE_BYTES`` of text, or one row that has more."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def _positions(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row, word) of every word of texts whose words are joined with spaces."""
    words = pc.split_pattern(pc.fill_null(texts, ""), " ")
    flat, rows = words.flatten(), pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
    filled = pc.not_equal(flat, "")
    return rows[filled.to_numpy(zero_copy_only=False)].astype(np.int64), flat.filter(filled)


# --- counting -------------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch], ngram_max: int) -> Iterator[pa.RecordBatch]:
    """(term, cf, df) of each slice of (words, copies)."""
    for batch in batches:
        for part in _slices(batch, "words"):
            copies = part.column("copies").to_numpy(zero_copy_only=False)
            rows, words = _positions(part.column("words"))
            coded = pc.dictionary_encode(words)
            word, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
            gram, grams = word, names
            for n in range(1, ngram_max + 1):
                if n > 1:
                    inside = rows[: max(len(gram) - 1, 0)] == rows[n - 1 :]
                    keys = np.where(inside & (gram[:-1] >= 0), gram[:-1] * len(names) + word[n - 1 :], -1)
                    found, gram = np.unique(keys, return_inverse=True)
                    if len(found) and found[0] < 0:
                        found, gram = found[1:], gram - 1
                    if not len(found):
                        break
                    grams = pc.binary_join_element_wise(grams.take(pa.array(found // len(names))), names.take(pa.array(found % len(names))), " ")
                at = np.flatnonzero(gram >= 0)
                pairs, tf = np.unique(gram[at] * len(copies) + rows[at], return_counts=True)
                term, times = pairs // max(len(copies), 1), copies[pairs % max(len(copies), 1)]
                sums = [np.bincount(term, weights=w, minlength=len(grams)).astype(np.int64) for w in (tf * times, times)]
                yield pa.RecordBatch.from_arrays([grams.cast(pa.string()), *map(pa.array, sums)], ["term", "cf", "df"])


def term_sums(groups: DataFrame, ngram_max: int) -> DataFrame:
    """(term, cf, df) of groups (words, copies): each slice is summed before the shuffle."""
    parts = groups.select("words", "copies").mapInArrow(partial(_counted, ngram_max=ngram_max), "term string, cf long, df long")
    return parts.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


# --- weighing -------------------------------------------------------------------------


@dataclass(frozen=True)
class Vocabulary:
    """Terms with idf and document frequency, and a tree of their words: an edge leads from a node by a word."""

    terms: pa.Array
    idf: np.ndarray
    df: np.ndarray
    words: pa.Array
    edges: np.ndarray
    targets: np.ndarray
    leaf: np.ndarray
    depth: int

    @staticmethod
    def shared(terms: DataFrame) -> Broadcast:
        """The fields as a broadcast, from a bounded table (term, idf, df). The first nodes are the words themselves.

        Terms are numbered in their order, so stored counts mean the same terms however the table is read.
        """
        table = terms.select("term", "idf", "df").toArrow().sort_by("term")
        names = pa.array(table.column("term").to_pylist(), pa.string())
        split = [t.split(" ") for t in names.to_pylist()]
        ids = {w: i for i, w in enumerate(sorted({w for ws in split for w in ws}))}
        nodes, leaf = {}, dict.fromkeys(range(len(ids)), -1)
        for i, ws in enumerate(split):
            at = ids[ws[0]]
            for w in ws[1:]:
                at = nodes.setdefault((at, ids[w]), len(ids) + len(nodes))
                leaf.setdefault(at, -1)
            leaf[at] = i
        edges = np.array([a * len(ids) + w for a, w in nodes], np.int64)
        order = np.argsort(edges)
        targets = np.array(list(nodes.values()), np.int64)
        fields = (
            names,
            table.column("idf").to_numpy(),
            table.column("df").to_numpy(),
            pa.array(list(ids), pa.string()),
            edges[order],
            targets[order],
            np.array([leaf[i] for i in range(len(leaf))], np.int64),
            max(map(len, split), default=0),
        )
        return terms.sparkSession.sparkContext.broadcast(fields)

    def tally(self, texts: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, tf) by row and term, and the length of each row before it is scaled.

        Only the terms marked in ``wanted`` are returned; the lengths are those of whole rows.
        """
        rows, words = _positions(texts)
        word = pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        node, found = word, []
        for n in range(1, self.depth + 1):
            if n > 1:
                inside = (rows[: max(len(node) - 1, 0)] == rows[n - 1 :]) & (node[:-1] >= 0) & (word[n - 1 :] >= 0)
                keys = node[:-1] * len(self.words) + word[n - 1 :]
                at = np.minimum(np.searchsorted(self.edges, keys), max(len(self.edges) - 1, 0))
                hit = inside & (self.edges[at] == keys) if len(self.edges) else np.zeros(len(keys), bool)
                node = np.where(hit, self.targets[at], -1) if len(self.edges) else np.full(len(keys), -1, np.int64)
            known = np.flatnonzero(node >= 0)
            term = self.leaf[node[known]]
            found.append((rows[known] * len(self.terms) + term)[term >= 0])
        keys, tf = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
        row, term = np.divmod(keys, max(len(self.terms), 1))
        weight = _raw_weight(tf, self.idf[term])
        norm = np.sqrt(np.bincount(row, weights=weight * weight, minlength=len(texts)))
        if wanted is not None:
            kept = wanted[term]
            row, term, tf = row[kept], term[kept], tf[kept]
        return row, term, tf, norm

    def weigh(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, weight) by row and term: sublinear tf times idf, rows of unit length."""
        row, term, tf, norm = self.tally(texts)
        return row, term, _raw_weight(tf, self.idf[term]) / norm[row]


def _raw_weight(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    by_count = 1.0 + np.log(np.arange(1.0, (int(tf.max()) if len(tf) else 0) + 2))
    return by_count[tf - 1] * idf


def _vectors(batches: Iterator[pa.RecordBatch], shared: Broadcast, key: str) -> Iterator[pa.RecordBatch]:
    vocabulary = Vocabulary(*shared.value)
    for batch in batches:
        for part in _slices(batch, "words"):
            row, term, weight = vocabulary.weigh(part.column("words"))
            rows, starts = np.unique(row, return_index=True)
            entries = pa.StructArray.from_arrays([vocabulary.terms.take(pa.array(term)), pa.array(weight)], ["term", "weight"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)), pa.int32()), entries)
            yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(rows)), lists], [key, "terms"])


def weighed(texts: DataFrame, shared: Broadcast, key: str) -> DataFrame:
    """(key, terms) of texts (key, words): the known terms of each with their weights; ``shared`` is a broadcast vocabulary."""
    layout = f"{key} {texts.schema[key].dataType.simpleString()}, terms array<struct<term string, weight double>>"
    return texts.select(key, "words").mapInArrow(partial(_vectors, shared=shared, key=key), layout)


# --- products -------------------------------------------------------------------------


def _squeezed(numbers: np.ndarray) -> bytes:
    """Whole numbers as their differences, compressed."""
    return pa.compress(np.diff(numbers, prepend=0).astype(np.int32).tobytes(), codec=CODEC, asbytes=True)


def _restored(raw: pa.BinaryScalar, n: int) -> np.ndarray:
    """The ``n`` numbers that ``_squeezed`` was given."""
    return np.cumsum(np.frombuffer(pa.decompress(raw.as_buffer(), 4 * n, codec=CODEC), np.int32), dtype=np.int64)


def _packed(batches: Iterator[pa.RecordBatch], shared: Broadcast, wanted: Broadcast | None, by_term: bool) -> Iterator[pa.RecordBatch]:
    """One row per slice of (key, words): keys in order, and its entries by row, or by term."""
    vocabulary, marks = Vocabulary(*shared.value), wanted.value if wanted is not None else None
    for batch in batches:
        for part in _slices(batch, "words"):
            part = part.take(pc.sort_indices(part.column("key")))
            row, term, tf, norm = vocabulary.tally(part.column("words"), marks)
            if not len(row):
                continue
            if by_term:
                order = np.argsort(term, kind="stable")
                row, term, tf = row[order], term[order], tf[order]
            keys = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("key"))
            raw = [pa.array([x], pa.binary()) for x in (norm.tobytes(), *map(_squeezed, (row, term, tf)))]
            sums = [pa.array([int(x)], pa.int64()) for x in (len(row), vocabulary.df[term].sum())]
            yield pa.RecordBatch.from_arrays([keys, *raw, *sums], ["keys", "norms", *ENTRY, "n", "work"])


# What a block holds of each entry.
ENTRY = ("rows", "terms", "counts")


def packed(texts: DataFrame, shared: Broadcast, wanted: Broadcast | None = None, by_term: bool = False) -> DataFrame:
    """Blocks of texts (key, words) with ``n`` entries; ``work`` sums the document frequencies of a block's entries."""
    binary = ", ".join(f"{x} binary" for x in ("norms", *ENTRY))
    layout = f"keys array<{texts.schema['key'].dataType.simpleString()}>, {binary}, n long, work long"
    return texts.mapInArrow(partial(_packed, shared=shared, wanted=wanted, by_term=by_term), layout)


def _narrowed(batches: Iterator[pa.RecordBatch], wanted: Broadcast) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            n = batch.column("n")[i].as_py()
            row, term, tf = (_restored(batch.column(x)[i], n) for x in ENTRY)
            kept = wanted.value[term]
            if kept.any():
                raw = [pa.array([_squeezed(x[kept])], pa.binary()) for x in (row, term, tf)]
                same = [batch.column(x).slice(i, 1) for x in ("keys", "norms")]
                yield pa.RecordBatch.from_arrays([*same, *raw, pa.array([int(kept.sum())], pa.int64())], ["keys", "norms", *ENTRY, "n"])


def narrowed(blocks: DataFrame, wanted: Broadcast) -> DataFrame:
    """``blocks`` with the entries of the terms marked in ``wanted`` only; norms stay those of whole rows."""
    columns = ["keys", "norms", *ENTRY, "n"]
    layout = ", ".join(f"{x} {blocks.schema[x].dataType.simpleString()}" for x in columns)
    return blocks.select(*columns).mapInArrow(partial(_narrowed, wanted=wanted), layout)


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros(0, np.int64)
    for batch in batches:
        for raw, n in zip(batch.column("terms"), batch.column("n")):
            found = np.union1d(found, _restored(raw, n.as_py()))
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32())], ["term"])


def marked_terms(blocks: DataFrame, size: int) -> np.ndarray:
    """Which of the ``size`` terms of the vocabulary any block has."""
    marks = np.zeros(size, bool)
    for row in blocks.select("terms", "n").mapInArrow(_distinct, "term int").distinct().toArrow().column("term").chunks:
        marks[row.to_numpy()] = True
    return marks


def _first_best(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the best rounded score of each row that has one above 0, the first of equal ones."""
    top = np.floor(score.max(axis=1) * UNIT + 0.5)
    # Few cells come near the best of their row; only these are rounded.
    cell = np.flatnonzero(score >= ((top - 0.5) / UNIT - 1e-9)[:, None])
    near = score.ravel()[cell]
    cell = cell[(near > 0) & (np.floor(near * UNIT + 0.5) == top[cell // score.shape[1]])]
    row, first = np.unique(cell // score.shape[1], return_index=True)
    return row, cell[first] % score.shape[1]


def _pair_best(q_row: np.ndarray, q_term: np.ndarray, q_weight: np.ndarray, n_q: int, d_row: np.ndarray, d_term: np.ndarray, d_weight: np.ndarray, n_d: int, k: int) -> Iterator[tuple]:
    """(query row, document row, score) of the k best documents of each query; documents stand in order of their keys.

    Terms that many queries and documents have are multiplied as a dense matrix, the others posting by posting.
    """
    starts = np.flatnonzero(np.diff(d_term, prepend=-1))
    terms, counts = d_term[starts], np.diff(np.append(starts, len(d_term)))
    at = np.minimum(np.searchsorted(terms, q_term), len(terms) - 1)
    hit = terms[at] == q_term
    q_row, at, q_weight = q_row[hit], at[hit], q_weight[hit]
    products = np.bincount(at, minlength=len(terms)) * counts
    frequent = np.flatnonzero(products >= DENSE * n_q * n_d)
    # The dense matrices hold no more than a few runs of scores.
    frequent = frequent[np.argsort(-products[frequent], kind="stable")[: 4 * CELLS // (n_q + n_d)]]
    place = np.full(len(terms), -1)
    place[frequent] = np.arange(len(frequent))
    line = np.repeat(place, counts)
    dense = np.zeros((len(frequent), n_d))
    dense[line[line >= 0], d_row[line >= 0]] = d_weight[line >= 0]
    queries = np.zeros((n_q, len(frequent)))
    line = place[at]
    queries[q_row[line >= 0], line[line >= 0]] = q_weight[line >= 0]
    q_row, at, q_weight = q_row[line < 0], at[line < 0], q_weight[line < 0]
    # Queries in runs, so that neither their products nor their scores are many.
    ends = np.searchsorted(q_row, np.arange(n_q + 1))
    spent = np.append(0, np.cumsum(counts[at]))[ends] + np.arange(n_q + 1) * n_d
    first = 0
    while first < n_q:
        last = max(first + 1, int(np.searchsorted(spent, spent[first] + CELLS, "right")) - 1)
        a, b = ends[first], ends[last]
        score = queries[first:last] @ dense
        if b > a:
            long = counts[at[a:b]]
            before = np.cumsum(long) - long
            entry = np.arange(long.sum()) + np.repeat(starts[at[a:b]] - before, long)
            cell = np.repeat((q_row[a:b] - first) * n_d, long) + d_row[entry]
            score += np.bincount(cell, weights=np.repeat(q_weight[a:b], long) * d_weight[entry], minlength=score.size).reshape(score.shape)
        if k == 1:
            run, column = _first_best(score)
        else:
            # Rounded scores and, in what is left, the order of keys: one number decides both.
            rank = np.where(score > 0, np.floor(score * UNIT + 0.5).astype(np.int64) * n_d + np.arange(n_d - 1, -1, -1), -1)
            top = np.argpartition(rank, max(n_d - k, 0), axis=1)[:, max(n_d - k, 0) :]
            run, column = np.repeat(np.arange(last - first), top.shape[1]), top.ravel()
            real = score[run, column] > 0
            run, column = run[real], column[real]
        if len(run):
            yield run + first, column, score[run, column]
        first = last


def _best(batches: Iterator[pa.RecordBatch], shared: Broadcast, k: int) -> Iterator[pa.RecordBatch]:
    idf = Vocabulary(*shared.value).idf
    for batch in batches:
        for i in range(batch.num_rows):
            sides = {}
            for side in "qd":
                n = batch.column(f"{side}_n")[i].as_py()
                row, term, tf = (_restored(batch.column(f"{side}_{x}")[i], n) for x in ENTRY)
                norm = np.frombuffer(batch.column(f"{side}_norms")[i].as_buffer(), float)
                sides[side] = batch.column(f"{side}_keys")[i].values, (row, term, _raw_weight(tf, idf[term]) / norm[row])
            (q_keys, q), (d_keys, d) = sides["q"], sides["d"]
            for run, column, score in _pair_best(*q, len(q_keys), *d, len(d_keys), k):
                yield pa.RecordBatch.from_arrays([q_keys.take(pa.array(run)), d_keys.take(pa.array(column)), pa.array(score)], ["query_id", "doc_id", "part"])


def best_of_pairs(queries: DataFrame, documents: DataFrame, shared: Broadcast, k: int) -> DataFrame:
    """(query_id, doc_id, part): per pair of blocks the k best documents of each query.

    Both sides are blocks from ``packed`` with the vocabulary ``shared``, the documents by term.
    The best k of all are among the rows.
    """
    kinds = [df.schema["keys"].dataType.elementType.simpleString() for df in (queries, documents)]
    q, d = (df.select(*[F.col(c).alias(f"{side}_{c}") for c in ("keys", "norms", *ENTRY, "n")]) for side, df in (("q", queries), ("d", documents)))
    layout = f"query_id {kinds[0]}, doc_id {kinds[1]}, part double"
    return q.hint("shuffle_replicate_nl").crossJoin(d).mapInArrow(partial(_best, shared=shared, k=k), layout)
