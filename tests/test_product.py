from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from replyloom.operators import index, product, retrieve
from tests.test_retrieval import brute_force, collected, corpus, frames


@pytest.mark.parametrize("k", [1, 5])
def test_products_of_blocks_equal_the_full_product(spark, monkeypatch, k):
    """Many queries form no row per query and document, no postings and no vectors; the result is the full product."""
    monkeypatch.setattr(retrieve, "PRODUCT_ROWS", 0)
    monkeypatch.setattr(retrieve, "PART_CHARS", 500)
    monkeypatch.setattr(retrieve, "_sum_parts", lambda parts: pytest.fail("a row per query and document"))
    docs, queries = corpus(11)
    d, q = frames(spark, docs, queries)
    built = index.build_index(d)
    got = collected(retrieve.retrieve(q, built, k))
    assert not {"vectors", "blocks"} & vars(built).keys()
    want = brute_force(docs, queries, k)
    assert got.keys() == want.keys()
    for key, expected in want.items():
        assert [i for i, _ in got[key]] == [i for i, _ in expected]
        assert [s for _, s in got[key]] == pytest.approx([s for _, s in expected], abs=2e-6)


def test_counts_need_neither_vectors_nor_blocks(spark):
    d, _ = frames(spark, *corpus(12))
    built = index.build_index(d)
    assert {r.stage for r in built.counts().collect()} == {"documents", "features"}
    assert built.document_weights().count() > 0
    assert "blocks" not in vars(built)


@pytest.mark.parametrize("few", [500_000, 1])
def test_groups_shuffle_no_text_and_weights_need_no_vectors(spark, monkeypatch, few):
    monkeypatch.setattr(index.session, "BROADCAST_ROWS", few)
    texts = ["one two three", "two three four", "one two three", "ONE two, three", "two three four", "alone here two"]
    docs = spark.createDataFrame([(i, t, "r") for i, t in enumerate(texts)], "src_ord long, customer_text string, brand_response string")
    built = index.build_index(docs, max_features=1 if few == 1 else 100)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(built.groups.select("doc_id", "copies", "words")) == [
        (0, 3, "one two three"), (1, 2, "two three four"), (5, 1, "alone here two")
    ]
    assert built.has_copies and built.n_chars == 13 + 14 + 14
    joined = index.unit_vectors(index.term_entries(docs, "src_ord", "customer_text", 2), built.fitted, "src_ord")
    want = joined.select("src_ord", F.explode("v").alias("e")).select("src_ord", "e.term", F.round("e.weight", 9))
    assert rows(built.document_weights().withColumn("weight", F.round("weight", 9))) == rows(want)
    assert "vectors" not in vars(built)
    if few > 1:
        plan = built.groups._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning" not in plan


def test_corpus_rows_are_not_shuffled(spark):
    docs, _ = frames(spark, *corpus(13))
    golden = docs.limit(3)
    left = index.corpus_leakage_free(docs, golden)
    assert "hashpartitioning" not in left._jdf.queryExecution().executedPlan().toString()
    assert left.join(golden, "customer_text").count() == 0 and left.count() > 0


@pytest.mark.parametrize("ngram_max", [1, 2, 3])
def test_sums_and_weights_equal_the_expressions(spark, monkeypatch, ngram_max):
    monkeypatch.setattr(product, "SLICE_BYTES", 40)
    texts = ["aa bb aa bb aa", "", "cc", "bb cc dd ee", "aa bb cc", "é\U0001d538 bb bb"]
    groups = spark.createDataFrame([(i, t, 1 + i % 3) for i, t in enumerate(texts)], "doc_id long, words string, copies long")
    entries = index.group_entries(groups, ngram_max)
    rows = lambda df: sorted(map(tuple, df.collect()))
    stats = product.term_sums(groups, ngram_max)
    assert rows(stats) == rows(index.term_stats(entries))
    terms = index.fit_terms(stats, F.lit(10), 2, None)
    shared = product.Vocabulary.shared(terms)
    got = product.weighed(groups, shared, "doc_id").select("doc_id", F.explode("terms").alias("e")).select("doc_id", "e.term", F.round("e.weight", 9))
    want = index.unit_vectors(entries, terms, "doc_id").select("doc_id", F.explode("v").alias("e")).select("doc_id", "e.term", F.round("e.weight", 9))
    assert rows(got) == rows(want)


def test_blocks_are_compressed_and_keep_every_weight(spark):
    """A block takes a small part of the sixteen bytes that a row, a term and a weight have."""
    texts = [(i, " ".join(f"w{(i * 7 + j * j) % 90}" for j in range(120))) for i in range(300)]
    groups = spark.createDataFrame([(i, t, 1) for i, t in texts], "key long, words string, copies long")
    terms = index.fit_terms(product.term_sums(groups, 2), F.lit(300), 2, None)
    shared = product.Vocabulary.shared(terms)
    blocks = product.packed(groups.select("key", "words"), shared)
    sizes = blocks.agg(F.sum("n"), F.sum(sum(F.octet_length(c) for c in ("norms", "rows", "terms", "counts")))).first()
    assert sizes[1] < 4 * sizes[0]
    pairs = product.best_of_pairs(blocks, product.packed(groups.select("key", "words"), shared, by_term=True), shared, 1)
    assert {r.query_id for r in pairs.where("part > 1 - 1e-9").collect()} == {i for i, _ in texts}


def test_terms_have_the_same_numbers_however_they_are_read(spark):
    terms = spark.createDataFrame([(f"{w} {v}".strip(), 1.0 + i, i) for i, w in enumerate("ecadb") for v in ("", "x")], "term string, idf double, df long")
    one, other = (product.Vocabulary(*product.Vocabulary.shared(terms.orderBy(o)).value) for o in ("df", F.desc("df")))
    assert one.terms.equals(other.terms) and list(one.idf) == list(other.idf)
    texts = pa.array(["a x b", "e c x"])
    assert all((a == b).all() for a, b in zip(one.tally(texts), other.tally(texts)))


@pytest.mark.parametrize("k", [1, 3])
@pytest.mark.parametrize("dense", [0.0, 0.1, 2.0])
@pytest.mark.parametrize("cells", [40, 1 << 20])
def test_best_of_a_pair_is_that_of_the_whole_product(monkeypatch, k, dense, cells):
    """Frequent terms in a dense matrix, in none or in part: the best rounded scores, first documents of equal ones."""
    rng = np.random.default_rng(3)
    sides = []
    for n, by_term in ((13, False), (17, True)):
        weights = np.where(rng.random((n, 9)) < np.linspace(0.05, 0.9, 9), rng.integers(1, 4, (n, 9)) / 8, 0.0)
        weights[4] = 0.0
        row, term = np.nonzero(weights)
        order = np.lexsort((row, term)) if by_term else np.lexsort((term, row))
        sides.append((weights, (row[order], term[order] * 5, weights[row, term][order], n)))
    (queries, q), (documents, d) = sides
    monkeypatch.setattr(product, "DENSE", dense)
    monkeypatch.setattr(product, "CELLS", cells)
    got: dict[int, list] = {}
    for run, column, score in product._pair_best(*q, *d, k):
        for a, b, s in zip(run.tolist(), column.tolist(), score.tolist()):
            got.setdefault(a, []).append((-round(s * product.UNIT), b))
    whole = queries @ documents.T
    for i, line in enumerate(whole):
        best = sorted((-round(s * product.UNIT), j) for j, s in enumerate(line) if s > 0)[:k]
        assert sorted(got.get(i, [])) == best
