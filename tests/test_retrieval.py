from __future__ import annotations

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from replyloom import session
from replyloom.functions.text import signature
from replyloom.operators import index, product, retrieve
from replyloom.sources import artefacts


def terms_of(text):
    words = [w for w in text.lower().split() if len(w) > 1]
    return Counter(words + [" ".join(p) for p in zip(words, words[1:])])


def brute_force(docs, queries, k, min_df=2, cap=None):
    """Dictionary product over plain ASCII texts."""
    counts = {i: terms_of(t) for i, t in docs.items()}
    df, cf = Counter(), Counter()
    for c in counts.values():
        df.update(c.keys())
        cf.update(c)
    vocab = [t for t in sorted(df, key=lambda t: (-cf[t], t)) if df[t] >= min_df][:cap]
    idf = {t: math.log((1 + len(docs)) / (1 + df[t])) + 1 for t in vocab}

    def vector(c):
        raw = {t: (1 + math.log(n)) * idf[t] for t, n in c.items() if t in idf}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        return {t: w / norm for t, w in raw.items()}

    vectors = {i: vector(c) for i, c in counts.items()}
    out = {}
    for q, text in queries.items():
        v = vector(terms_of(text))
        sims = []
        for i, d in vectors.items():
            if v.keys() & d.keys():
                sims.append((-round(sum(w * d.get(t, 0.0) for t, w in v.items()), 6), i))
        out[q] = [(i, -s) for s, i in sorted(sims)[:k]] or [(None, 0.0)]
    return out


def frames(spark, docs, queries):
    d = spark.createDataFrame(
        [(i, t, f"reply {i}") for i, t in docs.items()], "src_ord long, customer_text string, brand_response string"
    )
    q = spark.createDataFrame(list(queries.items()), "query_id long, customer_text string")
    return d, q


def collected(result):
    got = {}
    for r in result.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.similarity))
    return got


def corpus(seed, n_docs=120, n_queries=25):
    """Skewed words: two of them are in most texts, and one text is very frequent."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]

    def text():
        body = [words[min(int(rng.expovariate(0.08)), 59)] for _ in range(rng.randint(1, 14))]
        return " ".join([*(["the"] if rng.random() < 0.8 else []), *body, *(["of"] if rng.random() < 0.5 else [])])

    docs = {i * 3: ("the w0 w1" if i % 3 == 0 else text()) for i in range(n_docs)}
    queries = {i: text() for i in range(n_queries)}
    queries[n_queries] = "nothing shared here"
    queries[n_queries + 1] = ""
    queries[n_queries + 2] = "the"
    queries[n_queries + 3] = docs[3]
    queries[n_queries + 4] = docs[3]
    return docs, queries


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("k", [1, 5])
def test_equals_full_product(spark, seed, k):
    docs, queries = corpus(seed)
    d, q = frames(spark, docs, queries)
    got = collected(retrieve.retrieve(q, index.build_index(d), k))
    want = brute_force(docs, queries, k)
    for key, expected in want.items():
        assert [i for i, _ in got[key]] == [i for i, _ in expected]
        assert [s for _, s in got[key]] == pytest.approx([s for _, s in expected], abs=2e-6)
    assert got[max(queries)][0][1] == pytest.approx(1.0)


def test_without_broadcasts(spark, monkeypatch):
    """The shuffle path, with hot terms cut into slices, gives the same rows."""
    docs, queries = corpus(3)
    d, q = frames(spark, docs, queries)
    want = collected(retrieve.retrieve(q, index.build_index(d), 3))
    monkeypatch.setattr(session, "BROADCAST_ROWS", 0)
    for module in (index, retrieve):
        monkeypatch.setattr(module, "SLICE_ROWS", 10)
    built = index.build_index(d)
    assert not built.bounded and built.postings.agg(F.max("slices")).first()[0] > 1
    assert collected(retrieve.retrieve(q, built, 3)) == want


def test_bounds_leave_out_frequent_terms(spark):
    """The candidate join must not see every term, else the bounds do nothing."""
    docs, queries = corpus(4, n_docs=400)
    d, q = frames(spark, docs, queries)
    built = index.build_index(d)
    vectors = retrieve.query_vectors(q, built, "query_id", "customer_text")
    assert vectors.count() > 0
    probe = retrieve._probe_terms(vectors.withColumnRenamed("weight", "query_weight"), 1)
    assert probe.count() < vectors.count()


def test_ties_go_to_the_smaller_id(spark):
    docs = {9: "red apple", 4: "red apple", 7: "green pear", 2: "green pear"}
    d, q = frames(spark, docs, {1: "red apple"})
    assert collected(retrieve.retrieve(q, index.build_index(d), 2))[1] == [(4, 1.0), (9, 1.0)]


def test_equal_words_are_one_vector_and_many_documents(spark):
    docs = {5: "Red, apple!", 3: "red apple", 8: "RED apple", 1: "green pear", 9: "green pear"}
    d, q = frames(spark, docs, {1: "red apple", 2: "Red apple?", 3: "apple pear"})
    built = index.build_index(d)
    assert built.has_copies and built.postings.select("doc_id").distinct().count() == 2
    got = collected(retrieve.retrieve(q, built, 2))
    assert got[1] == got[2] == [(3, 1.0), (5, 1.0)]
    assert [i for i, _ in collected(retrieve.retrieve(q, built, 9))[3]] == [1, 9, 3, 5, 8]
    assert built.document_weights().count() == 15
    assert {r.stage: r.n for r in built.counts().collect()} == {"documents": 5, "features": 6}


def test_no_shared_term_keeps_the_query(spark):
    d, q = frames(spark, {1: "red apple", 2: "red apple"}, {5: "zz yy"})
    row = retrieve.retrieve(q, index.build_index(d), 3).first()
    assert (row.query_id, row["rank"], row.doc_id, row.similarity, row.retrieved_brand_response) == (5, 1, None, 0.0, None)


def test_empty_vocabulary(spark):
    d, q = frames(spark, {1: "alone", 2: "apart"}, {5: "alone"})
    assert collected(retrieve.retrieve(q, index.build_index(d), 1)) == {5: [(None, 0.0)]}
    assert collected(retrieve.retrieve(q, index.build_index(d, min_df=1), 1)) == {5: [(1, 1.0)]}


@pytest.mark.parametrize("cap", [1, 2, 3, 4, 100])
def test_vocabulary_cap(spark, cap):
    stats = spark.createDataFrame(
        [("a", 9, 3), ("d", 5, 2), ("c", 5, 4), ("b", 5, 2), ("x", 50, 1), ("e", 2, 2)], "term string, cf long, df long"
    )
    got = {r.term for r in index.select_vocabulary(stats, 2, cap).collect()}
    assert got == set(["a", "b", "c", "d", "e"][:cap])


def test_capped_index(spark):
    docs, queries = corpus(5)
    d, q = frames(spark, docs, queries)
    got = collected(retrieve.retrieve(q, index.build_index(d, max_features=25), 2))
    for key, expected in brute_force(docs, queries, 2, cap=25).items():
        assert [i for i, _ in got[key]] == [i for i, _ in expected]


def test_unit_length(spark):
    d, _ = frames(spark, *corpus(6))
    built = index.build_index(d)
    norms = built.postings.groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n"))
    assert norms.where(F.abs(F.col("n") - 1) > 1e-9).count() == 0


def test_save_and_load(spark, tmp_path):
    d, q = frames(spark, *corpus(7))
    built = index.build_index(d)
    built.save(str(tmp_path / "ix"))
    loaded = index.TextIndex.load(spark, str(tmp_path / "ix"))
    assert collected(retrieve.retrieve(q, loaded, 2)) == collected(retrieve.retrieve(q, built, 2))
    assert {r.stage: r.n for r in loaded.counts().collect()} == {r.stage: r.n for r in built.counts().collect()}


def test_a_killed_writer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    d, q = frames(spark, *corpus(7))
    root, built = str(tmp_path / "ix"), index.build_index(d)
    with pytest.raises(FileNotFoundError):
        index.TextIndex.load(spark, root)
    built.save(root)
    want, real, written = collected(retrieve.retrieve(q, built, 2)), index.write_table, []

    def dies(df, path):
        if len(written) == 2:
            raise RuntimeError("killed")
        written.append(path)
        real(df, path)

    monkeypatch.setattr(index, "write_table", dies)
    with pytest.raises(RuntimeError):
        built.save(root)
    assert len(written) == 2 and len(artefacts.versions(spark, root)) == 1
    assert collected(retrieve.retrieve(q, index.TextIndex.load(spark, root), 2)) == want
    monkeypatch.setattr(index, "write_table", real)
    newer = index.build_index(d.where("src_ord < 60"))
    newer.save(root)
    assert [n for n, _ in artefacts.versions(spark, root)] == [2, 1]
    loaded = index.TextIndex.load(spark, root)
    assert loaded.docs.count() == 20 and collected(retrieve.retrieve(q, loaded, 2)) == collected(retrieve.retrieve(q, newer, 2))


def test_blocks_hold_each_posting_once(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_POSTINGS", 2)
    d, _ = frames(spark, *corpus(8))
    built = index.build_index(d)
    flat = built.vectors.select("doc_id", F.explode("terms").alias("e")).select("e.term", "doc_id", "e.weight")
    rows = lambda df: sorted(map(tuple, df.select("term", "doc_id", "weight").collect()))
    assert rows(built.postings) == rows(flat)
    sized = built.blocks.select("max_weight", F.array_max("postings.weight").alias("top"), F.array_min("postings.weight").alias("low"))
    assert sized.where("max_weight <> top or low * 1.26 < top").count() == 0
    assert built.blocks.groupBy("term").count().agg(F.max("count")).first()[0] > 8


def test_blocks_below_the_bound_are_skipped(spark, monkeypatch):
    """Blocks that cannot matter are not unpacked, and the result stays the full product."""
    docs, queries = corpus(9, n_docs=400)
    d, q = frames(spark, docs, queries)
    built = index.build_index(d)
    joined = []
    real = retrieve._on_terms

    def counted(blocks, wanted, small):
        if "needed" in wanted.columns:
            every = blocks.join(wanted, "term")
            joined.append((every.where("max_weight >= needed").count(), every.count()))
        return real(blocks, wanted, small)

    monkeypatch.setattr(retrieve, "_on_terms", counted)
    got = collected(retrieve.retrieve(q, built, 1))
    assert joined[0][0] < joined[0][1]
    for key, expected in brute_force(docs, queries, 1).items():
        assert [i for i, _ in got[key]] == [i for i, _ in expected]


@pytest.mark.parametrize("rows", [0, 2000])
def test_scan_takes_the_terms_of_few_queries(spark, monkeypatch, rows):
    monkeypatch.setattr(retrieve, "FILTER_ROWS", rows)
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    docs, queries = corpus(10)
    d, q = frames(spark, docs, {k: v for k, v in queries.items() if k < 3})
    built = index.build_index(d)
    plans = []
    real = retrieve._on_terms
    monkeypatch.setattr(retrieve, "_on_terms", lambda b, w, s: plans.append(b._jdf.queryExecution().toString()) or real(b, w, s))
    got = collected(retrieve.retrieve(q, built, 2))
    assert ("In(term" in plans[-1]) == bool(rows) and "GreaterThanOrEqual(max_weight" in plans[-1]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    want = brute_force(docs, queries, 2)
    assert {k: [i for i, _ in v] for k, v in got.items()} == {k: [i for i, _ in want[k]] for k in got}


def test_corpora(spark):
    data = [
        (0, "hello there", "r1"), (1, "hello there", "r2"), (2, "hello there", "r1"),
        (3, " secret ", "r3"), (4, "secret", "r4"), (5, " ", "r5"), (6, "ok", None), (7, "fine", "r7"),
    ]
    pairs = spark.createDataFrame(data, "src_ord long, customer_text string, brand_response string")
    golden = spark.createDataFrame([("\tsecret",), (None,)], "customer_text string")
    assert sorted(r.src_ord for r in index.corpus_full(pairs).collect()) == [0, 1, 3, 4, 7]
    assert sorted(r.src_ord for r in index.corpus_leakage_free(pairs, golden).collect()) == [0, 7]


def test_report(spark):
    best = spark.createDataFrame([(1, 0.5), (2, 0.0), (3, 1.0), (4, 0.25)], "query_id long, similarity double")
    row = retrieve.retrieval_report(best).first()
    assert (row.queries, row.mean_similarity, row.max_similarity, row.min_similarity, row.median_similarity) == (
        4, 0.4375, 1.0, 0.0, 0.375,
    )
    assert [r.query_id for r in retrieve.top_matches(best, "query_id", 2).collect()] == [3, 1]


@pytest.mark.parametrize("extra", [[], [(1, "two words here")], [(None, "lonely words"), (None, "lonely words")]])
def test_queries_with_equal_words_are_looked_up_once_and_stay(spark, extra):
    rows = [(1, "two words here"), (2, "Two, words here"), (3, "three words here"), (4, "two words HERE"), (None, "three words here")]
    queries = spark.createDataFrame(rows + extra, "query_id long, customer_text string")
    worded = queries.select("query_id", signature(F.col("customer_text")).alias("query_text"))
    worded = worded.withColumn("__digest", F.md5("query_text"))
    got = retrieve._looked_up(worded, worded.select(F.col("query_id").alias("__key"), "__digest"))
    want = {(1, "two words here"), (3, "three words here")} | {r for r in extra if r[0] is None}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    shuffles = "hashpartitioning" in got._jdf.queryExecution().executedPlan().toString()
    assert shuffles == bool(extra)


@pytest.mark.parametrize(("cap", "products"), [(100, 0), (100, 10**7), (None, 10**7)])
def test_a_saved_index_of_bounded_terms_holds_counts(spark, tmp_path, monkeypatch, cap, products):
    monkeypatch.setattr(retrieve, "PRODUCT_ROWS", products)
    docs, queries = corpus(14)
    d, q = frames(spark, docs, queries)
    root, built = str(tmp_path / "ix"), index.build_index(d, max_features=cap)
    folder = built.save(root)
    postings = {"terms", "vectors", "blocks"} if cap is None else {"fitted", "packed"}
    assert set(os.listdir(folder)) == {"docs", "groups", "meta"} | postings
    loaded = index.TextIndex.load(spark, root)
    if products == 0:
        monkeypatch.setattr(product, "packed", lambda texts, *a, real=product.packed, **b: pytest.fail("counted again") if b else real(texts, *a))
    got = collected(retrieve.retrieve(q, loaded, 2))
    assert ("vectors" in vars(loaded)) == (products > 0 and cap is not None) or cap is None
    for key, expected in brute_force(docs, queries, 2, cap=cap).items():
        assert [i for i, _ in got[key]] == [i for i, _ in expected]
    flat = loaded.document_weights()
    assert sorted(map(tuple, flat.select("doc_id", "term", F.round("weight", 9)).collect())) == sorted(
        map(tuple, built.document_weights().select("doc_id", "term", F.round("weight", 9)).collect())
    )
