from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import functions as F

from replyloom.llm import quality_model, toxicity, urls

SF = "/root/testdata/sf0.01"


def _accuracy(table, labels, column, folds, rest):
    rows = table.join(labels.where(F.col(column).isNotNull()), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == rest) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    return sum(r.predicted == r[column] for r in held) / len(held)


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    table = toxicity.toxicity_table(docs, labels)
    assert table.count() == docs.count()
    assert _accuracy(table, labels, "toxic", 5, 0) > 0.95


def test_sentences_are_located(spark):
    mild = "the sun is on the hill. we walk to the sea. all is well here."
    rows = [(i, mild + (" you are a blockhead today." if i % 2 else " you are a friend today."), i % 2) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.lit(True))
    found = toxicity.locate(docs, model).collect()
    assert {r.doc_id for r in found} == {i for i in range(200) if i % 2}
    assert {r.sentence for r in found} == {"you are a blockhead today"}


def test_toxicity_edges(spark, clashing, empty):
    labels = spark.createDataFrame([(1, 0), (4, None), (5, 1), (6, 0), (7, 1), (None, 1)], "doc_id long, toxic int")
    table = toxicity.toxicity_table(clashing, labels)
    assert table.count() == clashing.count() and table.where("score is null or held_out is null").count() == 0
    assert toxicity.toxicity_table(clashing, labels.limit(0)).count() == clashing.count()
    assert toxicity.toxicity_table(empty, labels).count() == 0


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    table = quality_model.quality_table(docs, labels)
    assert table.count() == docs.count()
    assert _accuracy(table, labels, "quality", 3, 1) > 0.95


def test_pairs_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    model = quality_model.fit_table(x, y, np.ones(len(y)))
    assert (0, 1) in model.pairs
    fresh = rng.normal(size=(2000, 4))
    assert ((quality_model.log_odds(model, fresh) > 0) == (fresh[:, 0] * fresh[:, 1] > 0)).mean() > 0.85


def test_quality_edges(spark, clashing, empty):
    labels = spark.createDataFrame([(1, 0), (4, None), (5, 1), (6, 0), (7, 1), (None, 1)], "doc_id long, quality int")
    assert quality_model.quality_table(clashing, labels).count() == clashing.count()
    one = quality_model.quality_table(clashing, labels.limit(0)).collect()
    assert {r.score for r in one} == {0.5}
    assert quality_model.quality_table(empty, labels).count() == 0


def _rule(host, path):
    best = None
    for r in urls.RULES:
        if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path) and (best is None or len(r.name) > len(best.name)):
            best = r
    return best


def test_rules_of_urls(spark):
    rows = [
        (1, "http://A.example.COM/en/x?q", "a.example.com", "/en/x"), (2, "http://www.example.com/en/x", "www.example.com", "/en/x"),
        (3, "https://x.net/es/", "x.net", "/es/"), (4, "ftp://net/fr/1#t", "net", "/fr/1"), (5, "no scheme", "", ""),
        (6, None, "", ""), (7, "http://example.com", "example.com", ""), (8, "http://notcom/x", "notcom", "/x"),
        (9, "a://b://c/d", "b:", "//c/d"), (10, "http://q?x://y", "q", ""), (11, "", "", ""), (None, "http://a.com/b", "a.com", "/b"),
    ]
    pages = spark.createDataFrame([(i, u, "h") for i, u, _, _ in rows], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.url_table(pages).collect()}
    assert len(got) == len(rows)
    for i, _, host, path in rows:
        rule = _rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule.name if rule else None)
        assert got[i].verdict in ("allow", "block") and (not rule or got[i].verdict == rule.verdict)
    assert urls.url_table(pages.limit(0)).count() == 0


def test_models_judge_the_whole_url(spark):
    shown = {1: ("HTTP://A.Org/X?Q=a://B#f", "HTTP://a.org/X?Q=a://B#f"), 2: ("No/Scheme?Q", "No/Scheme?Q"), 3: (None, ""), 4: ("://H", "://h")}
    rows = spark.createDataFrame([(i, u) for i, (u, _) in shown.items()], "page_id long, url string")
    assert {r.page_id: r.t for r in rows.select("page_id", urls.judged_text("url").alias("t")).collect()} == {i: t for i, (_, t) in shown.items()}
    pages = [(i, f"http://a{i}.com/good?topic=flower{i}#top") for i in range(60)]
    pages += [(100 + i, f"ftp://b{i}.net/es/good?spam=zzkk{i}") for i in range(60)]
    pages += [(200, "flower1"), (201, "zzkk1"), (202, "ftp://q.org/x?topic=flower"), (203, "ftp://q.org/x?spam=zzkk"), (204, "ftp://Q.org/x?spam=zzkk")]
    got = {r.page_id: r for r in urls.url_table(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert len(got) == len(pages)
    assert got[200].score > got[201].score and got[202].score > got[203].score
    assert got[203].score == got[204].score
    assert (got[202].host, got[202].path, got[200].host, got[200].path) == ("q.org", "/x", "", "")


def test_models_against_plain_counts(spark):
    accepted, rejected, other = ["abab", "abba", "aab"] * 3, ["bcbc", "ccb"] * 2, ["abc", "zz", ""]
    rows = [(u, accepted.count(u), rejected.count(u)) for u in sorted({*accepted, *rejected, *other})]
    got = {r.gram: r.ratio for r in urls.log_ratios(spark.createDataFrame(rows, "url string, accepted long, rejected long")).collect()}

    def p(training, gram):
        out = 1 / urls.ALPHABET
        grams = [("\x01" * 4 + u + "\x02")[i : i + 5] for u in training for i in range(len(u) + 1)]
        for order in range(1, 6):
            context, after = gram[5 - order : 4], {}
            for g in grams:
                if g[5 - order : 4] == context:
                    after[g[4]] = after.get(g[4], 0) + 1
            if after:
                out = (after.get(gram[4], 0) + len(after) * out) / (sum(after.values()) + len(after))
        return out

    for gram, ratio in got.items():
        assert abs(ratio / urls.UNIT - np.log(p(accepted, gram) / p(rejected, gram))) < 1e-5


def test_threshold_parts_the_classes(spark):
    rows = [(-1.0, 0, 5), (-0.5, 1, 9), (0.3, 8, 1), (0.9, 7, 0)]
    scored = spark.createDataFrame(rows, "score double, accepted long, rejected long")
    assert -0.5 < urls.threshold(scored) <= 0.3
    assert urls.threshold(scored.where("rejected = 0")) == 0.0
