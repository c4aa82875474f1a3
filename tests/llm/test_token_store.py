from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from replyloom.llm import token_store


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path(token_store.VOCABULARY))


def _want(tokenizer, rows):
    out, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def _ids(encoder, texts):
    tokens, sizes = encoder.encode(pa.array(texts, pa.string()), 2)
    return [part.tolist() for part in np.split(tokens, np.cumsum(sizes)[:-1])]


def _rows(table):
    return sorted((tuple(r) for r in table.select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])


def test_pieces_give_the_same_ids(tokenizer):
    texts = [
        "", " ", "a", " a b", "a  b", "a \n b", "x\t y", "tail ", "  lead", "don't we'll", "é ü ñandú", "汉字 文本", "a b c  d",
        "1 22 333 a1", "a\x1c b", "<|endoftext|> b <|endoftext|>", "word" * 40 + " end", "😀 😀😀", "\n\n", "a.\r\n b", "é x",
    ]
    encoder = token_store.PieceEncoder(public_tokenizers.path(token_store.VOCABULARY))
    for _ in range(2):
        assert _ids(encoder, texts) == [tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts]


def test_memo_turns_over(tokenizer, monkeypatch):
    monkeypatch.setattr(token_store, "MEMO_WORDS", 20)
    encoder = token_store.PieceEncoder(public_tokenizers.path(token_store.VOCABULARY))
    for k in range(30):
        text = " ".join(f"w{(k * j) % 50} common" for j in range(12))
        assert _ids(encoder, [text]) == [tokenizer.encode(text).ids + [2]]
    assert len(encoder.young) + len(encoder.old) < 120


def test_store_against_the_tokenizer(tokenizer, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert _rows(token_store.token_table(documents.repartition(4))) == _want(tokenizer, rows)


def test_odd_documents(tokenizer, odd, clashing, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got, want = _rows(token_store.token_table(odd)), _want(tokenizer, rows)
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sorted(map(str, [(r[0], *r[2:]) for r in got])) == sorted(map(str, [(r[0], *r[2:]) for r in want]))
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got[:-1]]).tolist()
    assert sorted(map(str, _rows(token_store.token_table(clashing)))) == sorted(map(str, got))
    assert token_store.token_table(empty).count() == 0


def test_one_id_on_most_rows(spark, tokenizer):
    docs = spark.createDataFrame([(7, f"row {i}") for i in range(300)] + [(i, "x") for i in range(20)], "doc_id long, text string")
    got = _rows(token_store.token_table(docs))
    assert [r[0] for r in got] == sorted([7] * 300 + list(range(20)))
    assert sum(r[2] for r in got) == sum(r[2] for r in _want(tokenizer, [tuple(r) for r in docs.collect()]))


def test_lookup_and_spans(spark, tokenizer, documents, tmp_path):
    path = f"{tmp_path}/store"
    token_store.write_tokens(documents, path, part_bytes=1 << 20)
    rows = {r.doc_id: r for r in token_store.read_tokens(spark, path).collect()}
    all_ids = np.concatenate([rows[i].ids for i in sorted(rows)])
    some = sorted(rows)[3::50]
    assert {r.doc_id: (r.start, r.ids) for r in token_store.read_tokens(spark, path, some).collect()} == {i: (rows[i].start, rows[i].ids) for i in some}
    for first, stop in ((0, 10), (1000, 5000), (len(all_ids) - 3, len(all_ids) + 9), (len(all_ids), len(all_ids) + 1)):
        found = sorted(token_store.read_span(spark, path, first, stop).collect(), key=lambda r: r.start)
        assert [x for r in found for x in r.ids] == all_ids[first:stop].tolist()
        assert not found or found[0].start == first


def _scanned(df):
    """Rows that the scan of ``df`` handed on, after the files' own indexes."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().executedPlan().executeCollect()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_indexes_prune_and_stripes_split(spark, documents, tmp_path):
    many = documents.select("doc_id", F.substring("text", 1, 40).alias("text")).crossJoin(spark.range(600).withColumnRenamed("id", "k"))
    many = many.select((F.col("doc_id") * 1000 + F.col("k")).alias("doc_id"), "text").coalesce(1)
    path = f"{tmp_path}/store"
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        token_store.write_tokens(many, path, stripe_bytes=64 << 10, index_rows=1000)
        read = spark.read.schema(token_store._layout(many.schema["doc_id"].dataType)).orc(f"{path}/ids")
        total = many.count()
        one = read.where(F.col("doc_id") == many.orderBy("doc_id").first().doc_id)
        assert _scanned(one.select("doc_id")) <= 1000 < total
        absent = read.where(F.col("doc_id") == 750)  # between the least and the greatest id of its row group
        assert _scanned(absent.select("doc_id")) == 0
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        files = [r.f for r in read.select(F.input_file_name().alias("f")).distinct().collect()]
        options = jvm.org.apache.orc.OrcFile.readerOptions(conf)
        stripes = [jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f), options).getStripes().size() for f in files]
        assert max(stripes) > 1
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
        again = spark.read.schema(read.schema).orc(f"{path}/ids")
        assert again.rdd.getNumPartitions() > len(files) and again.count() == total
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.adaptive.enabled")
