from __future__ import annotations

import hashlib

import pytest

from replyloom.operators import pairing
from replyloom.sources import schemas
from pyspark.sql.types import LongType, StructField, StructType

SCHEMA = StructType([*schemas.MESSAGES.fields, StructField("src_ord", LongType())])


@pytest.fixture(scope="module")
def messages(spark):
    data = [
        # tweet_id, author, inbound, response ids, parent, text
        (1, "ann", True, None, None, " help\xa0"),
        (2, "BrandCo", False, None, "1", "sure "),
        (3, "brandco", False, None, "1", "again"),
        (2, "BrandCo", False, None, "1", "duplicate id"),
        (4, "brandco", False, None, "999", "unknown parent"),
        (5, "brandco", False, None, None, "no parent"),
        (6, "brandco", False, None, "3", "answers itself"),
        (7, "bob", True, None, None, "first copy"),
        (7, "bob", True, None, None, "last copy"),
        (8, "brandco", False, None, "7", "to bob"),
        (9, "eve", True, None, None, " \n"),
        (10, "brandco", False, None, "9", "to a blank"),
        (11, "brandco", False, None, "7", None),
        (12, None, None, None, "7", "nobody"),
        (13, "other", False, None, "7", "other account"),
        (14, "zed", True, None, None, "waiting"),
    ]
    return spark.createDataFrame([(*m[:6], "t", i) for i, m in enumerate(data)], SCHEMA)


def test_reply_pairs(messages):
    got = {
        (r.customer_tweet_id, r.brand_tweet_id): (r.customer_text, r.brand_response, r.customer_author_id)
        for r in pairing.reply_pairs(messages, "BRANDCO").collect()
    }
    assert got == {
        ("1", "2"): ("help", "sure", "ann"),
        ("1", "3"): ("help", "again", "ann"),
        ("3", "6"): ("again", "answers itself", "brandco"),
        ("7", "8"): ("last copy", "to bob", "bob"),
    }


def test_inbound_parent_option(messages):
    rows = pairing.reply_pairs(messages, "brandco", require_inbound_parent=True).collect()
    assert ("3", "6") not in {(r.customer_tweet_id, r.brand_tweet_id) for r in rows}
    assert len(rows) == 3


def test_pair_columns(messages):
    pairs = pairing.reply_pairs(messages, "brandco")
    assert pairs.columns == [*schemas.PAIRS.names, "src_ord"]


def test_summary(messages):
    counts, top = pairing.account_summary(messages, 2)
    assert tuple(counts.first()) == (16, 5, 10)
    assert [tuple(r) for r in top.collect()] == [(1, "brandco", 7), (2, "BrandCo", 2)]


def test_pair_counts(messages):
    got = {r.stage: r.n for r in pairing.pair_counts(messages, "brandco").collect()}
    assert got == {"messages": 16, "brand_messages": 9, "brand_ids": 8, "parent_ids": 5, "pairs": 4}


def test_parents_and_waiting(messages):
    assert sorted({r.tweet_id for r in pairing.parent_messages(messages, "brandco").collect()}) == [1, 3, 7, 9]
    assert [r.tweet_id for r in pairing.unanswered_messages(messages, "brandco").collect()] == [14]


def _with_one_hot_parent(spark):
    """Half of all replies answer one message; two of its copies have different texts."""
    rows = [(1, "ann", True, None, None, "first"), (1, "ann", True, None, None, "hot")]
    rows += [(i, "zoe", True, None, None, f"question {i}") for i in range(2, 200)]
    rows += [(1000 + i, "BrandCo", False, None, "1", f"answer {i}") for i in range(200)]
    rows += [(2000 + i, "brandco", False, None, str(i), f"answer to {i}") for i in range(2, 200)]
    return spark.createDataFrame([(*m, "t", i) for i, m in enumerate(rows)], SCHEMA).repartition(6)


def test_hot_parents_join_apart(spark, monkeypatch):
    messages = _with_one_hot_parent(spark)
    want = sorted(map(tuple, pairing.reply_pairs(messages, "brandco").collect()))
    assert len(want) == 398 and {r[6] for r in want if r[0] == "1"} == {"hot"}
    monkeypatch.setattr(pairing, "HOT_REPLIES", 50)
    got = pairing.reply_pairs(messages, "brandco")
    assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and "strategy=broadcast" in plan


def test_sketch_names_the_hot_parent(spark, monkeypatch):
    replies = spark.createDataFrame([("7",)] * 300 + [(str(i),) for i in range(300)], "customer_tweet_id string")
    for bound, hot in ((1_000, []), (100, ["7"])):
        monkeypatch.setattr(pairing, "HOT_REPLIES", bound)
        stored, found = pairing._with_hot_parents(replies.repartition(5))
        assert found == hot and stored.count() == 600


def test_messages_are_scanned_twice(spark, tmp_path):
    path = str(tmp_path / "messages")
    _with_one_hot_parent(spark).write.parquet(path)
    plan = pairing.reply_pairs(spark.read.parquet(path), "brandco")._jdf.queryExecution().optimizedPlan().toString()
    # The scan for the replies has already run; what is left reads messages once.
    assert plan.count("tweet_id#") > 0 and plan.count("response_tweet_id") <= plan.count("Relation [")
    leaves = [line for line in plan.splitlines() if "Relation [" in line and "author_id" in line and "inbound" in line]
    assert len(leaves) == 1


def test_extraction_guards_and_publishes(spark, messages, tmp_path):
    root = str(tmp_path / "pairs")
    assert pairing.extract_pairs(messages, "brandco", root) == 4
    want = sorted(map(tuple, pairing.read_pairs(spark, root).collect()))
    assert want == sorted(map(tuple, pairing.reply_pairs(messages, "brandco").collect()))
    with pytest.raises(RuntimeError, match="no pairs of nobody"):
        pairing.extract_pairs(messages, "nobody", root)
    assert sorted(map(tuple, pairing.read_pairs(spark, root).collect())) == want


def test_digests_of_pairs_need_no_texts(spark, messages, tmp_path):
    path = str(tmp_path / "messages")
    messages.write.parquet(path)
    pairs = pairing.reply_pairs(spark.read.parquet(path), "brandco", digest=True)
    assert {r.customer_text: r.customer_digest for r in pairs.collect()} == {
        t: hashlib.md5(t.encode()).hexdigest() for t in ("help", "last copy", "again")
    }
    plan = pairs.select("src_ord", "customer_digest")._jdf.queryExecution().optimizedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Window" in line or "Join" in line]
    assert shuffled and not any("text#" in line for line in shuffled)
    assert any("LeftSemi" in line and "strategy=broadcast" in line for line in shuffled)
    assert "AS customer_text#" not in plan and "AS customer_digest#" in plan


def test_waiting_messages_stay_where_they_are(messages):
    left = pairing.unanswered_messages(messages, "brandco")
    assert "hashpartitioning" not in left._jdf.queryExecution().executedPlan().toString()
