from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from replyloom.llm import mixing, quality_rules, sharding
from tests.llm import brute


def test_base_columns(spark, documents, odd):
    for docs in (documents, odd.where("doc_id is not null")):
        got = {r.doc_id: tuple(r)[1:6] for r in quality_rules.rule_table(docs).collect()}
        assert got == {r.doc_id: brute.quality_base(r.text) for r in docs.collect()}


def test_many_repeats_and_few_agree(spark):
    text = " ".join(f"a{i % 40} b{i % 40} c{i % 40}" for i in range(100))
    docs = spark.createDataFrame([(1, text), (2, "x y z q x y z"), (3, "a a a a")], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:6] for r in quality_rules.rule_table(docs).collect()}
    assert got == {r.doc_id: brute.quality_base(r.text) for r in docs.collect()}


def test_order_is_by_rejections_per_second():
    rows = [
        {"rule": "dear", "seconds": 1.0, "share": 0.5},
        {"rule": "cheap", "seconds": 0.1, "share": 0.2},
        {"rule": "idle", "seconds": 0.1, "share": 0.0},
    ]
    assert quality_rules.order_rules(rows) == ["cheap", "dear", "idle"]


def test_order_does_not_change_what_is_kept(documents):
    names = [r.name for r in quality_rules.RULES]
    some = [{r.doc_id for r in quality_rules.keep_good(documents, n).collect()} for n in (names, names[::-1])]
    table = {r.doc_id for r in quality_rules.rule_table(documents).where("kept").collect()}
    assert some[0] == some[1] == table and 0 < len(table) < documents.count()


def test_rules_keep_columns(clashing, empty):
    kept = quality_rules.keep_good(clashing)
    assert kept.columns == clashing.columns
    assert {r.doc_id for r in kept.collect()} <= {None, 4, 5, 6, 7, 8}
    assert quality_rules.keep_good(empty).count() == 0
    assert quality_rules.rule_table(empty).count() == 0


def test_mix_comes_near_targets(documents):
    rows = mixing.mix_table(documents).collect()
    sources = {r.doc_id: r.source for r in documents.collect()}
    taken, size, target, largest = Counter(), Counter(), {}, Counter()
    for r in rows:
        s = sources[r.doc_id]
        taken[s] += r.taken
        size[s] += r["size"]
        target[s] = r.target
        largest[s] = max(largest[s], r["size"])
        assert r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
    assert abs(sum(target.values()) - sum(size.values())) < 1e-3
    assert all(target[s] <= 3 * size[s] + 1e-9 and abs(taken[s] - target[s]) <= largest[s] for s in size)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix_table(documents.repartition(5)).collect()))


def test_mix_caps_a_small_source(spark):
    docs = spark.createDataFrame(
        [(i, "w " * (2 if s == "c" else 50), s) for i, s in enumerate("aaaabbbbcc")], "doc_id long, text string, source string"
    )
    rows = mixing.mix_table(docs).collect()
    assert {r.target for r in rows if r["size"] == 2} == {12.0}
    assert sum({r.source_size: r.target for r in rows if r["size"] == 50}.values()) <= 392


def test_mix_edges(clashing, empty, odd):
    mixed = mixing.mix(clashing)
    assert mixed.columns == clashing.columns
    table = mixing.mix_table(odd)
    assert table.count() == odd.count()
    assert mixed.count() == table.agg(F.sum("copies")).first()[0]
    assert mixing.mix_table(empty).count() == 0 and mixing.mix(empty).count() == 0


def _check_shards(rows, n):
    slots, homes = {}, {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        assert homes.setdefault(r.text_crc32, r.shard) == r.shard
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert all(0 <= s < n for s in slots)


def test_shards_are_even(spark):
    docs = spark.createDataFrame(
        [(i, f"{i} " + "x" * (i * 37 % 211), "en" if i % 3 else "de", f"s{i % 5}") for i in range(3000)],
        "doc_id long, text string, lang string, source string",
    )
    rows = sharding.shard_table(docs).collect()
    _check_shards(rows, 16)
    size = Counter()
    for r in rows:
        size[r.shard] += r["size"]
    assert len(size) == 16 and max(size.values()) - min(size.values()) < 1500
    assert sum(size.values()) == sum(len(r.text.encode()) + 1 for r in docs.collect())


def test_sources_with_one_beginning_are_told_apart(spark):
    """Equal sizes and one language: the tree can only cut along the source, at its values."""
    docs = spark.createDataFrame(
        [(i, f"{i:05d}" + "x" * 95, "en", f"source_{i % 4}") for i in range(400)], "doc_id long, text string, lang string, source string"
    )
    homes = {}
    for r in sharding.with_shards(docs, 4).collect():
        homes.setdefault(r.source, set()).add(r.shard)
    assert all(len(v) == 1 for v in homes.values()) and len(set.union(*homes.values())) == 4


def test_shards_of_a_plain_tree(spark):
    """The same cuts as a tree over lists: widest dimension, weighted median, nearer side."""
    docs = spark.createDataFrame(
        [(i, f"{i} " + "y" * (i * 53 % 97), ["de", "en"][i % 2], f"s{i % 3}") for i in range(120)],
        "doc_id long, text string, lang string, source string",
    )
    import hashlib
    import math

    ranks = [{v: k + 1 for k, v in enumerate(sorted({r[c] for r in docs.collect()}))} for c in ("lang", "source")]
    groups = []
    for r in docs.collect():
        digest, size = hashlib.md5(r.text.encode()).hexdigest(), len(r.text.encode()) + 1
        at = (ranks[0][r.lang], ranks[1][r.source], math.floor(math.log2(size) * (1 << 40)))
        groups.append((at, int(digest[:12], 16), size, r.doc_id))
    whole = [max(g[0][i] for g in groups) - min(g[0][i] for g in groups) or 1 for i in range(3)]
    want = {}

    def cut(rows, first, k):
        if k == 1:
            want.update({r[3]: first for r in rows})
            return
        wide = [(max(r[0][i] for r in rows) - min(r[0][i] for r in rows)) / whole[i] for i in range(3)]
        i = max(range(3), key=lambda d: (wide[d], -d))
        rows = sorted(rows, key=lambda r: (r[0][i], r[1]))
        share, held, n = sum(r[2] for r in rows) * (k // 2) / k, 0, 0
        while held + rows[n][2] < share:
            held, n = held + rows[n][2], n + 1
        n += 2 * (share - held) >= rows[n][2]
        cut(rows[:n], first, k // 2)
        cut(rows[n:], first + k // 2, k - k // 2)

    cut(groups, 0, 6)
    assert {r.doc_id: r.shard for r in sharding.with_shards(docs, 6).collect()} == want


def test_given_shard_columns_are_replaced(clashing, tmp_path):
    out = sharding.with_shards(clashing, 4)
    assert out.columns == [c for c in clashing.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    sharding.write_shards(clashing, str(tmp_path / "out"), 4)
    back = clashing.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == clashing.count() and {r.shard for r in back.select("shard").collect()} <= {0, 1, 2, 3}


def test_shard_edges(clashing, odd, empty, tmp_path):
    _check_shards(sharding.shard_table(odd).collect(), 16)
    assert sharding.shard_table(odd).count() == odd.count()
    assert sharding.shard(clashing).select("__row.*").columns == clashing.columns
    assert sharding.shard_table(empty).count() == 0
    assert {r.shard for r in sharding.shard(odd, 3).collect()} <= {0, 1, 2}
    sharding.write_shards(odd, str(tmp_path / "out"), 4)
    assert odd.sparkSession.read.parquet(str(tmp_path / "out")).count() == odd.count()
