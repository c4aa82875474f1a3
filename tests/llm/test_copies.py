from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from replyloom.llm import components, contamination, induced, lines, simhash, suffix_dedup
from tests.llm import brute


def test_components(spark):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(0, 60) if i % 13] + [(rng.randrange(60), rng.randrange(60)) for _ in range(5)] + [(99, 99)]
    both = {frozenset(p) for p in pairs}
    want = brute.components({x for p in pairs for x in p}, lambda a, b: frozenset((a, b)) in both)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {n: r for n, r in want.items() if n != r}


def test_simhash_against_all_pairs(documents, odd):
    for docs in (documents, odd.where("doc_id is not null")):
        texts = {r.doc_id: r.text for r in docs.collect()}
        prints = {i: brute.fingerprint(t) for i, t in texts.items()}
        want = brute.components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
        for r in simhash.simhash_table(docs).collect():
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])


@pytest.mark.parametrize("leaves", [1, 7, 40])
def test_tree_meets_every_pair(leaves):
    rng = np.random.default_rng(leaves)
    seeds = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (60, 25), dtype=np.uint64)
    values = np.unique(np.concatenate([seeds, (seeds[:, None] ^ flips).ravel(), (seeds[:, None] ^ flips ^ flips[:, ::-1]).ravel()]))
    nodes = simhash.build_tree(values, leaves)
    leaf, at, home = simhash.route(nodes, values)
    assert sorted(at[home]) == list(range(len(values)))
    parent = np.arange(len(values))
    for k in np.unique(leaf):
        part, mine = at[leaf == k], home[leaf == k]
        root = simhash.link_members(values[part], mine)
        simhash._merge(parent, part, part[root])
    got = simhash._find(parent, parent.copy())
    want = np.arange(len(values))
    i, j = np.nonzero(np.bitwise_count(values[:, None] ^ values[None, :]) <= 2)
    simhash._merge(want, i, j)
    assert np.array_equal(got, simhash._find(want, want.copy()))


def test_keep_one(documents, clashing, empty):
    table = simhash.simhash_table(documents).collect()
    kept = {r.doc_id for r in simhash.keep_one(documents).collect()}
    assert kept == {r.component_id for r in table}
    got = simhash.keep_one(clashing)
    assert got.columns == clashing.columns
    ids = Counter(r.doc_id for r in got.collect())
    assert max(ids.values()) == 1 and 5 in ids and 6 not in ids and 7 not in ids
    assert simhash.keep_one(empty).count() == 0


def test_contamination_against_scan(spark, documents, odd):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    extra = spark.createDataFrame([(900, "one two"), (901, None), (902, "..."), (None, "word1 word2")], "item_id long, text string")
    items = items.select("item_id", "text").union(extra)
    for docs in (documents, odd.where("doc_id is not null")):
        known = [(r.item_id, r.text) for r in items.collect()]
        want = brute.contamination([(r.doc_id, r.text) for r in docs.collect()], known)
        got = {r.doc_id: tuple(r)[1:] for r in contamination.contamination_table(docs, items).collect()}
        assert got == want


def test_blocks_and_segments_do_not_matter(spark, documents):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    whole = contamination.search(contamination.build_index(documents), items)
    cut = contamination.search(contamination.build_index(documents, segment_tokens=300), items, block_bytes=500)
    row = lambda r: (r.doc_id, r.n_words, tuple(r.item_ids))
    assert sorted(map(row, whole.collect())) == sorted(map(row, cut.collect()))
    hits = lambda df: {r.doc_id: r.n for r in df.select("doc_id", contamination._covered(df["spans"]).alias("n")).collect()}
    assert hits(whole) == hits(cut)


def test_blocks_keep_repeated_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, ""), (1, "a b c"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "a b"), (2, "c")], "item_id long, text string")
    index = contamination.build_index(docs, segment_tokens=2)
    row = lambda r: (r.doc_id is None, r.n_words, tuple(r.item_ids))
    whole, cut = contamination.search(index, items), contamination.search(index, items, block_bytes=1)
    assert whole.columns == cut.columns and whole.count() == len(rows)
    assert sorted(map(row, cut.collect())) == sorted(map(row, whole.collect()))


def test_items_without_id_hit_words(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "alpha beta"), (5, "gamma")], "item_id long, text string")
    got = {r.doc_id: r for r in contamination.contamination_table(docs, items).collect()}
    assert (got[1].n_hit, got[1].n_items, got[1].contaminated) == (3, 1, True) and got[2].n_hit == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red green blue"), (2, "red very green blue"), (3, "blue then red and some green")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    index = contamination.build_index(docs)
    near = lambda s: {r.doc_id for r in contamination.search(index, items, slop=s).collect() if r.item_ids}
    assert near(0) == {1} and near(1) == {1, 2} and 3 not in near(1)


def test_drop_contaminated(spark, clashing, empty):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    got = contamination.drop_contaminated(clashing, items)
    assert got.columns == clashing.columns and got.count() == clashing.count() - 1
    assert contamination.drop_contaminated(empty, items).count() == 0
    assert contamination.drop_contaminated(clashing, items.limit(0)).count() == clashing.count()


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for t in range(150):
        n, k = int(rng.integers(1, 60)), int(rng.integers(1, 5))
        s = rng.integers(0, k, n).astype(np.int32)
        if t % 3 == 0:
            s = np.tile(s, 4)
        sa, text = induced.suffix_array(s, k), s.tolist()
        assert sa.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        shared = induced.common_prefixes(s, sa, 7)
        for i in range(1, len(text)):
            a, b, n = text[sa[i] :], text[sa[i - 1] :], 0
            while n < min(len(a), len(b), 7) and a[n] == b[n]:
                n += 1
            assert shared[i] == n


def test_suffix_arrays_with_many_symbols():
    rng = np.random.default_rng(1)
    s = np.tile(rng.integers(0, 256, 30_000), 2).astype(np.int32)
    sa = induced.suffix_array(s, 256)
    data = s.astype(np.uint8).tobytes()
    assert sorted(sa.tolist()) == list(range(len(s)))
    assert all(data[a : a + 40_000] <= data[b : b + 40_000] for a, b in zip(sa[:2000], sa[1:2001]))


@pytest.mark.parametrize("hot", [20_000, 5])
def test_repeats_against_all_strings(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randint(60, 400))) for _ in range(15)]
    piece = lambda: rng.choice([rng.choice(base), rng.choice(base)[rng.randint(0, 50) :], "x" * rng.randint(0, 20)])
    rows = [(i, "".join(piece() for _ in range(rng.randint(0, 6)))) for i in range(90)]
    rows += [(200, "a" * 1000), (201, "a" * 150), (202, "ab" * 300), (203, None), (204, "")]
    rows += [(205, "q" * 100), (206, "q" * 100), (207, "q" * 99), (208, "ab" * 90_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.suffix_table(docs).collect()}
    assert got == brute.repeats(rows)


def test_repeats_edges(odd, empty):
    rows = suffix_dedup.suffix_table(odd).collect()
    assert len(rows) == odd.count()
    assert sorted(r.n_removed for r in rows if r.doc_id == 7)[0] > 0
    assert suffix_dedup.suffix_table(empty).count() == 0


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(1500):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k, kind = rng.randint(0, len(b)), rng.random()
            if kind < 0.4:
                b.insert(k, rng.choice("ab"))
            elif b and kind < 0.7:
                b.pop(k % len(b))
            elif b:
                b[k % len(b)] = rng.choice("ab")
        b = "".join(b)
        assert lines.near(a, b) == lines.within(a, b) == (brute.edits(a, b) <= 2)


def test_lines_against_all_pairs(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(12, 40))) for _ in range(40)]

    def edited():
        x = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            k, kind = rng.randrange(len(x)), rng.random()
            if kind < 0.3:
                x.insert(k, "z")
            elif kind < 0.6:
                x.pop(k)
            else:
                x[k] = "y"
        return "".join(x)

    rows = [(i, "\n".join(edited() for _ in range(4))) for i in range(60)] + [(100, None), (101, ""), (102, " \n \n")]
    at = defaultdict(list)
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            if line.strip():
                at[line].append((i, k))
    linked = lambda a, b: min(len(a), len(b)) >= lines.MIN_CHARS and abs(len(a) - len(b)) <= 2 and brute.edits(a, b) <= 2
    roots = brute.components(at, linked)
    first = defaultdict(list)
    for line, places in at.items():
        first[roots[line]] += places
    want = {}
    for line, places in at.items():
        n = sum(linked(line, other) for other in at if other != line)
        want.update({p: (*min(first[roots[line]]), n) for p in places})
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.place): (r.class_doc_id, r.class_place, r.n_links) for r in lines.line_classes(docs).collect()}
    assert got == want
    left = lines.drop_repeated_lines(docs).collect()
    assert len(left) == len(rows)


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_kept_texts_meet_every_short_pair(tau):
    rng = random.Random(tau)
    texts = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(300)})
    for a in texts:
        for b in texts:
            if len(a) <= len(b) and brute.edits(a, b) <= tau:
                assert lines.kept_texts(a, True, tau) & lines.kept_texts(b, False, tau)


def test_short_lines_against_all_pairs(spark):
    rng = random.Random(5)
    texts = {"".join(rng.choice("abc.é") for _ in range(rng.randint(1, 7))) for _ in range(60)}
    for n in range(8, 20):
        base = "".join(rng.choice("abcdefgh ") for _ in range(n))
        texts |= {base, base[1:], base[:-2], base[:3] + "X" + base[4:], "Y" + base, base[:2] + base[3:] + "Z"}
    texts = sorted(x for x in texts if x.strip())
    linked = lambda a, b: brute.edits(a, b) <= 2
    want = {frozenset((a, b)) for i, a in enumerate(texts) for b in texts[:i] if linked(a, b)}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    known = {r.key: r.line for r in lines.lines_of(docs).collect()}
    got = [frozenset((known[r.u], known[r.v])) for r in lines.links(lines.lines_of(docs)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(len(p) == 2 and min(map(len, p)) == 15 and max(map(len, p)) > 15 for p in want)
    degree = Counter(x for p in want for x in p)
    assert {r.doc_id: r.n_links for r in lines.line_classes(docs).collect()} == {i: degree[t] for i, t in enumerate(texts)}


def test_repeated_lines_go_by_row(spark):
    rows = [
        (0, "a common line of words here\nx", "a"),
        (1, "a common line of words here\nfoo is another line", "b"),
        (1, "totally different opening words zz\nfoo is another line", "c"),
        (None, "one more line that stands alone\nq", "d"),
        (None, "a common line of words here\n\nfoo is another line!", "e"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place string").coalesce(1)
    got = lines.drop_repeated_lines(docs)
    assert got.columns == docs.columns
    texts = {r.place: (r.doc_id, r.text) for r in got.collect()}
    # Null ids come first, so rows d and e keep what they share with later ones (x is near q).
    assert texts["d"] == (None, "one more line that stands alone\nq")
    assert texts["e"] == (None, "a common line of words here\n\nfoo is another line!")
    assert texts["a"] == (0, "") and texts["b"] == (1, "") and texts["c"] == (1, "totally different opening words zz")


def test_lines_edges(odd, clashing, empty):
    assert lines.line_classes(clashing).count() == lines.line_classes(odd).count()
    assert lines.line_classes(empty).count() == 0


def test_segments_meet_as_their_texts_do():
    """Equal substrings of one partner and segment share a token, however lines are cut into batches; others do not."""
    rng = random.Random(5)
    texts = sorted({"".join(rng.choice("abé\U0001d538 ") for _ in range(rng.randint(16, 24))) for _ in range(200)})
    hashes = np.arange(len(texts), dtype=np.int64)
    named = lambda some, at: lines.segment_tokens(pa.array(some, pa.string()), hashes[at : at + len(some)], lines._Plans(2))
    whole = named(texts, 0)
    halves = [np.concatenate(x) for x in zip(named(texts[:90], 0), named(texts[90:], 90))]
    assert all((a == b).all() for a, b in zip(whole, halves))
    want = []
    for t in texts:
        want += [(other, i, t[at : at + size], other == len(t) and at == lines.segments(other)[i][0]) for other, i, at, size in lines.probes(len(t)) if other >= lines.SHORT]
    assert len(want) == len(whole[0]) and [own for *_, own in want] == (whole[2] == lines.OWN).tolist()
    assert len({(*w[:3], t) for w, t in zip(want, whole[0])}) == len({w[:3] for w in want}) == len(set(whole[0]))


def test_lines_of_one_length_meet_in_one_direction(spark):
    """The join makes no more than one row per segment that a pair shares."""
    base = "a line of thirty-six characters here"
    texts = [base[:i] + "#" + base[i + 1 :] for i in range(2, 8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    dealt = lines._tokens(lines.lines_of(docs), 2)
    assert dealt.where(f"kind = {lines.OWN}").count() == 6 * 3
    assert lines.candidates(lines.lines_of(docs)).count() == 15
    assert {r.n_links for r in lines.line_classes(docs).collect()} == {5}
