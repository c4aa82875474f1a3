"""SimHash near-duplicates found with vantage-point trees.

A fingerprint has a bit for each bit that most shingle hashes of a text set. Distinct
fingerprints are dealt to the leaves of a vantage-point tree: a node holds a fingerprint and a
radius and sends each other one inside or outside by its Hamming distance. A fingerprint that
lies outside by no more than the link distance also visits the inside, since by the triangle
inequality only such a one can link to a fingerprint there. Each leaf goes on with a tree of
its own and prunes branches by the same bounds; all links of up to the distance are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replyloom.llm.common import carry_along, text_of
from replyloom.llm.components import components
from replyloom.session import checkpoint

carry_along(__name__)

SHINGLE, SEED, DISTANCE = 3, 42, 2
# Distinct fingerprints per leaf aimed at, and sampled ones per leaf to place its boundary.
LEAF_ROWS, SAMPLE_PER_LEAF = 50_000, 64
MIN_LEAVES, MAX_LEAVES = 32, 16_384
# Below so many members a leaf's own tree compares all.
SMALL = 256
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit fingerprint; zero for a text without words."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return 0
    if len(w) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(b" ".join(s), SEED) for s in zip(w, w[1:], w[2:])), np.uint64, len(w) - 2)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    made = np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts))
    return pd.Series(made.view(np.int64))


def as_hex(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def _radius(d: np.ndarray, r: int) -> int | None:
    """The radius with the fewest visitors among those that leave each side a quarter at least."""
    counts = np.bincount(d, minlength=65 + r)
    inside = np.cumsum(counts)
    fair = [m for m in range(65) if 4 * inside[m] >= len(d) and 4 * inside[m] <= 3 * len(d)]
    if not fair:
        fair = [m for m in range(65) if 0 < inside[m] < len(d)]
    return min(fair, key=lambda m: (counts[m + 1 : m + 1 + r].sum(), abs(2 * inside[m] - len(d)))) if fair else None


def _distance(values: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(values ^ to)


def build_tree(sample: np.ndarray, leaves: int, r: int = DISTANCE) -> list[tuple]:
    """Nodes (vantage point, radius, inside, outside); a negative child -k - 1 is leaf k."""
    nodes: list[tuple] = []
    made = 0

    def grow(part: np.ndarray, want: int) -> int:
        nonlocal made
        radius = None
        if want > 1 and len(part) > 3:
            point = part[len(part) // 2]
            d = _distance(part, point)
            radius = _radius(d, r)
        if radius is None:
            made += 1
            return -made
        at = len(nodes)
        nodes.append(())
        close = d <= radius
        first = min(max(round(want * close.sum() / len(part)), 1), want - 1)
        nodes[at] = (point, radius, grow(part[close], first), grow(part[~close], want - first))
        return at

    root = grow(sample, leaves)
    return nodes if root >= 0 else []


def route(nodes: list[tuple], values: np.ndarray, r: int = DISTANCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leaf, place in ``values``, home) for the home of each value and each leaf that it visits."""
    out: list[tuple] = []
    todo = [(0 if nodes else -1, np.arange(len(values)), np.ones(len(values), bool))]
    while todo:
        node, at, home = todo.pop()
        if not len(at):
            continue
        if node < 0:
            out.append((np.full(len(at), -node - 1), at, home))
            continue
        point, radius, inside, outside = nodes[node]
        d = _distance(values[at], point).astype(np.int64)
        # Inside: what lies there; from outside what is near enough, as a visitor.
        go = (d <= radius) | (d <= radius + r)
        todo.append((inside, at[go], (home & (d <= radius))[go]))
        # Outside: what lies there; a visitor of this node goes on to both sides.
        go = np.where(home, d > radius, d >= radius + 1 - r)
        todo.append((outside, at[go], home[go]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if np.array_equal(up, x):
            return x
        x = parent[up]


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while True:
        ra, rb = _find(parent, a), _find(parent, b)
        apart = ra != rb
        if not apart.any():
            return
        np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])


def link_members(values: np.ndarray, home: np.ndarray, r: int = DISTANCE) -> np.ndarray:
    """For each value the place of the least one that it is linked to, over one or more links.

    Each link between two members at home, or one at home and a visitor, is found.
    """
    parent = np.arange(len(values))
    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while todo:
        inner, guests = todo.pop()
        if not len(inner):
            continue
        radius = None
        if len(inner) > SMALL:
            point = values[inner[len(inner) // 2]]
            d = _distance(values[inner], point).astype(np.int64)
            radius = _radius(d, r)
        if radius is None:
            everyone = np.concatenate([inner, guests])
            step = max(1, (1 << 20) // len(inner))
            for at in range(0, len(everyone), step):
                part = everyone[at : at + step]
                i, j = np.nonzero(np.bitwise_count(values[inner][:, None] ^ values[part][None, :]) <= r)
                _merge(parent, inner[i], part[j])
            continue
        e = _distance(values[guests], point).astype(np.int64)
        near = (d > radius) & (d <= radius + r)
        todo.append((inner[d <= radius], np.concatenate([inner[near], guests[e <= radius + r]])))
        todo.append((inner[d > radius], guests[e >= radius + 1 - r]))
    return _find(parent, parent.copy())


def links(prints: DataFrame, r: int = DISTANCE) -> DataFrame:
    """Links (u, v) that join all distinct fingerprints at distance ``r`` or less.

    ``prints`` is a materialised table of distinct ``fingerprint``. Within a leaf a class is
    given as a star, so no list of all pairs arises; classes that span leaves share a member.
    """
    total = prints.count()
    leaves = int(min(max(MIN_LEAVES, total // LEAF_ROWS), MAX_LEAVES))
    share = min(1.0, leaves * SAMPLE_PER_LEAF / max(total, 1))
    drawn = prints.select("fingerprint").sample(share, seed=1).limit(2 * leaves * SAMPLE_PER_LEAF)
    sample = np.array(sorted(x[0] for x in drawn.collect()), np.int64).view(np.uint64)
    nodes = build_tree(np.random.default_rng(5).permutation(sample), leaves, r)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch["fingerprint"].to_numpy(np.int64)
            leaf, at, home = route(nodes, values.view(np.uint64), r)
            yield pd.DataFrame({"leaf": leaf, "fingerprint": values[at], "home": home})

    def join(leaf: pd.DataFrame) -> pd.DataFrame:
        values = leaf["fingerprint"].to_numpy(np.int64)
        root = link_members(values.view(np.uint64), leaf["home"].to_numpy(bool), r)
        moved = root != np.arange(len(values))
        return pd.DataFrame({"u": values[moved], "v": values[root[moved]]})

    dealt = prints.select("fingerprint").mapInPandas(deal, "leaf long, fingerprint long, home boolean")
    return dealt.groupBy("leaf").applyInPandas(join, "u long, v long")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fingerprinted rows, class of each fingerprint).

    Rows are (doc_id, text_key, fingerprint), classes (fingerprint, component_id): the smallest
    doc_id that is reachable over links, null if all those are null. Null and empty texts have
    fingerprint zero; equal texts have equal fingerprints and are compared once.
    """
    rows = checkpoint(docs.select("doc_id", F.xxhash64(text_of()).alias("text_key"), _fingerprints(F.col("text")).alias("fingerprint")))
    prints = checkpoint(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    roots = components(links(prints))
    named = prints.join(roots, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows, named.join(least, "root").select("fingerprint", "component_id", "root")


def simhash_table(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint and component."""
    rows, found = classes(docs)
    return rows.join(found, "fingerprint").select("doc_id", as_hex("fingerprint").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component the row with the smallest doc_id, nulls last; columns unchanged."""
    rows, found = classes(docs)
    placed = rows.join(found, "fingerprint")
    first = placed.groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))).alias("first")
    )
    chosen = first.select(F.col("first.id").alias("__id"), F.col("first.key").alias("__key"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(text_of()) == F.col("__key"))
    kept = docs.join(chosen, same, "left_semi")
    again = rows.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count()
    return kept.withColumn("__key", F.xxhash64(text_of())).dropDuplicates(["doc_id", "__key"]).drop("__key") if again else kept
