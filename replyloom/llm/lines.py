"""Line dedup: a segment-partition edit join over all lines.

Two lines link if at most THRESHOLD edits turn one into the other. A line is cut into
THRESHOLD + 1 segments of near equal length. By the pigeonhole principle one segment of the
shorter line survives in the longer one at a place that few shifts can reach, so the longer one
looks up only those substrings, for each length that it may pair with. Segments of short lines
would be met by most others, so a pair whose shorter line is SHORT of characters meets by what
both keep: the texts that THRESHOLD deletions leave of the longer one. Candidates are verified by
a banded bit-parallel edit distance. Equal lines are compared once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom.llm.common import carry_along, text_of
from replyloom.llm.components import components
from replyloom.session import broadcast_if_small, checkpoint

carry_along(__name__)

THRESHOLD = 2
# Lines of at least this length pair with different ones: all that are not blank.
MIN_CHARS = 1
# Pairs of which the shorter line has fewer characters meet by deletions, others by segments.
SHORT = 16
# Bits of a line's name that bound the number of edits to another; the rest is a hash.
SIGN_BITS = 40
LOW_MASK = (1 << (64 - SIGN_BITS)) - 1
# Bytes of lines whose segments a task names at once.
SLICE_BYTES = 2 << 20
# How a line comes to a segment: by a longer line's look-up, by one of equal length, as its own.
SHORTER, EQUAL, OWN = 0, 1, 2
# Base of the polynomial whose differences name substrings, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def segments(length: int, tau: int = THRESHOLD) -> list[tuple[int, int]]:
    """(start, size) of the tau + 1 segments of a line; the last ones are longer by one if uneven."""
    parts = tau + 1
    size, more = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = size + (i >= parts - more)
        out.append((at, n))
        at += n
    return out


def probes(length: int, tau: int = THRESHOLD) -> list[tuple[int, int, int, int]]:
    """(length of the partner, segment, start, size) of the substrings that a line looks up.

    Only partners that are not longer are looked up. Starts are those from which the rest on
    either side can still be matched with the edits that are left.
    """
    out = []
    for other in range(max(length - tau, 0), length + 1):
        delta = length - other
        for i, (at, size) in enumerate(segments(other, tau)):
            low = max(0, at - i, at + delta - (tau - i))
            high = min(length - size, at + i, at + delta + (tau - i))
            out.extend((other, i, start, size) for start in range(low, high + 1))
    return out


def within(a: str, b: str, tau: int = THRESHOLD) -> bool:
    """Whether at most ``tau`` edits part the two texts.

    State d holds, as bits, the diagonals of the band that are reachable with d edits; a step
    reads one character of ``a`` and moves all diagonals at once.
    """
    if abs(len(a) - len(b)) > tau:
        return False
    if a == b:
        return True
    n, m = len(a), len(b)
    full = (1 << (2 * tau + 1)) - 1
    start = 1 << tau
    states = []
    for d in range(tau + 1):
        states.append(start if d == 0 else states[-1] | (states[-1] << 1) & full)
    for i, c in enumerate(a):
        match = 0
        for bit in range(2 * tau + 1):
            j = i + bit - tau
            if 0 <= j < m and b[j] == c:
                match |= 1 << bit
        before, last_new = 0, 0
        for d in range(tau + 1):
            old = states[d]
            new = old & match
            if d:
                new |= before | (before >> 1) | (last_new << 1) & full
            states[d], before, last_new = new, old, new
        if not states[tau]:
            return False
    return bool(states[tau] >> (m - n + tau) & 1)


def near(a: str, b: str, tau: int = THRESHOLD) -> bool:
    """``within`` after the shared start and end are cut off, which no edit need touch."""
    short = min(len(a), len(b))
    low, high = 0, short
    while low < high:  # longest shared start by halving
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    end, short = 0, min(len(a), len(b))
    while end < short and a[-1 - end] == b[-1 - end]:
        end += 1
    return within(a[: len(a) - end], b[: len(b) - end], tau)


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _code_points(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all lines, one after the other, and the length of each line."""
    if not len(lines):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
    text = str(memoryview(lines.buffers()[2] or b"")[at[0] : at[-1]], "utf-8").encode("utf-32-le")
    return np.frombuffer(text, np.uint32).astype(np.uint64), pc.utf8_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)


def names(text: np.ndarray, lengths: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number per line: SIGN_BITS parities of its pairs of neighbours, then bits of its hash.

    Each bit tells whether an odd number of the pairs that fall to it occur. An edit takes away
    two pairs at most and brings in two, so the parities of lines that link differ in no more
    than four bits per edit. Lines come as ``_code_points`` gives them.
    """
    n = len(lengths)
    pairs = (text[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (text[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    bins = ((pairs ^ (pairs >> np.uint64(31))) >> np.uint64(7)) % np.uint64(SIGN_BITS)
    of = np.repeat(np.arange(n), lengths)
    inside = of[:-1] == of[1:]  # pairs across two lines belong to none
    odd = np.bincount(of[:-1][inside] * SIGN_BITS + bins[inside].astype(np.int64), minlength=n * SIGN_BITS) & 1
    sign = odd.reshape(n, SIGN_BITS).astype(np.uint64) @ (np.uint64(1) << np.arange(SIGN_BITS, dtype=np.uint64))
    return ((sign << np.uint64(64 - SIGN_BITS)) | (hashes.view(np.uint64) & np.uint64(LOW_MASK))).view(np.int64)


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, place, line, key) of every line that is not blank, told apart by ``key``; null texts have none."""
    placed = docs.select("doc_id", F.posexplode(F.split(text_of(), "\n")).alias("place", "line"))
    return placed.where(F.col("line").rlike(r"[^\x20\x09-\x0D]")).withColumn("key", line_key())


def line_key() -> Column:
    return F.md5(F.col("line").cast("binary")).alias("key")


def _line_hash() -> Column:
    return F.xxhash64(F.col("line").cast("binary"))


class _Plans:
    """Of each length of line the look-ups of ``probes``: a number for partner and segment, start, end and kind."""

    def __init__(self, tau: int):
        self.tau, self.at, self.tables = tau, {}, np.zeros((4, 0), np.int64)

    def of(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first row, number of rows) in ``tables`` for each length."""
        distinct, which = np.unique(lengths, return_inverse=True)
        added, end = [self.tables], self.tables.shape[1]
        for n in distinct.tolist():
            if n not in self.at:
                own = segments(n, self.tau)
                rows = [
                    (other * (self.tau + 1) + i, at, at + size, OWN if other == n and at == own[i][0] else EQUAL if other == n else SHORTER)
                    for other, i, at, size in probes(n, self.tau)
                    if other >= SHORT
                ]
                added.append(np.array(rows, np.int64).reshape(-1, 4).T)
                self.at[n] = end, len(rows)
                end += len(rows)
        if len(added) > 1:
            self.tables = np.concatenate(added, axis=1)
        found = np.array([self.at[n] for n in distinct.tolist()], np.int64).reshape(-1, 2)[which.reshape(-1)]
        return found[:, 0], found[:, 1]


def _mixed(numbers: np.ndarray) -> np.ndarray:
    numbers = (numbers ^ (numbers >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (numbers ^ (numbers >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)))


def segment_tokens(lines: pa.Array, hashes: np.ndarray, plans: _Plans) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, id, kind) of all substrings that the lines look up, their own segments among them.

    A token stands for partner's length, segment and substring. The substring is named by the
    difference of two prefixes of one polynomial over all lines, so equal ones have equal names.
    """
    text, lengths = _code_points(lines)
    begins = np.cumsum(lengths) - lengths
    prefix = np.append(np.uint64(0), np.cumsum(_mixed(text + np.uint64(1)) * _powers(BASE, len(text))[:-1], dtype=np.uint64))
    back = _powers(INVERSE, len(text))
    first, counts = plans.of(lengths)
    row = np.arange(counts.sum()) + np.repeat(first - (np.cumsum(counts) - counts), counts)
    part, start, end, kind = plans.tables[:, row]
    begin = np.repeat(begins, counts)
    name = (prefix[begin + end] - prefix[begin + start]) * back[begin + start]
    token = _mixed(name ^ _mixed(part.astype(np.uint64) + np.uint64(1)))
    return token.view(np.int64), np.repeat(names(text, lengths, hashes), counts), kind.astype(np.int8)


def _tokens(lines: DataFrame, tau: int) -> DataFrame:
    """Distinct (token, id, kind) of the segments that lines look up; of kind OWN are those that they have.

    A task names a line that it meets again in a batch once, and the rest of the copies go
    after the shuffle, so a line with very many copies weighs as one.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans = _Plans(tau)
        for batch in batches:
            hashes, at = np.unique(batch.column("hash").to_numpy(zero_copy_only=False), return_index=True)
            texts = batch.column("line").take(pa.array(at))
            sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(sizes // SLICE_BYTES)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    found = segment_tokens(texts.slice(a, b - a), hashes[a:b], plans)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["token", "id", "kind"])

    dealt = lines.select(_line_hash().alias("hash"), "line").mapInArrow(deal, "token long, id long, kind byte")
    # One kind of each line and token is enough: its own segment tells most.
    return dealt.repartition("token").groupBy("token", "id").agg(F.max("kind").alias("kind"))


def candidates(lines: DataFrame, tau: int = THRESHOLD) -> DataFrame:
    """Pairs u < v of names of lines from SHORT on of which the longer one has a segment of the other in reach.

    Lines whose names tell that too many edits part them do not leave the join, so near copies
    that share a segment but differ elsewhere make no rows.
    """
    dealt = _tokens(lines.where(F.length("line") >= SHORT), tau)
    own = dealt.where(F.col("kind") == OWN).select("token", F.col("id").alias("u"))
    asked = dealt.select("token", F.col("id").alias("v"), "kind")
    apart = F.bit_count(F.shiftrightunsigned(F.col("u").bitwiseXOR(F.col("v")), 64 - SIGN_BITS))
    # Of two lines of one length either may look up the other: that with the greater name does.
    once = (F.col("u") < F.col("v")) | ((F.col("kind") == SHORTER) & (F.col("u") != F.col("v")))
    met = own.join(asked, "token").where(once & (apart <= 4 * tau))
    return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def kept_texts(line: str, own: bool, tau: int = THRESHOLD) -> set[str]:
    """What ``tau`` deletions leave of a line, or, with ``own``, up to ``tau`` of them.

    Lines that ``tau`` edits part share a text of ``tau`` characters less than the longer one
    has (of none if it has fewer), since an edit costs the longer line one character at most.
    """
    n = len(line)
    low = max(n - tau, 0)
    return {"".join(x) for size in range(low, (n if own else low) + 1) for x in combinations(line, size)}


def short_links(lines: DataFrame, tau: int = THRESHOLD) -> DataFrame:
    """``links`` of the pairs of which the shorter line has fewer than SHORT characters.

    Lines of so few characters go through the join themselves. Those that meet nearly link, so
    no group is much larger than its links.
    """

    short = checkpoint(lines.where(F.length("line") < SHORT + tau).select("line").distinct())

    def left(own: bool, name: str) -> DataFrame:
        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                kept = [[_digest(x) for x in kept_texts(line, own, tau)] for line in batch["line"]]
                counts = np.array([len(x) for x in kept], np.int64)
                tokens = np.array([x for one in kept for x in one], np.uint64).view(np.int64)
                yield pd.DataFrame({"token": tokens, name: np.repeat(batch["line"].to_numpy(object), counts)})

        some = short.where(F.length("line") < SHORT) if own else short
        return some.mapInPandas(deal, f"token long, {name} string")

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([near(x, y, tau) for x, y in zip(a, b)], dtype=bool)

    met = left(True, "a").join(left(False, "b"), "token").where("a <> b")
    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().where(linked("a", "b"))
    keys = [F.md5(F.col(n).cast("binary")) for n in ("a", "b")]
    return pairs.select(F.least(*keys).alias("u"), F.greatest(*keys).alias("v"))


def links(lines: DataFrame, tau: int = THRESHOLD) -> DataFrame:
    """Pairs u < v of keys of different lines that at most ``tau`` edits part."""
    return long_links(lines, tau).union(short_links(lines, tau))


def long_links(lines: DataFrame, tau: int = THRESHOLD) -> DataFrame:
    """``links`` of the pairs of which the shorter line has SHORT characters or more."""
    pairs = checkpoint(candidates(lines, tau))

    @F.pandas_udf("long")
    def named(text: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(names(*_code_points(pa.array(text, pa.string())), hashes.to_numpy(np.int64)), dtype="int64")

    wanted = checkpoint(pairs.select(F.explode(F.array("u", "v")).alias("id")).distinct())
    # A name ends like the line's hash, so few other lines have to be named.
    ends = wanted.select(F.col("id").bitwiseAND(LOW_MASK).alias("end")).distinct()
    hashed = lines.select("line", _line_hash().alias("hash"))
    # Written down, or the engine would name every line before this join.
    like = checkpoint(hashed.join(broadcast_if_small(ends), F.col("hash").bitwiseAND(LOW_MASK) == F.col("end"), "left_semi"))
    named_lines = like.select(line_key(), "line", named("line", "hash").alias("id"))
    texts = checkpoint(named_lines.join(broadcast_if_small(wanted), "id", "left_semi").dropDuplicates(["key"]))
    side = lambda n: texts.select(F.col("id").alias(n), F.col("key").alias(f"key_{n}"), F.col("line").alias(f"line_{n}"))

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([near(x, y, tau) for x, y in zip(a, b)], dtype=bool)

    found = pairs.join(side("u"), "u").join(side("v"), "v").where(linked("line_u", "line_v"))
    return found.select(F.least("key_u", "key_v").alias("u"), F.greatest("key_u", "key_v").alias("v"))


def line_classes(docs: DataFrame, tau: int = THRESHOLD) -> DataFrame:
    """Per line its class and the number of different lines that it links to.

    Returns doc_id, place (from 0, blank lines counted but not returned), class_doc_id and
    class_place of the first line of the class by doc_id and place, n_links and kept, true for
    that first line. Rows with a null doc_id come first; a repeated row shares the place of its
    twin.
    """
    lines = lines_of(docs)
    found = checkpoint(links(lines, tau))
    degree = found.select(F.explode(F.array("u", "v")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_links"))
    roots = components(found).withColumnRenamed("node", "key")
    known = checkpoint(degree.join(roots, "key", "left").select("key", "n_links", F.coalesce("root", "key").alias("root")))
    placed = lines.select("doc_id", "place", "key").join(known, "key", "left")
    classed = placed.select("doc_id", "place", F.coalesce("root", "key").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    first = classed.groupBy("root").agg(F.min(F.struct("doc_id", "place")).alias("first"))
    out = classed.join(first, "root")
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("place") == F.col("first.place"))
    return out.select(
        "doc_id",
        "place",
        F.col("first.doc_id").alias("class_doc_id"),
        F.col("first.place").alias("class_place"),
        "n_links",
        same.alias("kept"),
    )


def drop_repeated_lines(docs: DataFrame, tau: int = THRESHOLD) -> DataFrame:
    """``docs`` with the lines that are not the first of their class taken out, blank ones kept.

    Each row counts by itself, also where an id is null or repeated: of rows with one id the
    first keeps the line. All columns stay.
    """
    rows = checkpoint(docs.select(F.struct("*").alias("__doc"), "doc_id", "text").withColumn("__row", F.monotonically_increasing_id()))
    classes = line_classes(rows.select(F.struct("doc_id", "__row").alias("doc_id"), "text"), tau)
    gone = classes.where("not kept").groupBy(F.col("doc_id.__row").alias("__row")).agg(F.collect_set("place").alias("__gone"))
    rest = F.filter(F.split(text_of(), "\n"), lambda x, i: ~F.array_contains(F.col("__gone"), i))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    return rows.join(gone, "__row", "left").select(F.col("__doc").withField("text", text).alias("__doc")).select("__doc.*")
