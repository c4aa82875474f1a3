"""Exact substring dedup with sharded suffix arrays.

Every byte inside a string of MATCH bytes that also starts earlier is removed. Each such string
has an anchor: the least of the hashes of its GRAM-byte substrings. Equal strings have equal
anchors, so they meet in the shard of that hash, and a string whose anchor occurs in one text
only needs no comparison. Strings in a row with one anchor cover a segment. Equal segments are
folded into the first; the different segments of an anchor are laid end to end in a shard, whose
suffix array is built by induced sorting. Neighbours in the array
that share MATCH bytes or more, by their permuted common prefixes, are equal strings, of which
all but the earliest go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from replyloom.llm.common import carry_along, text_of
from replyloom.llm.induced import common_prefixes, suffix_array
from replyloom.operators.rows import number_rows
from replyloom.session import broadcast_if_small, checkpoint, fresh_dir

carry_along(__name__)

MATCH, GRAM = 100, 24
# Bytes of documents that are hashed together, and of segments in a shard.
PIECE, SHARD_BYTES = 1 << 17, 1 << 20
# Different segments of one anchor beyond which its strings are dealt one by one.
HOT = 20_000
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` bytes, from hashes of half as many by doubling."""
    base = np.uint64(0x100000001B3)
    parts = {1: (data.astype(np.uint64) + np.uint64(1)) * np.uint64(_ODD[0])}
    powers, width = {1: base}, 1
    while width * 2 <= size:
        h, p = parts[width], powers[width]
        parts[width * 2] = h[:-width] * p + h[width:]
        powers[width * 2] = np.uint64(pow(int(base), width * 2, 1 << 64))
        width *= 2
    out, done = parts[width], width
    for w in sorted((w for w in parts if w < width), reverse=True):
        if size - done >= w:
            n = len(data) - done - w + 1
            out = out[:n] * powers[w] + parts[w][done : done + n]
            done += w
    out = (out ^ (out >> np.uint64(29))) * np.uint64(_ODD[1])
    return (out ^ (out >> np.uint64(32))) | np.uint64(1)


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of each ``width`` neighbours, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    if have < width:
        more = width - have
        out = best(out[:-more], out[more:])
    return out


def anchors(data: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first string, last string, whether it may repeat itself) per stretch of strings.

    A stretch holds the strings of MATCH bytes in a row that have one least hash. It can repeat
    a string only if that hash occurs in it twice, so if it occurs more often than stretches
    have it. ``allowed`` says which starts of strings count.
    """
    if len(data) < MATCH:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(bool)
    width = MATCH - GRAM + 1
    h = _gram_hashes(data, GRAM)
    least = np.where(allowed, _sliding(h, width, np.minimum), np.uint64(0))
    pad = np.zeros(width - 1, np.uint64)
    met, times = np.unique(h[_sliding(np.concatenate([pad, least, pad]), width, np.maximum) == h], return_counts=True)
    change = np.flatnonzero(least[1:] != least[:-1]) + 1
    first = np.append(0, change)
    last = np.append(change, len(least)) - 1
    real = least[first] > 0
    token, first, last = least[first[real]], first[real], last[real]
    at = np.searchsorted(met, token)
    return token, first, last, times[at] > np.bincount(at, minlength=len(met))[at]


# Powers for strings at any place of a piece or of several short documents hashed together.
_REACH = 2 * PIECE
_POWERS = np.multiply.accumulate(np.append(np.ones(1, np.uint64), np.full(_REACH, 0x1000001B3000193, np.uint64)))


def _content(data: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of data[first:stop] for each pair, from running sums of hashed places."""
    sums = np.zeros(len(data) + 1, np.uint64)
    mixed = (data.astype(np.uint64) + np.uint64(7)) * np.uint64(_ODD[2])
    mixed ^= mixed >> np.uint64(31)
    np.cumsum(mixed * _POWERS[: len(data)], out=sums[1:])
    # Equal strings at different places differ by a power of the base, which is evened out.
    value = (sums[stop] - sums[first]) * _POWERS[_REACH - first]
    value ^= (stop - first).astype(np.uint64) * np.uint64(_ODD[0])
    value = (value ^ (value >> np.uint64(30))) * np.uint64(_ODD[1])
    return value ^ (value >> np.uint64(31))


def _hash_pieces(pieces: list[tuple[int, int, bytes]]) -> pd.DataFrame:
    """Segments of pieces (uid, offset in the document, bytes), which no string crosses.

    A segment that its document has had before is marked; it gets a token of its own, so that
    a periodic text does not heap its rows on one.
    """
    data = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    ends = np.cumsum([len(p[2]) for p in pieces])
    allowed = np.ones(max(len(data) - MATCH + 1, 0), bool)
    for end in ends[:-1]:
        allowed[max(end - MATCH + 1, 0) : end] = False
    token, first, last, inner = anchors(data, allowed)
    of = np.searchsorted(ends, first, "right")
    begin = np.concatenate([[0], ends[:-1]])
    ctx = _content(data, first, last + MATCH)
    uid = np.array([p[0] for p in pieces], np.int64)[of]
    start = first - begin[of] + np.array([p[1] for p in pieces], np.int64)[of]
    length = (last - first + MATCH).astype(np.int32)
    order = np.lexsort((start, ctx, token, uid))
    token, ctx, uid, start, length, inner = (x[order] for x in (token, ctx, uid, start, length, inner))
    again = np.zeros(len(order), bool)
    again[1:] = (uid[1:] == uid[:-1]) & (token[1:] == token[:-1]) & (ctx[1:] == ctx[:-1])
    own = (uid.astype(np.uint64) * np.uint64(_ODD[0])) ^ (start.astype(np.uint64) * np.uint64(_ODD[1]))
    token = np.where(again, own, token)
    return pd.DataFrame(
        {
            "token": token.view(np.int64),
            "ctx": ctx.view(np.int64),
            "uid": uid,
            "start": start,
            "length": length,
            "again": again,
            "inner": inner,
        }
    )


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for batch in batches:
        for uid, text in zip(batch["uid"], batch["text"]):
            data = text.encode("utf-8", "surrogatepass")
            # Strings that start in one half piece; its last ones reach into the next.
            for at in range(0, max(len(data) - MATCH + 1, 0), PIECE // 2):
                piece = data[at : at + PIECE // 2 + MATCH - 1]
                held.append((uid, at, piece))
                size += len(piece)
                if size >= PIECE:
                    yield _hash_pieces(held)
                    held, size = [], 0
    if held:
        yield _hash_pieces(held)


def sort_shard(segments: pd.DataFrame) -> pd.DataFrame:
    """Spans (uid, start, length) to remove from these segments (uid, start, data)."""
    sizes = segments["data"].map(len).to_numpy(np.int64)
    ends = np.cumsum(sizes + 1)
    text = np.frombuffer(b"\0".join(segments["data"]) + b"\0", np.uint8).astype(np.int32) + 1
    text[ends - 1] = 0
    order = suffix_array(text, 257)
    shared = common_prefixes(text, order, MATCH)
    group = np.cumsum(shared < MATCH)
    of = np.searchsorted(ends, order, "right")
    inside = order - (ends - sizes - 1)[of]
    whole = inside + MATCH <= sizes[of]
    order, group, of, inside = order[whole], group[whole], of[whole], inside[whole]
    none = pd.DataFrame({"uid": np.zeros(0, np.int64), "start": np.zeros(0, np.int64), "length": np.zeros(0, np.int32)})
    if not len(order):
        return none
    uid, start = segments["uid"].to_numpy(np.int64), segments["start"].to_numpy(np.int64)
    dense = np.unique(uid, return_inverse=True)[1]
    place = start[of] + inside
    key = dense[of] * (place.max() + 1) + place
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    least = np.repeat(np.minimum.reduceat(key, heads), np.diff(np.append(heads, len(key))))
    later = np.sort(order[key > least].astype(np.int64))
    if not len(later):
        return none
    head = np.flatnonzero(np.append(True, np.diff(later) != 1))
    run = np.diff(np.append(head, len(later)))
    at = np.searchsorted(ends, later[head], "right")
    return pd.DataFrame(
        {
            "uid": uid[at],
            "start": start[at] + later[head] - (ends - sizes - 1)[at],
            "length": (run - 1 + MATCH).astype(np.int32),
        }
    )


def _with_uid(docs: DataFrame) -> DataFrame:
    """``docs`` with ``uid``: the doc_id where it is unique, else its number by doc_id and text.

    Null ids come first. Only a table with null or repeated ids is numbered.
    """
    ids = docs.select(F.col("doc_id").alias("d"))
    odd = ids.groupBy("d").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or d is null")
    if odd.isEmpty():
        return docs.withColumn("uid", F.col("doc_id").cast("long"))
    return number_rows(docs, ["doc_id", "text"], "uid")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Spans (uid, start, length) in bytes that together cover all that is to be removed.

    ``docs`` has uid, by which documents are ordered, and text, null as empty.
    """
    spark = docs.sparkSession
    given = docs.select("uid", text_of().alias("text"))
    dealt = given.mapInPandas(_pieces, "token long, ctx long, uid long, start long, length int, again boolean, inner boolean")
    of_token, of_ctx = Window.partitionBy("token"), Window.partitionBy("token", "ctx").orderBy("uid", "start")
    met = (
        dealt.repartition("token")
        .withColumn("again", F.col("again") | (F.dense_rank().over(of_ctx) > 1))
        .withColumn("several", F.col("inner") | (F.min("ctx").over(of_token) != F.max("ctx").over(of_token)))
        .drop("inner")
        .where("again or several")
    )
    path = fresh_dir(spark, "segments")
    met.write.option("compression", "zstd").parquet(path)
    met = spark.read.parquet(path)
    folded = met.where("again").select("uid", "start", "length")
    different = met.where("several and not again")
    counts = different.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
    # At most one row per HOT segments.
    hot = checkpoint(counts.where(F.col("n") > HOT).select("token", F.lit(True).alias("hot")))
    total = counts.agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    wanted = different.join(broadcast_if_small(hot), "token", "left").groupBy("uid").agg(
        F.collect_list(F.struct("token", "start", "length", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("cuts")
    )

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for uid, text, cuts in zip(batch["uid"], batch["text"], batch["cuts"]):
                data = text.encode("utf-8", "surrogatepass")
                for c in cuts:
                    start, stop = c["start"], c["start"] + c["length"]
                    if c["hot"]:
                        for at in range(start, stop - MATCH + 1):
                            piece = data[at : at + MATCH]
                            rows.append((xxhash.xxh3_64_intdigest(piece) - (1 << 63), True, uid, at, piece))
                    else:
                        rows.append((c["token"], False, uid, start, data[start:stop]))
                if len(rows) >= 50_000:
                    yield pd.DataFrame(rows, columns=["token", "hot", "uid", "start", "data"])
                    rows = []
            yield pd.DataFrame(rows, columns=["token", "hot", "uid", "start", "data"])

    texts = given.join(wanted, "uid")
    pieces = texts.mapInPandas(cut, "token long, hot boolean, uid long, start long, data binary")
    if hot.isEmpty():
        single = None
    else:
        # Strings of an anchor with very many segments meet by their bytes, one group per string.
        pieces = spark.read.parquet(_stored(pieces, fresh_dir(spark, "strings")))
        first = Window.partitionBy("token", "data").orderBy("uid", "start")
        ranked = pieces.where("hot").withColumn("n", F.dense_rank().over(first))
        single = ranked.where("n > 1").select("uid", "start", F.lit(MATCH).alias("length"))
        pieces = pieces.where("not hot")
    sharded = pieces.withColumn("shard", F.pmod(F.xxhash64("token"), F.lit(shards)))
    sorted_ = sharded.groupBy("shard").applyInPandas(
        lambda part: sort_shard(part[["uid", "start", "data"]]), "uid long, start long, length int"
    )
    spans = folded.unionByName(sorted_)
    return spans if single is None else spans.unionByName(single)


def _stored(df: DataFrame, path: str) -> str:
    df.write.option("compression", "zstd").parquet(path)
    return path


def _kept(data: bytes, spans: list) -> tuple[bytes, int]:
    """The bytes outside of the spans and the number of stretches that these merge into."""
    out, at, runs = [], 0, 0
    for start, stop in sorted((s["start"], s["start"] + s["length"]) for s in spans):
        if start > at or (start == at and at == 0):
            out.append(data[at:start])
            runs += 1
        at = max(at, stop)
    out.append(data[at:])
    return b"".join(out), runs


def remove_repeats(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """These columns of ``docs`` with n_bytes, n_removed, n_spans and the bytes ``kept``.

    Documents are ordered by doc_id, nulls first, and by text where ids repeat; of equal rows
    the first by that order counts as the earlier one. Null and empty texts keep nothing and
    lose nothing. Kept bytes need not be valid UTF-8.
    """
    named = _with_uid(docs)
    spans = repeated_spans(named).groupBy("uid").agg(F.collect_list(F.struct("start", "length")).alias("__spans"))
    given = named.select(F.struct(*columns).alias("__row"), "uid", text_of().alias("__text")).join(spans, "uid", "left")

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, gone in zip(texts, spans):
            data = text.encode("utf-8", "surrogatepass")
            kept, runs = (data, 0) if gone is None else _kept(data, gone)
            rows.append((len(data), len(data) - len(kept), runs, kept))
        return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    return given.select("__row.*", cut("__text", "__spans").alias("__cut")).select(*columns, "__cut.*")


def suffix_table(docs: DataFrame) -> DataFrame:
    """Per document the counts and the digest of what is left of its text."""
    left = remove_repeats(docs.select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
