"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments. A segment holds the documents of about a million tokens:
where each document starts in the segment's line of tokens, and for each term the ascending
places at which it stands. A phrase is looked up in every segment: the places of its rarest
term, moved back by the term's offset, are the candidate starts, which are then intersected
with the moved lists of the next rarer terms, one after the other. Phrases come in blocks of
bounded size and each block goes to all segments, so no posting is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom.llm.common import carry_along, text_of
from replyloom.session import fresh_dir

carry_along(__name__)

WINDOW = 13
SEGMENT_TOKENS = 500_000
# Bytes of phrase texts that go to all segments at once.
BLOCK_BYTES = 4 << 20
# Fixed by the contract: A-Z become a-z, every other ASCII character but digits and letters separates.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
INDEX_SCHEMA = (
    "segment long, doc_ids binary, has_id binary, text_keys binary, doc_starts binary, terms binary, term_starts binary, places binary"
)


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _segment(number: int, ids: list, keys: list, starts: list[int], line: list[bytes]) -> dict:
    codes, terms = pd.factorize(np.array(line, object)) if line else (np.zeros(0, np.int64), [])
    order = np.argsort(codes, kind="stable").astype(np.int32)
    counts = np.bincount(codes, minlength=len(terms))
    return {
        "segment": number,
        "doc_ids": np.array([0 if i is None else i for i in ids], np.int64).tobytes(),
        "has_id": np.array([i is not None for i in ids], np.uint8).tobytes(),
        "text_keys": np.array(keys, np.int64).tobytes(),
        "doc_starts": np.array([*starts, len(line)], np.int32).tobytes(),
        "terms": b" ".join(terms),
        "term_starts": np.concatenate([[0], np.cumsum(counts)]).astype(np.int32).tobytes(),
        "places": order.tobytes(),
    }


def build_index(docs: DataFrame, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Segments over all documents and all their tokens; save it as Parquet to search it again.

    A document is never cut: one with more tokens than ``segment_tokens`` has a segment of its
    own. Null and empty texts take part with no tokens.
    """

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The partition's number and the segment's within it, so that a segment made again has the same.
        number = None
        ids, keys, starts, line = [], [], [], []
        for batch in batches:
            if number is None and len(batch):
                number = int(batch["part"].iloc[0]) << 32
            for doc_id, has, key, text in zip(batch["doc_id"], batch["has"], batch["text_key"], batch["text"]):
                words = tokens(text)
                if line and len(line) + len(words) > segment_tokens or len(ids) >= segment_tokens:
                    yield pd.DataFrame([_segment(number, ids, keys, starts, line)])
                    number += 1
                    ids, keys, starts, line = [], [], [], []
                ids.append(int(doc_id) if has else None)
                keys.append(key)
                starts.append(len(line))
                line.extend(words)
        if ids:
            yield pd.DataFrame([_segment(number, ids, keys, starts, line)])

    given = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"),
        F.col("doc_id").isNotNull().alias("has"),
        F.xxhash64(text_of()).alias("text_key"),
        F.spark_partition_id().alias("part"),
        "text",
    )
    return given.mapInPandas(segments, INDEX_SCHEMA)


def windows(text: str | None, size: int = WINDOW) -> list[tuple[bytes, ...]]:
    """The runs of ``size`` tokens; a shorter text, unless it is blank, is one run."""
    words = tokens(text)
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(len(words) - size, 0) + 1)]


class Phrases:
    """A block of phrases as arrays: term numbers per offset, length, and the items of each."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], size: int = WINDOW):
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            for window in windows(text, size):
                owners[window].update([] if item is None else [item])
        self.phrases = list(owners)
        self.items = [sorted(owners[p]) for p in self.phrases]
        self.vocabulary: dict[bytes, int] = {}
        self.length = np.array([len(p) for p in self.phrases], np.int64)
        self.terms = np.full((len(self.phrases), size), -1, np.int64)
        for row, phrase in enumerate(self.phrases):
            self.terms[row, : len(phrase)] = [self.vocabulary.setdefault(t, len(self.vocabulary)) for t in phrase]


def find(segment: dict, block: Phrases, slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, start, document in the segment) of each match that lies within one document.

    With ``slop`` s the match is one by proximity: the rarest term fixes the start, and every
    other term stands at most s places from where the phrase would have it.
    """
    none = np.zeros(0, np.int64)
    term_starts = np.frombuffer(segment["term_starts"], np.int32)
    places = np.frombuffer(segment["places"], np.int32)
    doc_starts = np.frombuffer(segment["doc_starts"], np.int32).astype(np.int64)
    n = int(doc_starts[-1])
    known = block.vocabulary
    low, count = np.zeros(len(known) + 1, np.int64), np.zeros(len(known) + 1, np.int64)
    for code, term in enumerate(segment["terms"].split()):
        at = known.get(term)
        if at is not None:
            low[at], count[at] = term_starts[code], term_starts[code + 1] - term_starts[code]
    used = np.flatnonzero(count)
    if not len(used):
        return none, none, none
    # One ascending list of term * n + place for all terms of the block.
    listed = np.concatenate([at * n + places[low[at] : low[at] + count[at]].astype(np.int64) for at in used])
    real = block.terms >= 0
    frequency = np.where(real, count[block.terms], np.iinfo(np.int64).max)
    alive = np.flatnonzero((frequency > 0).all(axis=1))
    order = np.argsort(frequency[alive], axis=1, kind="stable")
    rarest = block.terms[alive, order[:, 0]]
    repeat = count[rarest]
    row = np.repeat(np.arange(len(alive)), repeat)
    inside = np.arange(len(row)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    start = places[np.repeat(low[rarest], repeat) + inside].astype(np.int64) - order[row, 0]
    doc = np.searchsorted(doc_starts, start + order[row, 0], "right") - 1
    fits = (start >= doc_starts[doc]) & (start + block.length[alive[row]] <= doc_starts[doc + 1])
    row, start, doc = row[fits], start[fits], doc[fits]
    for rank in range(1, block.terms.shape[1]):
        if not len(row):
            break
        offset = order[row, rank]
        term = block.terms[alive[row], offset]
        place = start + offset
        first = np.maximum(place - slop, doc_starts[doc])
        last = np.minimum(place + slop, doc_starts[doc + 1] - 1)
        at = np.searchsorted(listed, term * n + first)
        hit = (at < len(listed)) & (listed[np.minimum(at, len(listed) - 1)] <= term * n + last)
        hit |= term < 0
        row, start, doc = row[hit], start[hit], doc[hit]
    return alive[row], start, doc


def _blocks(phrases: DataFrame, block_bytes: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """Rows of (item_id, text) in blocks of bounded size; a partition at a time reaches the driver."""
    block, size = [], 0
    for row in phrases.select(F.col("item_id").cast("string").alias("item"), "text").toLocalIterator():
        block.append((row["item"], row["text"]))
        size += len(row["text"] or "")
        if size >= block_bytes:
            yield block
            block, size = [], 0
    yield block


MATCH_SCHEMA = (
    "doc_id long, text_key long, segment long, segment_doc long, n_words long, "
    "spans array<struct<first: long, last: long>>, item_ids array<string>"
)


def _search_block(index: DataFrame, block: Phrases, slop: int) -> DataFrame:
    sent = index.sparkSession.sparkContext.broadcast(vars(block))  # at most one block, see BLOCK_BYTES

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = SimpleNamespace(**sent.value)
        for batch in batches:
            for segment in batch.to_dict("records"):
                ids, has = np.frombuffer(segment["doc_ids"], np.int64), np.frombuffer(segment["has_id"], np.uint8)
                keys = np.frombuffer(segment["text_keys"], np.int64)
                starts = np.frombuffer(segment["doc_starts"], np.int32).astype(np.int64)
                phrase, start, doc = find(segment, block, slop)
                spans: list[list] = [[] for _ in ids]
                items: list[set] = [set() for _ in ids]
                for p, s, d in sorted(zip(phrase.tolist(), start.tolist(), doc.tolist()), key=lambda x: x[1]):
                    items[d].update(block.items[p])
                    first, last = s - starts[d], s - starts[d] + block.length[p]
                    if spans[d] and first <= spans[d][-1]["last"]:
                        spans[d][-1]["last"] = max(spans[d][-1]["last"], int(last))
                    else:
                        spans[d].append({"first": int(first), "last": int(last)})
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array([i if h else None for i, h in zip(ids.tolist(), has)], "Int64"),
                        "text_key": keys,
                        "segment": segment["segment"],
                        "segment_doc": np.arange(len(ids)),
                        "n_words": np.diff(starts),
                        "spans": spans,
                        "item_ids": [sorted(x) for x in items],
                    }
                )

    return index.mapInPandas(look, MATCH_SCHEMA)


def search(index: DataFrame, phrases: DataFrame, window: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document of ``index`` the hit spans of tokens and the items with a matching window.

    Spans are (first, last) with last excluded, disjoint and ascending for each block of
    phrases. Phrases without tokens match nothing; windows of items without an id hit words but
    name no item; equal items share their windows.
    """
    parts = [_search_block(index, Phrases(b, window), slop) for b in _blocks(phrases, block_bytes)]
    if len(parts) == 1:
        return parts[0].drop("segment", "segment_doc")
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    merged = every.groupBy("doc_id", "text_key", "segment", "segment_doc", "n_words").agg(
        F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
    )
    return merged.drop("segment", "segment_doc")


def _covered(spans: Column) -> Column:
    """Tokens in the union of ascending spans, which may overlap if they come from several blocks."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(
        spans,
        start,
        lambda a, s: F.struct(
            (a["n"] + F.greatest(s["last"] - F.greatest(s["first"], a["end"]), F.lit(0))).alias("n"),
            F.greatest(a["end"], s["last"]).alias("end"),
        ),
        lambda a: a["n"],
    )


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document the words inside benchmark windows, the items and the verdict.

    A document is contaminated if a twentieth of its words or more is hit. Null texts have no
    words. The index is written to the shared folder and searched from there.
    """
    spark = docs.sparkSession
    path = fresh_dir(spark, "postings")
    build_index(docs).write.option("compression", "zstd").parquet(path)
    found = search(spark.read.parquet(path), benchmark)
    return found.withColumn("n_hit", _covered(F.col("spans"))).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def contamination_table(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return judge(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, columns unchanged; equal rows go together."""
    bad = judge(docs.select("doc_id", "text"), benchmark).where("contaminated")
    bad = bad.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(text_of()) == F.col("__key"))
    return docs.join(bad, same, "left_anti")
