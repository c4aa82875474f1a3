"""Token ids of a corpus in ORC files, one row per document in ascending order of its id.

A store is a folder with ``ids`` (ORC) and ``parts`` (one Parquet row per ORC part, written last,
so a folder without it is no store). Documents are dealt to parts by ranges of their id and each
part is written by the task that encodes it. Token ids are an ORC integer list, hence run-length
encoded; every stripe has a row index and a Bloom filter on doc_id, so a lookup skips files,
stripes and row groups by metadata, and Spark reads the stripes of one file in parallel.

Rules for odd input: a null text is the empty text and has only the end id; a null doc_id comes
before all others; repeated ids or rows each get a row of their own, and rows of one id stand in
the order of the input's partitions; an empty table gives a store without rows; extra
columns are ignored, whatever their names. A text of any length is one row; a row may hold up to
2^31 ids.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from replyloom.llm.common import carry_along, text_of
from replyloom.session import broadcast_if_small, fresh_dir

carry_along(__name__)

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
# Bytes of a stripe before compression; rows to which one row-index entry and Bloom filter belong.
STRIPE_BYTES = 32 << 20
INDEX_ROWS = 1000
# Bytes of text that one part of the store is to hold.
PART_BYTES = 256 << 20
# Bytes encoded at once; words kept in each of the two generations of the memo.
CHUNK_BYTES = 4 << 20
MEMO_WORDS = 250_000

# A blank after a character that is no white space always starts a new token in byte-level BPE.
_CUT = re.compile(r"(?<=\S)(?= )")


class PieceEncoder:
    """Encodes texts with a byte-level BPE word by word.

    Equal words after a blank have equal ids wherever they stand, so a chunk's texts become numbers
    of its different words, and only words that the memo lacks reach the tokenizer. The memo is
    bounded: when the young generation is full it becomes the old one, which is dropped at the
    next turn.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        # One character of a vocabulary entry stands for one byte.
        self.bytes_of[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each text closed by ``end_id``, and the number of ids of each."""
        lists = pc.split_pattern(texts, " ")
        first = lists.offsets.to_numpy().astype(np.int64)
        first, ends = first[:-1] - first[0], first[1:] - first[0]
        coded = lists.flatten().dictionary_encode()
        words, index = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        entry = index.astype(np.int64)
        owner = np.repeat(np.arange(len(first), dtype=np.int32), ends - first)
        # A blank starts a token unless white space stands before it; such texts are cut with care.
        trimmed = pc.binary_length(pc.utf8_rtrim_whitespace(coded.dictionary))
        whole = pc.and_(pc.equal(trimmed, pc.binary_length(coded.dictionary)), pc.greater(trimmed, 0))
        open_ended = ~whole.to_numpy(zero_copy_only=False)[index]
        open_ended[ends - 1] = False
        careful = np.unique(owner[open_ended])
        table = self._after_blank(words)
        kept = np.ones(len(entry), bool)
        if len(careful):
            kept[np.isin(owner, careful)] = False
            kept[first] = True
        entry[first] = len(table) + np.arange(len(first))
        heads = [words[k] for k in index[first].tolist()]
        table += self._alone(heads)
        for k in careful.tolist():
            table[entry[first[k]]] = self._carefully(texts[k].as_py())
        entry, owner = entry[kept], owner[kept]
        stops = np.searchsorted(owner, np.arange(len(first)), side="right")
        entry = np.insert(entry, stops, len(table))
        table.append(np.array([end_id], "<u4").tobytes())
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        flat, starts = np.frombuffer(b"".join(table), "<i4"), np.cumsum(sizes) - sizes
        own = sizes[entry]
        upto = np.cumsum(own)
        tokens = flat[np.repeat(starts[entry] - upto + own, own) + np.arange(upto[-1] if len(upto) else 0)]
        closes = upto[stops + np.arange(len(stops))]
        return tokens, np.diff(closes, prepend=0)

    def _carefully(self, text: str) -> bytes:
        """The ids of a text in which white space stands before blanks, which then start no token."""
        piece, *rest = _CUT.split(text)
        wide = iter(self._alone([piece, *[r for r in rest if " " in r[1:]]]))
        words = iter(self._after_blank([r[1:] for r in rest if " " not in r[1:]]))
        return next(wide) + b"".join([next(wide) if " " in r[1:] else next(words) for r in rest])

    def _alone(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(f.ids, "<u4").tobytes() for f in found]

    def _after_blank(self, words: list[str]) -> list[bytes]:
        """The ids of each of these words, which hold no blank, with a blank before it, as bytes of 32-bit integers."""
        if len(self.young) > MEMO_WORDS:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        unknown = set(words).difference(young)
        young.update([(w, old[w]) for w in unknown if w in old])
        new = list(unknown.difference(young))
        if new:
            # Encoded as one text. A blank starts each word, and the bytes that the ids stand for tell whose an id is.
            text = " " + " ".join(new)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            raw = text.encode()
            starts = np.append(np.flatnonzero(np.frombuffer(raw, np.uint8) == ord(" ")), len(raw))
            cuts = 4 * np.searchsorted(np.cumsum(self.bytes_of[ids]) - self.bytes_of[ids], starts)
            raw, cuts = ids.tobytes(), cuts.tolist()
            young.update(zip(new, [raw[a:b] for a, b in zip(cuts, cuts[1:])]))
        out = list(map(young.__getitem__, words))
        for word in new:
            if len(word) > 64:
                del young[word]
        return out


def _chunks(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of at most CHUNK_BYTES bytes, or of one text."""
    ends, first = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
    while first < len(texts):
        done = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, done + CHUNK_BYTES, side="right")), first + 1)
        yield texts.slice(first, last - first)
        first = last


def _encode(batches: Iterator[pa.RecordBatch], path: str, end_id: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    encoder, part, place, before = PieceEncoder(path), TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        first = 0
        for texts in _chunks(batch.column(1)):
            tokens, sizes = encoder.encode(texts, end_id)
            ends = np.cumsum(sizes)
            columns = [
                batch.column(0).slice(first, len(texts)),
                pa.array(np.full(len(texts), part, np.int32)),
                pa.array(np.arange(place, place + len(texts))),
                pa.array(before + ends - sizes),
                pa.array(sizes),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(tokens)),
            ]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
            first, place, before = first + len(texts), place + len(texts), before + int(ends[-1])


def _layout(id_type) -> StructType:
    return (
        StructType().add("doc_id", id_type).add("part", IntegerType()).add("place", LongType())
        .add("before", LongType()).add("n_tokens", LongType()).add("ids", ArrayType(IntegerType()))
    )


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    part_bytes: int = PART_BYTES,
    stripe_bytes: int = STRIPE_BYTES,
    index_rows: int = INDEX_ROWS,
) -> None:
    """Encode ``docs`` (doc_id, text) with the tokenizer file and write a store at ``path``.

    A doc_id that many rows share is spread over parts by the rows' places in the input. No
    part needs to know another one: ``before`` counts ids within the part, and the parts' own
    totals, one row each, are summed at the end.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark, keys = docs.sparkSession, ["doc_id", "__place"]
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(size // part_bytes, 2 * spark.sparkContext.defaultParallelism)
    ranged = (
        docs.select("doc_id", text_of().alias("text"))
        .withColumn("__place", F.monotonically_increasing_id())
        .repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .select("doc_id", "text")
    )
    layout = _layout(docs.schema["doc_id"].dataType)
    vocabulary = tokenizer or public_tokenizers.path(VOCABULARY)
    work = partial(_encode, path=vocabulary, end_id=end_id, schema=to_arrow_schema(layout))
    ranged.mapInArrow(work, layout).write.format("orc").options(
        **{
            "compression": "zstd",
            "orc.stripe.size": str(stripe_bytes),
            "orc.row.index.stride": str(index_rows),
            "orc.bloom.filter.columns": "doc_id",
            "orc.bloom.filter.fpp": "0.01",
            "orc.encoding.strategy": "COMPRESSION",
        }
    ).save(f"{path}/ids")
    written = spark.read.schema(layout).orc(f"{path}/ids")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per part.
    (
        written.groupBy("part")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        .withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
        .write.parquet(f"{path}/parts")
    )


def _placed(spark: SparkSession, path: str, id_type, keep=None) -> DataFrame:
    rows = spark.read.schema(_layout(id_type)).orc(f"{path}/ids")
    rows = rows if keep is None else rows.where(keep)
    parts = spark.read.parquet(f"{path}/parts").select("part", "base")
    return rows.join(broadcast_if_small(parts), "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), F.size("ids").cast("long").alias("n_tokens"), "ids"
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: Sequence | None = None, id_type=LongType()) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents, or of the given ids by way of the indexes."""
    return _placed(spark, path, id_type, None if doc_ids is None else F.col("doc_id").isin(list(doc_ids)))


def read_span(spark: SparkSession, path: str, first: int, stop: int, id_type=LongType()) -> DataFrame:
    """(doc_id, start, ids) of the ids number ``first`` to ``stop - 1`` of the whole store.

    The first and the last part that hold some of them bound the scan, so other files and row
    groups are skipped.
    """
    parts = spark.read.parquet(f"{path}/parts").where((F.col("base") < stop) & (F.col("base") + F.col("n_tokens") > first))
    low, high = parts.agg(F.min("part"), F.max("part")).first()
    inside = F.lit(False) if low is None else F.col("part").between(low, high)
    rows = _placed(spark, path, id_type, inside).where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > first))
    skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0)).cast("int")
    until = F.least(F.lit(stop) - F.col("start"), F.col("n_tokens")).cast("int")
    return rows.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("ids", skip + 1, until - skip).alias("ids"))


def _checksums(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        ends, tokens = lists.offsets.to_numpy(), np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")
        sums = [zlib.crc32(tokens[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        columns = [batch.column(n) for n in ("doc_id", "start", "n_tokens")] + [pa.array(sums, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)


def checksums(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what ``read_tokens`` gives."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = StructType([*rows.select("doc_id", "start", "n_tokens").schema.fields]).add("ids_crc32", LongType())
    return rows.mapInArrow(partial(_checksums, schema=to_arrow_schema(out)), out)


def token_table(docs: DataFrame) -> DataFrame:
    """Write a store of ``docs`` in the shared folder, read it back and return its checksums."""
    path = fresh_dir(docs.sparkSession, "tokens")
    write_tokens(docs, path)
    return checksums(read_tokens(docs.sparkSession, path, id_type=docs.schema["doc_id"].dataType))
