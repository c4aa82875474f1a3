"""K-d tree partitioning of documents into shards of near equal bytes.

Rows with equal texts form a group that stays together. A node of the tree is cut along its
widest metadata dimension at the weighted median, where the groups before it hold the left
half's share of the bytes, until every leaf is one shard. Medians come from histograms over
all groups, refined digit by digit, so that no node is sorted or collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom.llm.common import CELLS, number_in_cells, text_of
from replyloom.operators.rows import number_rows
from replyloom.session import broadcast_if_small, checkpoint

SHARDS = 16
# Bits of a dimension, of the tie-break, and of one histogram.
DIM_BITS, TIE_BITS, STEP_BITS = 48, 48, 12
DIMENSIONS = ("lang", "source", "size")


def _ranks(docs: DataFrame, column: str, name: str) -> DataFrame:
    """(__value, ``name``): each value of a text column and its place among them in code-point order, from 1."""
    values = docs.select(F.col(column).cast("string").alias("__value")).where(F.col("__value").isNotNull()).distinct()
    return checkpoint(number_rows(values, ["__value"], name))


def _group_table(docs: DataFrame) -> DataFrame:
    """One row per distinct text: key, bytes of all its rows and its place in each dimension.

    A text dimension holds ranks, so values differ whatever they begin with; null has rank 0.
    """
    size = F.octet_length(text_of()).cast("long") + 1
    rows = docs.select(
        F.md5(text_of().cast("binary")).alias("__group"),
        size.alias("__size"),
        *[F.col(d).cast("string").alias(f"__v{i}") for i, d in enumerate(DIMENSIONS) if d != "size"],
        *[F.floor(F.log2(size) * (1 << 40)).cast("long").alias(f"__d{i}") for i, d in enumerate(DIMENSIONS) if d == "size"],
    )
    for i, d in enumerate(DIMENSIONS):
        if d != "size":
            ranks = broadcast_if_small(_ranks(docs, d, f"__d{i}"))
            rows = rows.join(ranks, rows[f"__v{i}"] == ranks["__value"], "left").drop("__value", f"__v{i}")
            rows = rows.withColumn(f"__d{i}", F.coalesce(f"__d{i}", F.lit(0).cast("long")))
    return rows.groupBy("__group").agg(
        F.sum("__size").alias("__bytes"),
        *[F.min(f"__d{i}").alias(f"__d{i}") for i in range(len(DIMENSIONS))],
    ).withColumn("__tie", F.conv(F.substring("__group", 1, TIE_BITS // 4), 16, 10).cast("long"))


def _pick(node: Column, values: dict[int, int], default: int = 0) -> Column:
    """The value of each node as a CASE; at most as many branches as there are shards."""
    out = F.lit(default).cast("long")
    for k, v in values.items():
        out = F.when(node == k, F.lit(v).cast("long")).otherwise(out)
    return out


def _cuts(df: DataFrame, key: Column, bits: int, live: Sequence[int], left: dict[int, float]) -> tuple[dict, dict]:
    """Per node the key at which the running bytes reach ``left`` and the bytes before that key.

    One histogram of 2^STEP_BITS bins per node and round: its size does not depend on the rows.
    """
    prefix, before = dict.fromkeys(live, 0), dict.fromkeys(live, 0)
    for shift in range(bits - STEP_BITS, -1, -STEP_BITS):
        narrowed = df.withColumn("__key", key).withColumn("__at", _pick(F.col("__node"), prefix))
        within = F.shiftright("__key", shift + STEP_BITS) == F.col("__at")
        counts = (
            narrowed.where(within)
            .groupBy("__node", F.shiftright("__key", shift).alias("__bin"))
            .agg(F.sum("__bytes").alias("__sum"))
            .collect()
        )
        for node in live:
            bins = sorted((r["__bin"], r["__sum"]) for r in counts if r["__node"] == node)
            for at, total in bins:
                prefix[node] = at
                if before[node] + total >= left[node]:
                    break
                before[node] += total
            else:
                before[node] -= bins[-1][1] if bins else 0
    return prefix, before


def shard_groups(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """(__group, shard) for each distinct text of ``docs``.

    A node for k shards gives the left child k // 2 of them and the same share of its bytes. Its
    groups are ordered by the widest dimension, then by digest, so a value that most rows share
    is cut as well. The group at the cut goes to the side that it fills better.
    """
    groups = checkpoint(_group_table(docs).withColumn("__node", F.lit(0).cast("long")))
    todo = {0: (0, n_shards)}  # node -> first shard and number of shards
    dims = range(len(DIMENSIONS))
    spread = groups.agg(*[F.max(f"__d{i}").alias(f"x{i}") for i in dims], *[F.min(f"__d{i}").alias(f"n{i}") for i in dims]).first()
    whole = [max((spread[f"x{i}"] or 0) - (spread[f"n{i}"] or 0), 1) for i in dims]
    while any(k > 1 for _, k in todo.values()):
        live = [n for n, (_, k) in todo.items() if k > 1]
        stats = {
            r["__node"]: r
            for r in groups.groupBy("__node")
            .agg(F.sum("__bytes").alias("bytes"), *[F.max(f"__d{i}").alias(f"x{i}") for i in dims], *[F.min(f"__d{i}").alias(f"n{i}") for i in dims])
            .collect()
        }
        live = [n for n in live if n in stats]
        widest = {n: max(dims, key=lambda i: ((stats[n][f"x{i}"] - stats[n][f"n{i}"]) / whole[i], -i)) for n in live}
        left = {n: stats[n]["bytes"] * (todo[n][1] // 2) / todo[n][1] for n in live}
        node = F.col("__node")
        key = F.lit(0).cast("long")
        for n, i in widest.items():
            key = F.when(node == n, F.col(f"__d{i}")).otherwise(key)
        inner = groups.where(node.isin(live)) if live else groups.limit(0)
        value, before = _cuts(inner, key, DIM_BITS, live, left)
        tied = inner.where(key == _pick(node, value))
        rest = {n: left[n] - before[n] for n in live}
        tie, passed = _cuts(tied, F.col("__tie"), TIE_BITS, live, rest)
        at_cut = {
            r["__node"]: r["__sum"]
            for r in tied.where(F.col("__tie") == _pick(node, tie)).groupBy("__node").agg(F.sum("__bytes").alias("__sum")).collect()
        }
        # The last group left of the cut stays left if that comes nearer to the share.
        keep = {n: tie[n] if 2 * (rest[n] - passed[n]) >= at_cut.get(n, 0) else tie[n] - 1 for n in live}
        goes_left = (key < _pick(node, value)) | ((key == _pick(node, value)) & (F.col("__tie") <= _pick(node, keep)))
        split = F.when(goes_left, node * 2 + 1).otherwise(node * 2 + 2)
        groups = checkpoint(groups.withColumn("__node", F.when(node.isin(live), split).otherwise(node) if live else node))
        done = {}
        for n, (first, k) in todo.items():
            if k > 1:
                done[2 * n + 1] = (first, k // 2)
                done[2 * n + 2] = (first + k // 2, k - k // 2)
            else:
                done[n] = (first, k)
        todo = done
    shard = _pick(F.col("__node"), {n: first for n, (first, _) in todo.items()})
    return groups.select("__group", shard.cast("int").alias("shard"))


def shard(docs: DataFrame, n_shards: int = SHARDS, columns: Sequence[str] | None = None) -> DataFrame:
    """``docs``, or these columns of it, packed in ``__row`` with size, text_crc32, shard and slot.

    Slots count from 0 without gaps in each shard. A null text is empty and has size 1; equal
    texts, null and empty among them, share a shard whatever their other columns say; a group
    larger than a shard makes that shard larger; repeated rows get slots of their own; with fewer
    groups than shards some shards stay empty; an empty table stays empty.
    """
    rows = docs.select(
        F.struct(*(columns or docs.columns)).alias("__row"),
        F.xxhash64("doc_id").alias("__id"),
        F.md5(text_of().cast("binary")).alias("__group"),
        (F.octet_length(text_of()).cast("long") + 1).alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
    )
    placed = rows.join(shard_groups(docs, n_shards), "__group")
    celled = placed.withColumn("__cell", F.pmod("__id", F.lit(CELLS)))
    return number_in_cells(celled, ["shard"], ["__id", "__group"], "slot").drop("__group", "__id")


def with_shards(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """``docs`` with the columns shard and slot, which replace given ones of these names."""
    own = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    return shard(docs, n_shards, own).select("__row.*", "shard", "slot")


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS) -> None:
    """Write each shard to a folder of its own, rows in slot order within a file."""
    out = with_shards(docs, n_shards)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_table(docs: DataFrame) -> DataFrame:
    """Per document its size, text checksum, shard and slot under the law of equal bytes."""
    return shard(docs, columns=("doc_id",)).select(
        "__row.doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
