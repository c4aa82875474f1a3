"""Mixing sources to target weights by systematic sampling.

Sources in code-point order, null last, weigh 1, 2, 3, 1, ... and share the words of all
documents. No target exceeds three times its source's words; the excess is shared again by
weight. Within a source each document expects target / words copies. Documents are lined up,
their expected copies are summed from the start, one random offset is added, and a document
comes out once for each whole number that its stretch of the line crosses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.llm.common import CELLS, digest_order, number_in_cells, text_of, word_count
from replyloom.operators.rows import number_rows
from replyloom.session import checkpoint

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
SEED = 20


def source_targets(sized: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from rows with ``source`` and ``size``.

    A round gives every source that is still open its share of what is left by weight and
    closes those above their cap. Only sums over sources come to the driver.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    keyed = sizes.withColumn("__null", F.col("source").isNull().cast("int"))
    placed = number_rows(keyed, ["__null", "source"], "__place")
    kinds = F.array(*[F.lit(w) for w in WEIGHTS])
    weighed = checkpoint(
        placed.select(
            "source",
            "source_size",
            (F.col("source_size") * max_copies).alias("__cap"),
            F.get(kinds, ((F.col("__place") - 1) % len(WEIGHTS)).cast("int")).alias("__weight"),
        )
    )
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    # A closed source is one whose cap lies below its share at some round; shares only grow.
    left, weight = total, weighed.agg(F.sum("__weight")).first()[0] or 1
    while True:
        share = F.lit(float(left)) * F.col("__weight") / F.lit(float(weight))
        capped = F.col("__cap") < share
        row = weighed.agg(
            F.sum(F.when(capped, F.col("__cap"))).alias("cap"),
            F.sum(F.when(~capped, F.col("__weight"))).alias("weight"),
        ).first()
        next_left, next_weight = total - (row["cap"] or 0), row["weight"] or 0
        if next_weight in (0, weight):
            break
        left, weight = next_left, next_weight
    target = F.when(capped, F.col("__cap").cast("double")).otherwise(share)
    return weighed.select("source", "source_size", target.alias("target"))


def copies(
    docs: DataFrame, seed: int = SEED, max_copies: int = MAX_COPIES, columns: Sequence[str] | None = None
) -> DataFrame:
    """``docs``, or these columns of it, packed in ``__row`` with size, source_size, target, copies and taken.

    The line of a source is ordered by size class, so that a long document stands among long
    ones and its rounding is made up by the next; within a class the order is random. The place
    in the line is counted in cells, hence a source with a third of all rows is never sorted in
    one task. A null or empty text has size 0, a null source is a source of its own, tied and
    repeated rows each hold a place, and an empty table stays empty. Reruns agree.
    """
    sized = docs.select(
        F.struct(*(columns or docs.columns)).alias("__row"),
        "source",
        word_count(text_of()).alias("size"),
        digest_order(seed, F.col("doc_id")).alias("__order"),
        F.xxhash64("doc_id", "text").alias("__tie"),
    )
    targets = source_targets(sized.select("source", "size"), max_copies)
    # Size class: the leading three bits of the size and how many follow. Parts by order digits.
    bits = F.length(F.bin("size"))
    lead = F.rpad(F.substring(F.bin("size"), 1, 3), 3, "0")
    part = F.conv(F.substring("__order", 1, 5), 16, 10).cast("int") % CELLS
    lined = sized.withColumn("__cell", F.concat(F.lpad(bits.cast("string"), 2, "0"), lead, F.lpad(part.cast("string"), 4, "0")))
    slim = lined.select(
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("__key"), *lined.columns
    )
    placed = number_in_cells(slim, ["__key"], ["__order", "__tie"], "__place")
    joined = placed.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # 20 bits and a half: exact in a double up to 2^32 copies.
    offset = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "__key")), 1, 5), 16, 10).cast("long") + 0.5) / F.lit(
        float(1 << 20)
    )
    crossed = F.floor(offset + (F.col("__place") + 1) * F.col("__each")) - F.floor(offset + F.col("__place") * F.col("__each"))
    return (
        joined.withColumn("__each", each)
        .withColumn("copies", F.least(crossed, F.lit(max_copies)).cast("long"))
        .select("__row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as many times as it is taken, columns unchanged."""
    counted = copies(docs, seed).where(F.col("copies") > 0)
    times = F.sequence(F.lit(1), F.col("copies").cast("int"))
    return counted.select("__row", F.explode(times).alias("__copy")).select("__row.*")


def mix_table(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per document its size, its source's size and target, and the words taken from it."""
    counted = copies(docs, seed, columns=("doc_id",))
    return counted.select("__row.doc_id", "size", "source_size", "target", "taken", "copies")
