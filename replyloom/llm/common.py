"""Column helpers that several operators share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed by the contracts: what separates words, as a Java character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
# Cells into which a hot key is cut before its rows are numbered.
CELLS = 1024


def carry_along(module: str) -> None:
    """Send the functions of ``module`` to the executors with each job, so none needs this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE + "+"), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def digest_order(seed: int, key: Column) -> Column:
    """Reproducible random order as 32 hex digits; a null key counts as the word null."""
    text = F.coalesce(key.cast("string"), F.lit("null"))
    return F.md5(F.concat(F.lit(f"{seed}:"), text))


def number_in_cells(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Numbers 0.. without gaps per ``keys``, ordered by ``__cell`` and then ``order``.

    ``df`` has a column ``__cell`` which cuts each key into bounded parts. A part is numbered
    by itself; its rows then move up by the sizes of the key's earlier parts, so a key with a
    third of all rows is never sorted in one task. Tied rows take their numbers in any order.
    """
    cell = [*keys, "__cell"]
    sizes = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*cell, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    place = Window.partitionBy(*cell).orderBy(*order)
    placed = df.withColumn("__in_cell", F.row_number().over(place) - 1)
    return placed.join(offsets, cell).withColumn(name, F.col("__offset") + F.col("__in_cell")).drop(
        "__offset", "__in_cell", "__cell"
    )
