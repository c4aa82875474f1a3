"""Row-order operators: keep-first, keep-last, exact samples, numbering, order statistics.

None of them sorts a whole table, or a whole group of unbounded size, in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from replyloom import session
from replyloom.session import checkpoint

# Parts in which a bounded but long prefix is ordered before the final merge.
SALTS = 32


def _ranked(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column], n: int) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).where(F.col("__rank") <= n)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One whole row per key, the first in ``order``.

    The rank filter runs per task before the shuffle, so a key that holds a large share
    of all rows sends at most one row per task.
    """
    return _ranked(df, keys, order, 1).drop("__rank")


def keep_first_wide(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``keep_first`` of long texts, of which the most stand alone.

    ``df`` is read once for the keys that several rows have, by digest and ``order`` only, and once for
    the rows, which stay where they are. Beyond a broadcast of such keys, if two rows of a key
    tie, or if too few partitions hold rows to keep half the cores at work, the whole rows are shuffled.
    """
    digest = F.md5(F.concat_ws(":", *[F.coalesce(F.md5(F.col(k).cast("string")), F.lit("-")) for k in keys]))
    marked = df.withColumn("__digest", digest)
    seen = Observation()
    narrow = marked.select("__digest", order, F.spark_partition_id().alias("__part"))
    narrow = narrow.observe(seen, F.approx_count_distinct("__part").alias("parts"))
    placed = narrow.groupBy("__digest", order).agg(F.count(F.lit(1)).alias("__n"))
    first = F.min(F.struct(F.col(order).alias("at"), "__n")).alias("__first")
    repeated = placed.groupBy("__digest").agg(first, F.sum("__n").alias("__rows")).where(F.col("__rows") > 1)
    repeated, path = repeated.select("__digest", "__first"), session.fresh_dir(df.sparkSession, "repeated")
    repeated.write.parquet(path)
    repeated = df.sparkSession.read.schema(repeated.schema).parquet(path)
    parts = observed(seen, "parts")
    idle = 2 * parts < df.sparkSession.sparkContext.defaultParallelism
    n, ties = repeated.agg(F.count(F.lit(1)), F.max("__first.__n")).first()
    if idle or n > session.BROADCAST_ROWS or (ties or 0) > 1:
        return keep_first(df, keys, [F.col(order)])
    joined = marked.join(F.broadcast(repeated), "__digest", "left")
    return joined.where(F.col("__first").isNull() | F.col("__first.at").eqNullSafe(F.col(order))).select(*df.columns)


def observed(seen: Observation, name: str) -> int:
    """A number that a finished write has counted."""
    try:
        return seen.get[name] or 0
    except Py4JJavaError:  # adaptive execution drops the observation of an empty input
        return 0


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One whole row per key, the last in ``order`` (column names)."""
    return keep_first(df, keys, [F.col(c).desc() for c in order])


def hash_order(seed: int | Column, key: Column) -> Column:
    """Reproducible random order: md5 of ``seed:key`` as 32 hex digits."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws(":", seed.cast("string"), key.cast("string")))


def exact_n(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[str]) -> DataFrame:
    """The first ``n`` rows per key, ranked within salted parts first.

    A key is spread over all shuffle partitions. Up to the engine's group limit (1000) each
    task also drops rows beyond ``n`` before the shuffle.
    """
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    by_name = [F.col(c) for c in order]
    parts = _ranked(spread, [*keys, "__salt"], by_name, n)
    return _ranked(parts, keys, by_name, n).drop("__salt", "__rank")


def number_rows(df: DataFrame, order: Sequence[str], name: str = "sample_id") -> DataFrame:
    """Sequential numbers 1..n in ``order`` over a table of any size.

    A range shuffle sorts the table in parts and a checkpoint fixes them; a row's number
    is its place in its part plus the sizes of the parts before it.
    """
    parts = checkpoint(df.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = parts.withColumn("__part", F.spark_partition_id()).withColumn(
        "__place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    )
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition, hence a small window and a small broadcast.
    offsets = (
        parts.groupBy(F.spark_partition_id().alias("__part"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    )
    return placed.join(F.broadcast(offsets), "__part").select(
        (F.col("__offset") + F.col("__place") + 1).alias(name), *df.columns
    )


def top_n(df: DataFrame, n: int, order: Sequence[Column], rank: str | None = None) -> DataFrame:
    """The first ``n`` rows overall (a bounded report), optionally numbered."""
    out = df.orderBy(*order).limit(n)
    if rank:
        out = out.select(F.row_number().over(Window.orderBy(*order)).cast("long").alias(rank), "*")
    return out


def hash_cuts(df: DataFrame, label: str, key: str, seed: int, percents: Sequence[int]) -> DataFrame:
    """Per label the hash position that ends each leading share of its rows.

    Returns (label, cut, at_hash, at_key): the first ``round(p% of n)`` rows of a label in
    hash order are those with (hash, key) <= (at_hash, at_key). The rank is found from
    counts per hash prefix; only the rows of the one prefix that holds a cut are ranked,
    about 1/65536 of a label. A cut of zero rows yields no line.
    """
    hashed = df.select(label, F.col(key).alias("__key"), hash_order(seed, F.col(key)).alias("__hash"))
    hashed = hashed.withColumn("__prefix", F.substring("__hash", 1, 4))
    counts = hashed.groupBy(label, "__prefix").agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(label)
    upto = whole.orderBy("__prefix").rowsBetween(Window.unboundedPreceding, 0)
    cuts = (
        counts.select(
            label,
            "__prefix",
            "__n",
            F.sum("__n").over(upto).alias("__upto"),
            F.sum("__n").over(whole).alias("__total"),
        )
        .withColumn("__percent", F.explode(F.array(*[F.lit(p) for p in percents])))
        .withColumn("__target", F.expr("(__total * __percent + 50) div 100"))
        .where(
            (F.col("__target") > F.col("__upto") - F.col("__n"))
            & (F.col("__target") <= F.col("__upto"))
        )
        .select(
            F.col(label),
            "__prefix",
            F.col("__percent").alias("cut"),
            (F.col("__target") - F.col("__upto") + F.col("__n")).alias("__within"),
        )
    )
    place = Window.partitionBy(label, "cut").orderBy("__hash", "__key")
    # Lines of ``cuts`` = labels x percents, bounded by the taxonomy.
    return (
        hashed.join(F.broadcast(cuts), [label, "__prefix"])
        .withColumn("__place", F.row_number().over(place))
        .where(F.col("__place") == F.col("__within"))
        .select(label, "cut", F.col("__hash").alias("at_hash"), F.col("__key").alias("at_key"))
    )


UNIT_BINS = 4096


def unit_median(df: DataFrame, value: str) -> DataFrame:
    """Exact median of values in [0, 1] as one row ``median``.

    Counts per bin locate the middle; only the distinct values of the one or two middle
    bins are ordered. Equal values are counted before anything is ordered.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(F.col(value).alias("__v"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__bin", F.floor(F.col("__v") * UNIT_BINS))
    )
    upto = Window.orderBy("__bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    # At most UNIT_BINS + 1 lines.
    bins = (
        counted.groupBy("__bin")
        .agg(F.sum("__n").alias("__n"))
        .select(
            "__bin",
            (F.sum("__n").over(upto) - F.col("__n")).alias("__before"),
            F.sum("__n").over(upto).alias("__upto"),
            F.sum("__n").over(whole).alias("__total"),
        )
        .withColumn("__rank", F.explode(F.expr("array((__total + 1) div 2, __total div 2 + 1)")))
        .where((F.col("__before") < F.col("__rank")) & (F.col("__rank") <= F.col("__upto")))
        .withColumn("__which", F.expr("IF(__rank = (__total + 1) div 2, 'low', 'high')"))
        .select("__bin", "__before", "__rank", "__which")
    )
    running = (
        Window.partitionBy("__rank", "__which").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        counted.join(F.broadcast(bins), "__bin")
        .withColumn("__seen", F.col("__before") + F.sum("__n").over(running))
        .where((F.col("__seen") >= F.col("__rank")) & (F.col("__seen") - F.col("__n") < F.col("__rank")))
        .agg(F.avg("__v").alias("median"))
    )
