"""The triage decision on a stream of message files."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

Transform = Callable[[DataFrame], DataFrame]


def read_messages(
    spark: SparkSession, path: str, schema: StructType, max_files: int | None = None
) -> DataFrame:
    """Stream of new Parquet files below ``path``."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def start_triage(stream: DataFrame, decide: Transform, target: str, state: str) -> StreamingQuery:
    """Run ``decide`` on every micro-batch and keep its rows below ``target``.

    The decision of a message depends on that message and the fixed index only, so there is
    no state and no watermark. Ranking inside ``decide`` is a batch operation, hence
    foreachBatch. Each batch overwrites its own folder: a batch that is repeated after a
    failure leaves the same rows once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        decide(batch).write.mode("overwrite").parquet(os.path.join(target, f"batch={batch_id}"))

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )


def read_decisions(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop("batch")


def stream_triage(
    spark: SparkSession,
    path: str,
    schema: StructType,
    decide: Transform,
    target: str,
    state: str,
    max_files: int | None = None,
) -> DataFrame:
    """Process every file available now and return all decisions kept so far.

    If no batch has ever run, an empty part with the columns of a decision is laid down, so a
    stream without files reads as no decisions, and an unreadable target stays an error.
    """
    query = start_triage(read_messages(spark, path, schema, max_files), decide, target, state)
    query.awaitTermination()
    place = spark._jvm.org.apache.hadoop.fs.Path(target)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        decide(spark.createDataFrame([], schema)).write.parquet(os.path.join(target, "batch=-1"))
    return read_decisions(spark, target)


def once_each(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """``stream`` without further copies of a message, as replayed files bring them.

    The ids seen stay in the query's state until the watermark, ``delay`` behind the latest
    ``time``, has passed them; a copy that comes later than that counts as new.
    """
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
