"""Reading and writing: CSV landing, Parquet tables, metric reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from replyloom import session
from replyloom.operators.rows import number_rows
from replyloom.sources import schemas

BOM = "\ufeff"
# Column that takes the text of a record which does not fit the schema.
REJECTED = "__rejected"


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Typed CSV scan: quoted newlines, doubled quotes, optional byte order mark.

    Boolean columns accept true/false in any case; anything else is NULL, never true.
    """
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("columnNameOfCorruptRecord", REJECTED)
        .csv(path)
    )


def land_csv(
    spark: SparkSession,
    source: str,
    target: str,
    schema: StructType = schemas.MESSAGES,
    rejects: str | None = None,
) -> DataFrame:
    """Read a CSV dump once, add the row ordinal ``src_ord`` and keep it as Parquet.

    A multi-line CSV file cannot be split, so a large dump should come as many files: each
    is one unit of parallel work. Rows are numbered from 0 by file name and place in the file,
    however the scan packs the files; the numbers are stable once written.

    With ``rejects`` a record that does not fit the schema (a value of another type, too few or
    too many fields) does not land: that table gets its file, its place there (from 0) and
    its text. Without, such values are NULL.
    """
    wide = schema if rejects is None else StructType([*schema.fields, StructField(REJECTED, StringType())])
    raw = read_csv(spark, source, wide).withColumns(
        {"__file": F.input_file_name(), "__at": F.monotonically_increasing_id()}
    )
    if rejects is not None:
        raw = session.checkpoint(raw)
        bad = raw.where(F.col(REJECTED).isNotNull())
        # A file is read by one task, in which the ids have no gaps.
        begins = raw.groupBy("__file").agg(F.min("__at").alias("__begin"))
        write_table(
            bad.join(begins, "__file").select(
                F.col("__file").alias("file"), (F.col("__at") - F.col("__begin")).alias("place"), F.col(REJECTED).alias("record")
            ),
            rejects,
        )
        raw = raw.where(F.col(REJECTED).isNull()).drop(REJECTED)
    numbered = number_rows(raw, ["__file", "__at"], "__n")
    landed = numbered.withColumn("src_ord", F.col("__n") - 1).drop("__n", "__file", "__at")
    landed.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Parquet scan; a given schema replaces the footer's."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def write_table(df: DataFrame, path: str, compression: str = "snappy") -> None:
    df.write.mode("overwrite").option("compression", compression).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a new folder below the shared one and read from there; texts take less room so."""
    path = session.fresh_dir(df.sparkSession, name)
    write_table(df, path, "zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV sink with header; ``bom`` starts each file with a byte order mark."""
    if bom:
        df = df.withColumnRenamed(df.columns[0], BOM + df.columns[0])
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metric report sink: the long table (metric, label, value)."""
    schemas.require_columns(metrics, ["metric", "label", "value"])
    write_table(metrics.select("metric", "label", "value").repartition(1), path)
