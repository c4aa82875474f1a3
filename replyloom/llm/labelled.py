"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom.llm.common import digest_order
from replyloom.operators.rows import exact_n
from replyloom.session import checkpoint


def fold(folds: int) -> Column:
    """Remainder of the checksum of the doc_id as text; a null id falls in no fold."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, label: str, seen: Column, per_class: int, seed: int) -> DataFrame:
    """(doc_id, text, label, weight) of at most ``per_class`` documents of each class 0 and 1.

    ``seen`` says which rows of ``labels`` may be learned from. The weight makes up for the
    share of its class that was drawn. Ids are drawn first and broadcast, being bounded, so the
    texts of all other documents stay where they are.
    """
    usable = labels.where(seen & F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ordered = usable.withColumn("order", digest_order(seed, F.col("doc_id")))
    drawn = checkpoint(exact_n(ordered, ["label"], per_class, ["order"]).select("doc_id", "label"))
    weight = F.lit(1.0)
    for kind, n in counts.items():
        weight = F.when(F.col("label") == kind, F.lit(max(n / per_class, 1.0))).otherwise(weight)
    return docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").withColumn("weight", weight)
