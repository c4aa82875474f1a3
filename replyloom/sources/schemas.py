"""Explicit schemas of every table and the column contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

TYPES = {
    "string": StringType(),
    "int": IntegerType(),
    "long": LongType(),
    "double": DoubleType(),
    "boolean": BooleanType(),
}


def _schema(columns: str) -> StructType:
    """Schema from ``name type, ...``; needs no running session."""
    parts = (column.split() for column in columns.split(", "))
    return StructType([StructField(name, TYPES[kind]) for name, kind in parts])


MESSAGES = _schema(
    "tweet_id long, author_id string, inbound boolean, response_tweet_id string, "
    "in_response_to_tweet_id string, text string, created_at string"
)

PAIRS = _schema(
    "customer_tweet_id string, brand_tweet_id string, customer_author_id string, brand string, "
    "customer_created_at string, brand_created_at string, customer_text string, "
    "brand_response string"
)

INTENT_SAMPLE = _schema(
    "sample_id int, customer_tweet_id string, brand_tweet_id string, customer_text string, "
    "brand_response string, candidate_intent string, final_intent string, "
    "label_confidence string, label_notes string"
)

LABELLED = _schema(
    "sample_id int, customer_tweet_id string, brand_tweet_id string, customer_text string, "
    "brand_response string, final_intent string, label_confidence string, label_notes string"
)

GOLDEN = _schema(
    "sample_id int, customer_tweet_id string, brand_tweet_id string, customer_text string, "
    "brand_response string, gold_intent string, gold_escalate boolean, "
    "gold_escalation_reason string, gold_label_confidence string, gold_label_notes string, "
    "human_review_status string"
)

HUMAN_REVIEW = _schema(
    "sample_id int, customer_text string, brand_response string, gold_intent string, "
    "gold_escalate string, gold_escalation_reason string, review_notes string, "
    "review_status string"
)

EVALUATION = _schema(
    "sample_id int, customer_text string, gold_intent string, gold_escalate boolean, "
    "gold_escalation_reason string, predicted_intent string, intent_confidence double, "
    "retrieved_customer_text string, retrieved_brand_response string, "
    "retrieval_similarity double, predicted_escalate boolean, escalation_reason string, "
    "draft_reply string, intent_correct boolean, escalation_correct boolean"
)

THRESHOLDS = _schema(
    "intent_confidence_threshold double, retrieval_similarity_threshold double, "
    "precision double, recall double, f1 double, escalation_rate double"
)

JUDGE_SCORES = _schema(
    "sample_id long, grounded int, relevant int, helpful int, unsupported_claim int, "
    "overall int, reason string"
)


def all_strings(schema: StructType) -> StructType:
    """The same columns, every one a string."""
    return StructType([StructField(name, StringType()) for name in schema.names])


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Raise before any job runs when a required column is absent."""
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"Missing columns: {missing}")
    return df


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Raise when the table is empty; looks at one row only."""
    if df.isEmpty():
        raise RuntimeError(message)
    return df
