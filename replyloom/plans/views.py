"""The given tables seen as messages, pairs, labelled texts and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replyloom import session
from replyloom.functions.lexicon import Lexicon, weak_label
from replyloom.operators.pairing import reply_pairs, unanswered_messages

BRAND = "Assistant"
LANGUAGES = ["de", "en", "es", "fr"]

# Function words per language, matched as substrings like any lexicon.
LANGUAGE_LEXICON = Lexicon.of({
    "de": [" der", "die ", "und ", " ein", "von ", " zu"],
    "en": ["the ", " and", " of ", "with", "that", "ing"],
    "es": [" el ", "los ", "que ", "ción", " una", "por"],
    "fr": ["les ", "eau", " dans", "elle", " avec", "é"],
})
# Words that stand for risks in the invented prose.
PROSE_RISKS = Lexicon.of({
    "security_or_account_risk": ["hack", "license", "password"],
    "legal_or_high_risk": ["sue", "court"],
})
HIGH_RISK_LANGUAGES = ["es"]
# Labels (three numbers each, some 100 MB in all) up to which the documents stay where they are.
MARK_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_messages(conversations: DataFrame) -> DataFrame:
    """Turns as messages: users write inbound, the assistant is the brand, a turn answers
    the one before it, the direction of a system turn is unknown."""
    tweet_id = F.col("conv_id") * 1000 + F.col("turn")
    return conversations.select(
        tweet_id.alias("tweet_id"),
        F.col("role").alias("author_id"),
        F.when(F.col("role") == "system", F.lit(None)).otherwise(F.col("role") == "user").alias("inbound"),
        F.lit(None).cast("string").alias("response_tweet_id"),
        F.when(F.col("turn") > 0, (tweet_id - 1).cast("string")).alias("in_response_to_tweet_id"),
        "text",
        F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("created_at"),
        tweet_id.alias("src_ord"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_messages(table(spark, sf_dir, "conversations"))


def pairs(spark: SparkSession, sf_dir: str, digest: bool = False) -> DataFrame:
    return reply_pairs(messages(spark, sf_dir), BRAND, digest=digest)


def open_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inbound messages nobody answered: query_id, customer_text."""
    waiting = unanswered_messages(messages(spark, sf_dir), BRAND)
    return waiting.select(F.col("tweet_id").alias("query_id"), F.col("text").alias("customer_text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as labelled texts; the source stands for the reply."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("src_ord"),
        F.col("doc_id").alias("sample_id"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("customer_tweet_id"),
        F.col("source").alias("brand_tweet_id"),
        F.col("text").alias("customer_text"),
        F.col("source").alias("brand_response"),
        F.col("lang").alias("final_intent"),
        F.lit("").alias("label_confidence"),
        F.lit("").alias("label_notes"),
    )


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("customer_text")
    )


def classified(df: DataFrame) -> DataFrame:
    """Weak labels in the place of model output."""
    labelled = weak_label(df, "customer_text", LANGUAGE_LEXICON, fallback="none")
    return labelled.select(
        *df.columns,
        F.col("suggested_intent").alias("predicted_intent"),
        F.col("suggestion_share").alias("intent_confidence"),
    )


def labelled_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages with their weak label as final_intent."""
    texts = messages(spark, sf_dir).select("src_ord", F.col("text").alias("customer_text"))
    return classified(texts).select("src_ord", "customer_text", F.col("predicted_intent").alias("final_intent"))


def gold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with quality labels: language as gold intent, unfit ones must escalate."""
    marks = session.broadcast_if_small(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), MARK_ROWS)
    gold = documents(spark, sf_dir).join(marks, F.col("src_ord") == F.col("doc_id"))
    reason = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "quality")
    return gold.select(
        "src_ord",
        "sample_id",
        "customer_text",
        F.col("final_intent").alias("gold_intent"),
        ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("gold_escalate"),
        F.coalesce(reason, F.lit("not_applicable")).alias("gold_escalation_reason"),
    )


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored messages for the threshold sweep."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("sample_id"),
        (F.col("value") / 500.0).alias("intent_confidence"),
        (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("retrieval_similarity"),
        (F.col("event_type") == "signup").alias("always_escalate"),
        (F.col("event_type") == "error").alias("gold_escalate"),
    )


def scored_events_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored events of which some lack the confidence, the similarity or both."""
    return scored_events(spark, sf_dir).withColumns(
        {
            "intent_confidence": F.when(F.col("sample_id") % 7 != 0, F.col("intent_confidence")),
            "retrieval_similarity": F.when(F.col("sample_id") % 5 != 0, F.col("retrieval_similarity")),
        }
    )
