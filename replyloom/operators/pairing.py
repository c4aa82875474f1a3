"""Customer/support reply pairs and account inspection over a message table."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from replyloom import session
from replyloom.functions.text import blank_if_null, strip
from replyloom.operators.rows import keep_first_wide, keep_last, top_n
from replyloom.sources import artefacts

# Replies from which on a parent's pairs are joined apart, how many such parents there may be,
# and how many candidates the frequency sketch tracks.
HOT_REPLIES = 1_000_000
HOT_PARENTS = 100
SKETCH_ITEMS = 4_000
# Name of the md5 of a pair's customer_text.
DIGEST = "customer_digest"


def _is_account(author: Column, account: str) -> Column:
    return F.lower(F.coalesce(author, F.lit(""))) == account.lower()


def brand_messages(messages: DataFrame, brand: str) -> DataFrame:
    """Messages of one account, compared without case; NULL authors never match."""
    return messages.where(_is_account(F.col("author_id"), brand))


def _parent_ids(messages: DataFrame, brand: str) -> DataFrame:
    parent = F.col("in_response_to_tweet_id")
    return brand_messages(messages, brand).where(parent.isNotNull()).select(parent.alias("parent_id"))


def parent_messages(messages: DataFrame, brand: str) -> DataFrame:
    """Messages the account replied to (left-semi; ids compared as text)."""
    wanted = _parent_ids(messages, brand).distinct()
    return messages.join(
        wanted, messages["tweet_id"].cast("string") == wanted["parent_id"], "left_semi"
    )


def reply_pairs(messages: DataFrame, brand: str, require_inbound_parent: bool = False, digest: bool = False) -> DataFrame:
    """One row per (customer message, reply by ``brand``), with ``src_ord`` of the reply.

    Of several messages with one id the last is the parent; of several replies with one
    (parent, id) the first non-blank one stays. Messages are scanned for the ids of the replies, for the
    replies, which are written down with a sketch of the most frequent parents taken on the way, and for
    the parents that they name. Pairs of a hot parent come from a broadcast of the few hot
    ones, all others from a shuffle in which no parent is hot.

    ``digest`` adds ``customer_digest``, the md5 of customer_text. It is made before the texts are
    shuffled, so whoever reads it alone shuffles no text.
    """
    replies = (
        brand_messages(messages, brand)
        .where(F.col("in_response_to_tweet_id").isNotNull())
        .select(
            F.col("in_response_to_tweet_id").alias("customer_tweet_id"),
            F.col("tweet_id").cast("string").alias("brand_tweet_id"),
            F.lit(brand).alias("brand"),
            F.col("created_at").alias("brand_created_at"),
            strip(blank_if_null(F.col("text"))).alias("brand_response"),
            "src_ord",
        )
        .where(F.col("brand_response") != "")
    )
    replies = keep_first_wide(replies, ["customer_tweet_id", "brand_tweet_id"], "src_ord")
    replies, hot = _with_hot_parents(replies)
    # Ids of stored replies; while a broadcast holds them, only texts of parents are shuffled.
    wanted = session.broadcast_if_small(replies.select("customer_tweet_id").distinct())
    text = strip(blank_if_null(F.col("text")))
    parents = messages.select(
        F.col("tweet_id").cast("string").alias("customer_tweet_id"),
        F.col("author_id").alias("customer_author_id"),
        F.col("created_at").alias("customer_created_at"),
        text.alias("customer_text"),
        F.md5(text).alias(DIGEST),
        (text != "").alias("__filled"),
        F.col("inbound").alias("__inbound"),
        F.col("src_ord").alias("__ord"),
    ).join(wanted, "customer_tweet_id", "left_semi")
    parents = keep_last(parents, ["customer_tweet_id"], ["__ord"]).where("__filled")
    if require_inbound_parent:
        parents = parents.where(F.col("__inbound"))
    if hot:
        parents, is_hot = session.checkpoint(parents), F.col("customer_tweet_id").isin(hot)
        few = F.broadcast(parents.where(is_hot))  # at most HOT_PARENTS messages
        joined = replies.where(~is_hot).join(parents.where(~is_hot), "customer_tweet_id").unionByName(
            replies.where(is_hot).join(few, "customer_tweet_id")
        )
    else:
        joined = replies.join(parents, "customer_tweet_id")
    return joined.select(
        "customer_tweet_id",
        "brand_tweet_id",
        "customer_author_id",
        "brand",
        "customer_created_at",
        "brand_created_at",
        "customer_text",
        "brand_response",
        "src_ord",
        *([DIGEST] if digest else []),
    )


def _with_hot_parents(replies: DataFrame) -> tuple[DataFrame, list[str]]:
    """``replies`` written down, and the parents with about HOT_REPLIES replies or more.

    The sketch is an aggregate that merges from task to task while the rows are written. Its
    counts may be off, which changes how a parent's pairs are joined, never which pairs there are.
    """
    spark, seen = replies.sparkSession, Observation()
    path = session.fresh_dir(spark, "replies")
    sketch = F.expr(f"approx_top_k(customer_tweet_id, {HOT_PARENTS}, {SKETCH_ITEMS})")
    replies.observe(seen, sketch.alias("top")).write.option("compression", "zstd").parquet(path)
    hot = [r["item"] for r in seen.get["top"] or [] if r["count"] >= HOT_REPLIES]
    return spark.read.schema(replies.schema).parquet(path), hot


def extract_pairs(messages: DataFrame, brand: str, root: str) -> int:
    """The extraction job: publish the reply pairs as a new version below ``root``; their number.

    The rows are counted by the write itself. Without any pair the job raises and publishes
    nothing, so the last good version stays the current one.
    """
    seen = Observation()

    def write(folder: str) -> None:
        pairs = reply_pairs(messages, brand).observe(seen, F.count(F.lit(1)).alias("n"))
        pairs.write.parquet(os.path.join(folder, "pairs"))
        if not seen.get["n"]:
            raise RuntimeError(f"no pairs of {brand}")

    artefacts.publish(messages.sparkSession, root, write)
    return seen.get["n"]


def read_pairs(spark: SparkSession, root: str) -> DataFrame:
    """The newest extracted pairs."""
    return spark.read.parquet(os.path.join(artefacts.current(spark, root), "pairs"))


def unanswered_messages(messages: DataFrame, brand: str) -> DataFrame:
    """Inbound messages without a reply by ``brand``: the work queue of the triage."""
    answered = session.broadcast_if_small(session.checkpoint(_parent_ids(messages, brand).distinct()))
    return messages.where(F.col("inbound")).join(
        answered, messages["tweet_id"].cast("string") == answered["parent_id"], "left_anti"
    )


def inbound_counts(messages: DataFrame) -> DataFrame:
    """Total, inbound and outbound messages; a NULL flag counts as neither."""
    return messages.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("inbound")).alias("inbound"),
        F.count_if(~F.col("inbound")).alias("outbound"),
    )


def top_accounts(messages: DataFrame, n: int = 30) -> DataFrame:
    """The ``n`` accounts with the most outbound messages, ranked; ties by name."""
    counts = (
        messages.where(~F.col("inbound") & F.col("author_id").isNotNull())
        .groupBy("author_id")
        .agg(F.count(F.lit(1)).alias("messages"))
    )
    return top_n(counts, n, [F.col("messages").desc(), F.col("author_id")], rank="rank")


def account_summary(messages: DataFrame, n: int = 30) -> tuple[DataFrame, DataFrame]:
    """Message counts and the top accounts."""
    return inbound_counts(messages), top_accounts(messages, n)


def pair_counts(messages: DataFrame, brand: str) -> DataFrame:
    """Stage counts of the extraction as (stage, n)."""
    own = brand_messages(messages, brand).agg(
        F.count(F.lit(1)).alias("brand_messages"),
        F.count_distinct("tweet_id").alias("brand_ids"),
        F.count_distinct("in_response_to_tweet_id").alias("parent_ids"),
    )
    stages = own.unpivot([], ["brand_messages", "brand_ids", "parent_ids"], "stage", "n")
    total = messages.agg(F.count(F.lit(1)).alias("n")).select(F.lit("messages").alias("stage"), "n")
    pairs = reply_pairs(messages, brand).agg(F.count(F.lit(1)).alias("n"))
    return total.unionByName(stages).unionByName(pairs.select(F.lit("pairs").alias("stage"), "n"))
