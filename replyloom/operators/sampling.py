"""Labelling sample, golden set, review sheet and stratified split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from replyloom import session
from replyloom.functions.lexicon import INTENTS
from replyloom.functions.text import blank_if_null, is_blank, normalize_text, strip
from replyloom.operators.rows import exact_n, hash_cuts, hash_order, keep_first, keep_first_wide, number_rows
from replyloom.sources.schemas import require_columns
from replyloom.sources.tables import stored

# Upper text lengths of the first two strata, rows per stratum, rows in all.
LENGTH_EDGES = (80, 200)
STRATUM_CAPS = (170, 170, 160)
SAMPLE_SIZE = 500
MIN_LENGTH = 10


def pair_key() -> Column:
    return F.concat_ws("-", "customer_tweet_id", "brand_tweet_id")


def _numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Sequential numbers over an output whose size a parameter bounds."""
    number = F.row_number().over(Window.orderBy(*order)).cast("long")
    return df.withColumn(name, number)


def intent_sample(
    pairs: DataFrame,
    caps: Sequence[int] = STRATUM_CAPS,
    total: int = SAMPLE_SIZE,
    seed: int = 42,
) -> DataFrame:
    """Sheet for labelling: exact-size random samples of short, medium and long messages.

    Each stratum is drawn with its own seed; the sheet is shuffled and numbered.
    """
    short, medium = LENGTH_EDGES
    texts = pairs.where(F.col("customer_text").isNotNull() & F.col("brand_response").isNotNull())
    texts = texts.withColumns(
        {"customer_text": strip(F.col("customer_text")), "brand_response": strip(F.col("brand_response"))}
    ).where((F.length("customer_text") >= MIN_LENGTH) & (F.length("brand_response") >= MIN_LENGTH))
    texts = texts.withColumn("__normalized", normalize_text(F.col("customer_text"))).where(
        F.length("__normalized") >= MIN_LENGTH
    )
    pool = keep_first(texts, ["__normalized"], [F.col("src_ord")]).withColumn(
        "__stratum",
        F.when(F.length("customer_text") <= short, 0)
        .when(F.length("customer_text") <= medium, 1)
        .otherwise(2),
    )
    pool = pool.withColumn("__key", pair_key()).withColumn(
        "__order", hash_order(F.lit(seed) + F.col("__stratum"), F.col("__key"))
    )
    cap = F.get(F.array(*[F.lit(c) for c in caps]), F.col("__stratum"))
    drawn = exact_n(pool, ["__stratum"], max(caps), ["__order", "__key"])
    place = Window.partitionBy("__stratum").orderBy("__order", "__key")
    drawn = drawn.withColumn("__place", F.row_number().over(place)).where(F.col("__place") <= cap)
    drawn = drawn.withColumn("__shuffle", hash_order(seed, F.col("__key")))
    order = [F.col("__shuffle"), F.col("__key")]
    sheet = _numbered(drawn.orderBy(*order).limit(total), order, "sample_id")
    return sheet.select(
        "sample_id",
        "customer_tweet_id",
        "brand_tweet_id",
        "customer_text",
        "brand_response",
        *[
            F.lit("").alias(name)
            for name in ("candidate_intent", "final_intent", "label_confidence", "label_notes")
        ],
    )


def labelled_rows(df: DataFrame, label: str, text: str, taxonomy: Sequence[str]) -> DataFrame:
    """Rows with a label of the taxonomy and a non-blank text."""
    return df.where(F.col(label).isin(*taxonomy) & ~is_blank(F.col(text)))


def quota_rows(
    df: DataFrame,
    label: str,
    n: int,
    seed: int = 42,
    taxonomy: Sequence[str] = tuple(INTENTS),
    key: str = "sample_id",
    text: str = "customer_text",
) -> DataFrame:
    """``n`` rows: an equal quota per label, topped up at random from the rest.

    The quota is ``max(10, n // labels)``. Adds ``__order``, the random position.
    """
    quota = max(10, n // len(taxonomy))
    pool = labelled_rows(df, label, text, taxonomy).withColumn("__order", hash_order(seed, F.col(key)))
    chosen = exact_n(pool, [label], quota, ["__order", key])
    # At most quota x labels ids, both parameters.
    ids = chosen.select(key)
    rest = pool.join(F.broadcast(ids), key, "left_anti").orderBy("__order", key).limit(n)
    lacking = F.lit(n) - ids.agg(F.count(F.lit(1)).alias("n")).scalar()
    extra = _numbered(rest, [F.col("__order"), F.col(key)], "__place").where(F.col("__place") <= lacking)
    both = chosen.unionByName(extra.drop("__place"))
    return both.orderBy("__order", key).limit(n)


def golden_quota(
    df: DataFrame,
    label: str = "final_intent",
    n: int = 200,
    seed: int = 42,
    taxonomy: Sequence[str] = tuple(INTENTS),
) -> DataFrame:
    """Golden set draft: quota rows with empty gold columns for the reviewers."""
    require_columns(
        df,
        [
            "sample_id",
            "customer_tweet_id",
            "brand_tweet_id",
            "customer_text",
            "brand_response",
            label,
            "label_confidence",
            "label_notes",
        ],
    )
    rows = quota_rows(df, label, n, seed, taxonomy)
    blanks = ("gold_escalate", "gold_escalation_reason", "gold_label_confidence", "gold_label_notes")
    return rows.select(
        "sample_id",
        "customer_tweet_id",
        "brand_tweet_id",
        "customer_text",
        "brand_response",
        F.col(label).alias("gold_intent"),
        *[F.lit("").alias(name) for name in blanks],
        F.lit("pending").alias("human_review_status"),
    )


def review_template(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Review sheet: rows renumbered 1..n in ``order`` with blank answer columns."""
    numbered = number_rows(df.select(*dict.fromkeys([*order, "customer_text", "brand_response"])), order, "__id")
    return numbered.select(
        F.col("__id").alias("sample_id"),
        blank_if_null(F.col("customer_text")).alias("customer_text"),
        blank_if_null(F.col("brand_response")).alias("brand_response"),
        *[
            F.lit("").alias(name)
            for name in ("gold_intent", "gold_escalate", "gold_escalation_reason", "review_notes")
        ],
        F.lit("pending").alias("review_status"),
    )


def stratified_split(
    df: DataFrame,
    label: str = "final_intent",
    seed: int = 42,
    exclude: DataFrame | None = None,
    taxonomy: Sequence[str] = tuple(INTENTS),
    key: str = "src_ord",
    text: str = "customer_text",
    percents: tuple[int, int] = (70, 85),
) -> DataFrame:
    """Add ``split``: train, validation or test, 70/15/15 within each label.

    Rows of unknown labels, blank texts and repeated texts (first by ``key`` stays) drop
    first; ``exclude`` removes rows whose text it holds. The shares are exact, yet rows
    are only compared with two positions per label, so the table is not sorted.
    """
    pool = keep_first_wide(labelled_rows(df, label, text, taxonomy), [text], key)
    if exclude is not None:
        seen = exclude.select(F.md5(strip(blank_if_null(F.col(text)))).alias("__text")).distinct()
        seen = session.broadcast_if_small(session.checkpoint(seen))
        pool = pool.join(seen, F.md5(strip(F.col(text))) == F.col("__text"), "left_anti")
    # Deduplicated once; the passes below read the kept rows, the first of them no text.
    pool = stored(pool, "pool")
    cuts = hash_cuts(pool, label, key, seed, percents)
    ends = cuts.groupBy(label).agg(
        *[
            F.max(F.when(F.col("cut") == p, F.struct("at_hash", "at_key"))).alias(name)
            for p, name in zip(percents, ("__train_end", "__validation_end"))
        ]
    )
    at = F.struct(hash_order(seed, F.col(key)).alias("at_hash"), F.col(key).alias("at_key"))
    # One line per label of the taxonomy.
    placed = pool.join(F.broadcast(ends), label, "left")
    split = (
        F.when(at <= F.col("__train_end"), "train")
        .when(at <= F.col("__validation_end"), "validation")
        .otherwise("test")
    )
    return placed.withColumn("split", split).drop("__train_end", "__validation_end")


def overlap_count(a: DataFrame, b: DataFrame, text: str = "customer_text") -> DataFrame:
    """Distinct stripped texts present in both tables, as one row ``overlap``."""
    left, right = (t.select(strip(blank_if_null(F.col(text))).alias("t")).distinct() for t in (a, b))
    return left.join(right, "t", "left_semi").agg(F.count(F.lit(1)).alias("overlap"))
