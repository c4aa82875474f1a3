"""Lexicons as ordered data and the expressions that match them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replyloom.functions.text import W, blank_if_null, let, normalize_text


@dataclass(frozen=True)
class Lexicon:
    """Categories in priority order, each with its terms."""

    entries: tuple[tuple[str, tuple[str, ...]], ...]

    @classmethod
    def of(cls, mapping: dict[str, list[str]]) -> Lexicon:
        return cls(tuple((name, tuple(terms)) for name, terms in mapping.items()))

    @classmethod
    def from_table(cls, table: DataFrame) -> Lexicon:
        """Build from a (category, priority, term) table; a lexicon is a small list."""
        rows = table.groupBy("category").agg(
            F.min("priority").alias("priority"), F.sort_array(F.collect_set("term")).alias("terms")
        )
        return cls(
            tuple((r.category, tuple(r.terms)) for r in rows.orderBy("priority", "category").collect())
        )

    @property
    def categories(self) -> list[str]:
        return [name for name, _ in self.entries]

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (name, priority, term)
            for priority, (name, terms) in enumerate(self.entries)
            for term in terms
        ]
        return spark.createDataFrame(rows, "category string, priority int, term string")


# The ten intents, in order.
INTENTS = [
    "order_delivery",
    "returns_refunds",
    "payment_billing",
    "account_security",
    "subscription_prime",
    "digital_content",
    "device_technical",
    "product_order_issue",
    "customer_service_complaint",
    "other_non_actionable",
]

# Fixed value: the intent reported for a message without any term, and on a tie.
FALLBACK_INTENT = "other_non_actionable"
AMBIGUOUS = "ambiguous"

# Terms that vote for an intent.
INTENT_LEXICON = Lexicon.of({
    "order_delivery": [
        "delivery", "deliver", "package", "parcel", "shipping", "shipment", "tracking", "arrive",
        "arrival", "late", "delay", "missing order", "not received", "where is my order",
        "courier", "dispatch",
    ],
    "returns_refunds": [
        "return", "refund", "money back", "reimburse", "returned", "replacement",
        "cancel return", "return label",
    ],
    "payment_billing": [
        "payment", "charged", "charge", "billing", "invoice", "card", "credit card",
        "debit card", "price charged", "transaction", "unauthorized purchase",
        "subscription charge",
    ],
    "account_security": [
        "account", "password", "login", "sign in", "security", "hack", "hacked", "fraud",
        "scam", "suspicious", "phishing", "email", "locked", "verification",
    ],
    "subscription_prime": [
        "prime", "membership", "prime membership", "trial", "renewal", "cancel membership",
        "prime subscription",
    ],
    "digital_content": [
        "prime video", "video", "movie", "film", "streaming", "kindle", "ebook", "book",
        "audible", "music", "digital",
    ],
    "device_technical": [
        "kindle", "fire tv", "device", "tablet", "screen", "charger", "remote", "app",
        "application", "error", "not working", "doesn't work", "technical", "software", "wifi",
    ],
    "product_order_issue": [
        "product", "item", "seller", "product unavailable", "out of stock", "wrong item",
        "damaged", "defective", "product issue", "order issue", "coupon", "discount", "wishlist",
    ],
    "customer_service_complaint": [
        "customer service", "support", "agent", "representative", "call", "phone", "contact",
        "no response", "nobody replied", "complaint", "unresolved", "waiting", "poor service",
    ],
    "other_non_actionable": [
        "thank you", "thanks", "great", "awesome", "love amazon", "feedback", "suggestion",
        "congratulations", "hello", "hi",
    ],
})

# Terms that force an escalation, in order of precedence.
RISK_LEXICON = Lexicon.of({
    "security_or_account_risk": [
        "hacked", "hack", "stolen account", "account compromised", "someone accessed",
        "unauthorized access", "fraud", "identity theft",
    ],
    "payment_or_financial_risk": [
        "charged twice", "charged me twice", "unauthorized charge", "unknown charge",
        "fraudulent charge", "credit card fraud",
    ],
    "legal_or_high_risk": ["lawyer", "legal action", "lawsuit", "sue", "court", "attorney"],
    "explicit_human_request": [
        "human agent", "real person", "speak to an agent", "talk to an agent",
        "customer service representative", "supervisor",
    ],
})

# Intents that always escalate.
HIGH_RISK_INTENTS = ["account_security", "payment_billing"]


def _has_term(text: Column, term: str, mode: str) -> Column:
    if mode == "substring":
        return F.contains(text, F.lit(term))
    if mode == "word":
        quoted = "".join(c if c.isalnum() else f"\\x{{{ord(c):x}}}" for c in term)
        return text.rlike(f"(?<!{W}){quoted}(?!{W})")
    raise ValueError(f"unknown mode: {mode}")


def risk_flag(text: Column, lexicon: Lexicon = RISK_LEXICON, mode: str = "substring") -> Column:
    """First category with a term in the lower-cased text, else NULL.

    One CASE per category, so later categories are only tested when earlier ones miss.
    """
    lowered = F.lower(blank_if_null(text))
    result = F.lit(None).cast("string")
    for name, terms in reversed(lexicon.entries):
        hit = F.lit(False)
        for term in terms:
            hit = hit | _has_term(lowered, term, mode)
        result = F.when(hit, F.lit(name)).otherwise(result)
    return result


def category_scores(normalized: Column, lexicon: Lexicon) -> list[Column]:
    """Per category the number of its distinct terms contained in the text."""
    scores = []
    for _, terms in lexicon.entries:
        score = F.lit(0)
        for term in dict.fromkeys(terms):
            score = score + F.contains(normalized, F.lit(term)).cast("int")
        scores.append(score)
    return scores


def weak_label(
    df: DataFrame,
    text: str = "customer_text",
    lexicon: Lexicon = INTENT_LEXICON,
    fallback: str = FALLBACK_INTENT,
    ambiguous: str = AMBIGUOUS,
) -> DataFrame:
    """Add ``suggested_intent``, ``suggestion_score`` and ``suggestion_share``.

    The best category wins; no term at all gives ``fallback`` with score 0 and a tie at
    the top gives ``ambiguous`` with the tied score. ``suggestion_share`` is the best
    score's share of all scores, a stand-in for a model confidence.
    """
    names = F.array(*[F.lit(name) for name in lexicon.categories])

    def verdict(scores: Column) -> Column:
        best = F.array_max(scores)
        ties = F.size(F.filter(scores, lambda s: s == best))
        total = F.aggregate(scores, F.lit(0), lambda acc, s: acc + s)
        winner = F.get(names, (F.array_position(scores, best) - 1).cast("int"))
        name = F.when(best == 0, F.lit(fallback)).when(ties > 1, F.lit(ambiguous)).otherwise(winner)
        share = F.when(best == 0, F.lit(0.0)).otherwise(best.cast("double") / total)
        return F.struct(
            name.alias("suggested_intent"), best.alias("suggestion_score"), share.alias("suggestion_share")
        )

    # A generator: evaluated once per row, whatever later filters and columns refer to.
    normalized = normalize_text(blank_if_null(F.col(text)))
    found = let(normalized, lambda x: let(F.array(*category_scores(x, lexicon)), verdict))
    return df.select("*", F.inline(F.array(found)))
