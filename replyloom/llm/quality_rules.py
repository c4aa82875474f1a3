"""Quality rules as a short-circuit cascade whose order comes from measured cost and selectivity.

Each rule rejects a document or lets it pass. On a sample, the time that a rule takes and the
share of documents that it rejects are measured; rules then run by rejections per second, and
a document that one rule rejects meets no later one. The order changes the cost and the name
of the first rejecting rule, never which documents are kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom.llm.common import let, text_of, words
from replyloom.session import checkpoint

SAMPLE_ROWS = 500


# Up to so many repeated windows are looked up in a list; more are found by sorting.
FEW = 16


def _hashes() -> Column:
    """One 64-bit hash per 3-word window."""
    w = F.col("__words")
    each = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.slice(each, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))


def _twice() -> Column:
    """Hashes that occur again, found among the sorted ones; none for most texts."""
    s = F.col("__sorted")
    again = F.filter(s, lambda x, k: x == F.get(s, k - 1))
    return F.when(F.size(F.array_distinct(s)) == F.size(s), F.slice(s, 1, 0)).otherwise(again)


def _places() -> Column:
    """Where the repeated windows start, in order."""
    h, twice = F.col("__hashes"), F.col("__twice")
    listed = F.array_compact(F.transform(h, lambda x, i: F.when(F.array_contains(twice, x), i)))
    placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    pairs = let(
        placed,
        lambda s: F.filter(
            s, lambda e, k: (e["h"] == F.get(s, k - 1)["h"]) | (e["h"] == F.get(s, k + 1)["h"])
        ),
    )
    ordered = F.sort_array(F.transform(pairs, lambda e: e["i"]))
    none = F.array().cast("array<int>")
    return F.when(F.size(twice) == 0, none).when(F.size(twice) <= FEW, listed).otherwise(ordered)


def _covered() -> Column:
    """Words inside the windows that start at these places."""
    p = F.col("__places")
    gaps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
    return F.aggregate(gaps, F.lit(0), lambda a, x: a + x).cast("long")


def _dup_lines() -> Column:
    x = F.col("__lines")
    return (F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _kept_chars(pattern: str) -> Column:
    return F.length(F.regexp_replace(text_of(), pattern, "")).cast("long")


# Feature -> features it is made of, expression. A null text counts as empty.
FEATURES: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "words": ((), lambda: words(text_of())),
    "n_words": (("words",), lambda: F.size("__words").cast("long")),
    "word_chars": (("words",), lambda: F.length(F.array_join("__words", "")).cast("long")),
    "n_symbols": ((), lambda: _kept_chars(r"[^#*$%&|<>]+")),
    "lines": ((), lambda: F.filter(F.split(text_of(), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))),
    "n_lines": (("lines",), lambda: F.size("__lines").cast("long")),
    "n_dup_lines": (("lines",), _dup_lines),
    "hashes": (("words",), _hashes),
    "sorted": (("hashes",), lambda: F.sort_array("__hashes")),
    "twice": (("sorted",), _twice),
    "places": (("hashes", "twice"), _places),
    "n_repeat_words": (("places",), _covered),
    "n_upper": ((), lambda: _kept_chars("[^A-Z]+")),
    "n_letters": ((), lambda: _kept_chars("[^A-Za-z]+")),
}


def add_feature(df: DataFrame, name: str, live: Column | None = None) -> DataFrame:
    """``df`` with ``__name`` and what it is made of; null where ``live`` is false.

    Each step is a column of its own, so that the engine compiles it and evaluates it once.
    """
    if f"__{name}" in df.columns:
        return df
    needs, make = FEATURES[name]
    for other in needs:
        df = add_feature(df, other, live)
    return df.withColumn(f"__{name}", make() if live is None else F.when(live, make()))


def _without(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*[f"__{c}" for c in FEATURES if f"__{c}" not in columns])


@dataclass(frozen=True)
class Rule:
    """``rejects`` makes a boolean column from ``needs``; true sends the document away."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[..., Column]

    def test(self) -> Column:
        return self.rejects(*[F.col(f"__{c}") for c in self.needs])


BASE_RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 50),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda n, r: 100 * r > 50 * n),
)
# Bounds that running prose in any of the languages stays well within.
MORE_RULES = (
    Rule("word_length", ("n_words", "word_chars"), lambda n, c: (c < 2 * n) | (c > 15 * n)),
    Rule("symbols", ("n_words", "n_symbols"), lambda n, c: 5 * c > n),
    Rule("repeated_lines", ("n_lines", "n_dup_lines"), lambda n, d: 10 * d > 3 * n),
    Rule("capitals", ("n_upper", "n_letters"), lambda u, n: 2 * u > n),
)
RULES = BASE_RULES + MORE_RULES


def measure(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Seconds and rejected share of each rule on a sample of at most ``sample_rows`` texts.

    An empty table gives cost and share 0 for all rules.
    """
    total = docs.count()
    share = min(1.0, 1.2 * sample_rows / max(total, 1))
    sample = checkpoint(docs.select("text").sample(share, seed=7).limit(sample_rows))
    n = sample.count()

    def timed(rule: Rule | None) -> tuple[float, int]:
        df = sample.withColumn("__no", F.length(text_of()) < 0)
        for feature in rule.needs if rule else ():
            df = add_feature(df, feature)
        start = time.perf_counter()
        hits = df.agg(F.sum((rule.test() if rule else F.col("__no")).cast("long")).alias("n")).first()["n"]
        return time.perf_counter() - start, hits or 0

    timed(None)
    floor = min(timed(None)[0] for _ in range(2))
    out = []
    for rule in rules:
        runs = [timed(rule) for _ in range(2)]
        cost = max(min(s for s, _ in runs) - floor, 1e-4) if n else 0.0
        out.append({"rule": rule.name, "seconds": cost, "share": runs[0][1] / n if n else 0.0})
    return out


def order_rules(measured: Sequence[dict]) -> list[str]:
    """Rule names by rejections per second, then by cost, then by name."""
    rate = {m["rule"]: m["share"] / m["seconds"] if m["seconds"] else 0.0 for m in measured}
    return [m["rule"] for m in sorted(measured, key=lambda m: (-rate[m["rule"]], m["seconds"], m["rule"]))]


def cascade(docs: DataFrame, names: Sequence[str], rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with ``__rejected``: the first rule in the order of ``names`` that rejects, else null.

    A feature is computed when the first rule asks for it, and only for documents that no
    earlier rule has rejected.
    """
    by_name = {r.name: r for r in rules}
    df = docs.withColumn("__rejected", F.lit(None).cast("string"))
    for name in names:
        rule, live = by_name[name], F.col("__rejected").isNull()
        for feature in rule.needs:
            df = add_feature(df, feature, live)
        df = df.withColumn("__rejected", F.coalesce("__rejected", F.when(live & rule.test(), name)))
    return df


def apply_rules(docs: DataFrame, names: Sequence[str] | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with a column ``rejected_by``, replacing one of that name.

    A null or empty text has no words and goes by ``few_words`` or a rule before it; repeated
    rows get equal verdicts; an empty table stays empty.
    """
    names = order_rules(measure(docs, rules)) if names is None else names
    judged = _without(cascade(docs, names, rules), docs.columns)
    return judged.withColumn("rejected_by", F.col("__rejected")).drop("__rejected")


def keep_good(docs: DataFrame, names: Sequence[str] | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns unchanged.

    The rows go by an explode of an empty list: a filter would be pushed down through the
    cascade and take the place of its columns with copies of their expressions.
    """
    judged = apply_rules(docs.select(F.struct("*").alias("__row"), "text"), names, rules)
    passed = F.when(F.col("rejected_by").isNull(), F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    return judged.select("__row", F.explode(passed).alias("__passed")).select("__row.*")


BASE_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_table(docs: DataFrame) -> DataFrame:
    """Per document the base columns and the verdict of the cascade over all rules.

    Rows leave through an explode of one struct, for the reason that ``keep_good`` gives: a filter
    on any of the columns is applied to finished rows.
    """
    names = order_rules(measure(docs))
    df = docs.select("doc_id", "text")
    for name in BASE_COLUMNS:
        df = add_feature(df, name)
    failed = BASE_RULES[0].test() | BASE_RULES[1].test()
    base = {r.name for r in BASE_RULES}
    df = cascade(df.withColumn("base_failed", failed), [n for n in names if n not in base])
    row = F.struct(
        "doc_id",
        *[F.col(f"__{c}").alias(c) for c in BASE_COLUMNS],
        "base_failed",
        (~F.col("base_failed") & F.col("__rejected").isNull()).alias("kept"),
    )
    return df.select(F.explode(F.array(row)).alias("row")).select("row.*")
