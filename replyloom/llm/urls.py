"""URL filter: path rules first, then the ratio of two character language models.

The URLs that a rule allows or blocks train a smoothed variable-order Markov model each. An
order-k estimate mixes counts after the last k characters with the estimate of the next lower
order, by how many different characters have followed (Witten-Bell). A URL that no rule fits is
judged by the difference of its log-likelihoods per character against a threshold, which is
calibrated on URLs kept out of the counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from replyloom.session import checkpoint, is_small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Characters a model looks at: the one to predict and those before it.
GRAM = 5
START, END = "\x01", "\x02"
ALPHABET = 256
# Log-probabilities are added as whole millionths, so sums do not depend on their order.
UNIT = 1_000_000
HELD_OUT = 5
BINS_PER_NAT, BIN_LIMIT = 200, 2000
SALTS = 32


@dataclass(frozen=True)
class PathRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Fixed by the contract.
RULES = (
    PathRule("allow", "com", "/"),
    PathRule("block", "example.com", "/en/"),
    PathRule("allow", "www.example.com", "/en/"),
    PathRule("block", "net", "/es/"),
    PathRule("block", "net", "/fr/"),
)


def host_path(url: str) -> tuple[Column, Column]:
    """Host in lower case and path; both empty without a scheme separator or for null."""
    text = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def judged_text(url: str) -> Column:
    """The whole URL as the models read it: the host in lower case, null as the empty text."""
    text = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(text, "://")
    start = F.substring(text, F.lit(1), at + 2)
    rest = F.substring(text, at + 3, F.length(text))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    lowered = F.concat(start, F.translate(host, UPPER, LOWER), F.substring(rest, F.length(host) + 1, F.length(rest)))
    return F.when(at > 0, lowered).otherwise(text)


def fitting_rule(rules: Sequence[PathRule] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule for the columns ``host`` and ``path``, else null."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _grams(urls: DataFrame) -> DataFrame:
    """One row per character of ``url`` and its end: the GRAM characters that end there."""
    padded = F.concat(F.lit(START * (GRAM - 1)), F.col("url"), F.lit(END))
    places = F.sequence(F.lit(1), F.length("url") + 1)
    return urls.select("*", F.explode(places).alias("__at")).withColumn("gram", F.substring(padded, F.col("__at"), F.lit(GRAM)))


def log_ratios(urls: DataFrame) -> DataFrame:
    """(gram, ratio): log p(accepted) - log p(rejected) of the last character after the others.

    ``urls`` has distinct ``url`` and the numbers of times that it counts as accepted and as
    rejected. Every gram of every URL gets a ratio, whether it was counted or not.
    """
    counted = (
        _grams(urls)
        .groupBy("gram")
        .agg(F.sum("accepted").alias("n1"), F.sum("rejected").alias("n2"))
    )
    longest = checkpoint(counted)
    lower = None
    for order in range(1, GRAM + 1):
        cut = F.substring("gram", GRAM - order + 1, order)
        grams = longest.groupBy(cut.alias("gram")).agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"))
        # One partition per context: as many rows as characters have followed it.
        after = Window.partitionBy(F.substring("gram", 1, order - 1))
        seen = grams.select(
            "*",
            *[F.sum(n).over(after).alias(f"c{n}") for n in ("n1", "n2")],
            *[F.sum((F.col(n) > 0).cast("long")).over(after).alias(f"t{n}") for n in ("n1", "n2")],
        )
        if lower is None:
            joined = seen.withColumns({"bn1": F.lit(1.0 / ALPHABET), "bn2": F.lit(1.0 / ALPHABET)})
        else:
            joined = seen.withColumn("__suffix", F.substring("gram", 2, order)).join(lower, "__suffix")

        def mixed(n: str) -> Column:
            total = F.col(f"c{n}") + F.col(f"t{n}")
            return F.when(total > 0, (F.col(n) + F.col(f"t{n}") * F.col(f"b{n}")) / total).otherwise(F.col(f"b{n}"))

        made = joined.select("gram", mixed("n1").alias("p1"), mixed("n2").alias("p2"))
        lower = made.select(F.col("gram").alias("__suffix"), F.col("p1").alias("bn1"), F.col("p2").alias("bn2"))
    ratio = F.round((F.log("p1") - F.log("p2")) * UNIT).cast("long")
    return made.select("gram", ratio.alias("ratio"))


def score_urls(urls: DataFrame, ratios: DataFrame) -> DataFrame:
    """(url, score): mean log ratio per character, the end included.

    ``ratios`` is materialised. Small, it is broadcast; else common grams are spread over salts.
    """
    grams = _grams(urls.select("url"))
    if is_small(ratios):
        joined = grams.join(F.broadcast(ratios), "gram")
    else:
        salted = ratios.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt"))
        joined = grams.withColumn("__salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).join(salted, ["gram", "__salt"])
    return joined.groupBy("url").agg((F.sum("ratio") / F.count(F.lit(1)) / UNIT).alias("score"))


def threshold(scored: DataFrame) -> float:
    """The score that best parts held-out accepted from rejected URLs, each class weighing the same.

    ``scored`` has score, accepted and rejected. Counts per bin come to the driver, at most
    ``2 * BIN_LIMIT + 1`` rows. Without both classes it is 0.
    """
    at = F.greatest(F.least(F.floor(F.col("score") * BINS_PER_NAT), F.lit(BIN_LIMIT)), F.lit(-BIN_LIMIT))
    bins = scored.groupBy(at.alias("bin")).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).collect()
    bins = sorted((b["bin"], b["a"] or 0, b["r"] or 0) for b in bins)
    all_a, all_r = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not all_a or not all_r:
        return 0.0
    below_a = below_r = 0
    best = []
    for at, a, r in bins:
        best.append((below_a / all_a + 1 - below_r / all_r, abs(at), at))
        below_a, below_r = below_a + a, below_r + r
    best.append((1.0, abs(bins[-1][0] + 1), bins[-1][0] + 1))
    return min(best)[2] / BINS_PER_NAT


def judge_pages(pages: DataFrame, rules: Sequence[PathRule] = RULES) -> DataFrame:
    """``pages`` packed in ``__row`` with host, path, rule, score and verdict.

    Host and path are for the rules and the output; the models count and score the whole URL, with
    scheme, query and fragment. Equal URLs are scored once. A null url has empty host and path and
    goes to the models as the empty text. Scores at the threshold or above are allowed, so without training
    URLs everything unruled is. An empty table stays empty.
    """
    host, path = host_path("url")
    name, verdict = fitting_rule(rules)
    placed = pages.select(F.struct("*").alias("__row"), judged_text("url").alias("url"), host.alias("host"), path.alias("path"))
    ruled = placed.select("*", name.alias("rule"), verdict.alias("__ruled"))
    classes = ruled.select(
        "url",
        (F.col("__ruled") == "allow").cast("long").alias("a"),
        (F.col("__ruled") == "block").cast("long").alias("r"),
    )
    held = F.crc32(F.col("url").cast("binary")) % HELD_OUT == 0
    urls = checkpoint(
        classes.groupBy("url").agg(
            F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("r"), F.lit(0)).alias("r")
        )
    )
    learned = [F.when(held, F.lit(0)).otherwise(F.col(c)).cast("long").alias(n) for c, n in (("a", "accepted"), ("r", "rejected"))]
    ratios = checkpoint(log_ratios(urls.select("url", *learned)))
    scored = checkpoint(score_urls(urls, ratios).join(urls, "url"))
    kept_out = scored.where(held).select("score", F.col("a").alias("accepted"), F.col("r").alias("rejected"))
    at = threshold(kept_out)
    judged = ruled.join(scored.select("url", "score"), "url")
    own = F.when(F.col("score") >= at, "allow").otherwise("block")
    return judged.withColumn("verdict", F.coalesce("__ruled", own)).drop("url", "__ruled")


def url_table(pages: DataFrame) -> DataFrame:
    judged = judge_pages(pages.select("page_id", "url"))
    return judged.select("__row.page_id", "host", "path", "rule", "verdict", "score")
