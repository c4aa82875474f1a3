"""Prompts for an external judge and parsing of its answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom.functions.text import blank_if_null, let
from replyloom.sources.schemas import JUDGE_SCORES

PROMPT = """Rate a draft answer to a customer against an earlier, similar case.

Customer wrote:
%s

Earlier customer message:
%s

Earlier support answer:
%s

Draft answer:
%s

Answer with one JSON object and nothing else. Its fields:
grounded (1-5): the draft says only what the earlier answer supports
relevant (1-5): the draft deals with what the customer asked
helpful (1-5): the draft offers a useful next step and invents nothing
unsupported_claim (0 or 1): 1 if the draft states or promises something without support
overall (1-5)
reason (text)"""

PROMPT_COLUMNS = (
    "customer_text",
    "retrieved_customer_text",
    "retrieved_brand_response",
    "draft_reply",
)

RATINGS = ("grounded", "relevant", "helpful", "overall")


def judge_prompts(evaluation: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, prompt): one prompt per evaluated message."""
    values = [blank_if_null(F.col(c)) for c in PROMPT_COLUMNS]
    return evaluation.select(key, F.format_string(PROMPT, *values).alias("prompt"))


def extract_json(response: Column) -> Column:
    """Text from the first opening to the last closing brace; NULL without such a span."""
    return F.nullif(F.regexp_extract(response, r"(?s)\{.*\}", 0), F.lit(""))


def judge_parse(responses: DataFrame, key: str = "sample_id", response: str = "response") -> DataFrame:
    """Scores per answer with ``status``: ok, no_json, malformed, missing_field or out_of_range.

    A bad answer becomes a row with a status instead of stopping the batch. Whole numbers may
    be written with a decimal point, and the flag as true or false; a number that is not whole
    is malformed.
    """
    fields = [f for f in JUDGE_SCORES.fields if f.name != "sample_id"]
    numbers = [f.name for f in fields if f.name in (*RATINGS, "unsupported_claim")]
    schema = ", ".join(f"{f.name} string" for f in fields)
    answer = extract_json(F.col(response))
    options = {"columnNameOfCorruptRecord": "_corrupt"}
    parsed = F.from_json(answer, f"{schema}, _corrupt string", options)

    def number(text: Column) -> Column:
        spelt = F.when(text == "true", "1").when(text == "false", "0").otherwise(text)
        value = spelt.try_cast("double")
        return F.when(value == F.floor(value), value.try_cast("int"))

    def typed(s: Column) -> Column:
        unread = F.lit(False)
        for name in numbers:
            unread = unread | (s[name].isNotNull() & number(s[name]).isNull())
        values = [(number(s[f.name]) if f.name in numbers else s[f.name]).alias(f.name) for f in fields]
        corrupt = F.coalesce(s["_corrupt"], F.when(unread, answer))
        return F.when(s.isNotNull(), F.struct(*values, corrupt.alias("_corrupt")))

    def checked(s: Column) -> Column:
        lacking = F.lit(False)
        for f in fields:
            lacking = lacking | s[f.name].isNull()
        inside = s["unsupported_claim"].between(0, 1)
        for name in RATINGS:
            inside = inside & s[name].between(1, 5)
        status = (
            F.when(s.isNull(), "no_json")
            .when(s["_corrupt"].isNotNull(), "malformed")
            .when(lacking, "missing_field")
            .when(~inside, "out_of_range")
            .otherwise("ok")
        )
        return F.struct(*[s[f.name].alias(f.name) for f in fields], status.alias("status"))

    # A generator, so that each answer is parsed once.
    return responses.select(key, F.inline(F.array(let(let(parsed, typed), checked))))


def judge_means(scores: DataFrame) -> DataFrame:
    """Means of the usable answers and how many were rejected."""
    ok = F.col("status") == "ok"

    def mean(name: str) -> Column:
        return F.round(F.avg(F.when(ok, F.col(name))), 6)

    return scores.agg(
        F.count_if(ok).alias("judged"),
        F.count_if(~ok).alias("rejected"),
        *[mean(name).alias(f"mean_{name}") for name in RATINGS],
        mean("unsupported_claim").alias("unsupported_claim_rate"),
    )
