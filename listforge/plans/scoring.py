"""Scorer responses: candidates out, JSON answers in, checks and retries between."""

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.messages import prompt
from ..functions.numbers import parse_number
from ..sources.schema import RESPONSE

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


# Prompts handed to a scorer at once: each holds forty listings, and what a scorer makes of them is larger still.
BATCH = 256


def prompts(shortlisted: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``request_id, prompt`` for requests with candidates, and the columns to ``carry``; nulls are written out in the JSON."""
    rows = F.transform("shortlist", lambda x: x.dropFields("pos"))
    return shortlisted.filter(F.size("shortlist") > 0).select(
        "request_id", *carry,
        prompt(F.col("location"), F.col("cuisine"), F.col("min_rating"), F.col("budget"),
               F.to_json(rows, {"ignoreNullFields": "false"})).alias("prompt"),
    )


def _in_batches(scorer: Scorer, size: int) -> Scorer:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return scorer(rows.iloc[i:i + size].reset_index(drop=True) for rows in batches for i in range(0, len(rows), size))
    return run


def score(shortlisted: DataFrame, scorer: Scorer, tasks: int | None = None) -> DataFrame:
    """Run a user function over batches of prompts: ``request_id, attempt, raw, error``.

    The function makes its own attempts, numbered from 0. An error row without an attempt number
    reports a failure outside the attempts. ``tasks`` deals the prompts out evenly, for scorers that
    take far longer than the plan that feeds them. A batch holds BATCH prompts at most.
    """
    rows = prompts(shortlisted)
    return (rows.repartition(tasks) if tasks else rows).mapInPandas(_in_batches(scorer, BATCH), RESPONSE)


def _kind_of(value: Column) -> Column:
    return F.schema_of_variant(value)


def _field(value: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def _text(value: Column) -> Column:
    return F.when(_kind_of(value) == "STRING", F.try_variant_get(value, "$", "string"))


_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _whole(value: Column) -> Column:
    """A whole number, also as ``1.0``, ``"1"`` or ``true``; anything else is null.

    Numbers beyond 64 bits stop at the last one: no listing has such an id, and such ranks come last.
    """
    kind, said = _kind_of(value), F.try_variant_get(value, "$", "string")
    number, exact = parse_number(said), said.try_cast("bigint")
    wide = F.when(number < 0, F.lit(_LEAST)).otherwise(F.lit(_MOST))
    return (
        F.when(kind == "BIGINT", exact)
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("bigint"))
        .when(number == F.floor(number), F.coalesce(exact, number.try_cast("bigint"), wide))
        .when(number.isNotNull() & (F.abs(number) > 1e15), wide)
    )


# Put behind a response inside one JSON array: a parser reports no text after the first value, but only a
# response that is exactly one value leaves this mark in second place.
_END = "listforge end of response"

_ANSWER = "struct<summary:string,recommendations:array<struct<restaurant_id:bigint,rank:bigint,explanation:string>>>"
# Shape of nearly all valid responses; it is read in one step, other shapes field by field.
_USUAL = "OBJECT<recommendations: ARRAY<OBJECT<explanation: STRING, rank: BIGINT, restaurant_id: BIGINT>>, summary: STRING>"
# The fields alone: unlike a whole variant, this passes over repeated keys (the last counts) and NaN in other fields.
_FIELDS = "summary variant, recommendations array<struct<restaurant_id variant, rank variant, explanation variant>>"


def _answer(summary: Column, entries: Column, field) -> Column:
    """The answer with null for every value of a wrong type."""
    entry = lambda x: F.struct(
        _whole(field(x, "restaurant_id")).alias("restaurant_id"),
        _whole(field(x, "rank")).alias("rank"),
        _text(field(x, "explanation")).alias("explanation"),
    )
    return F.struct(_text(summary).alias("summary"), F.transform(entries, entry).alias("recommendations"))


def _field_by_field(value: Column) -> Column:
    return _answer(_field(value, "summary"), _field(value, "recommendations", "array<variant>"), _field)


def judged(responses: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Responses with ``status`` and, if valid, ``summary`` and ``recommendations``; ``carry`` names columns to keep.

    ``ok``: a JSON object with a text summary and a list of (id, rank, explanation). Other fields may hold
    anything, NaN and infinities as well; of repeated keys the last counts.
    ``retry``: not JSON or another shape. ``stop``: an error, or JSON that is no object.
    """
    kept = ["request_id", "attempt", *carry]
    closed = responses.select(*kept, (F.col("error").isNotNull() | F.col("raw").isNull()).alias("broken"),
                              F.concat(F.lit("["), "raw", F.lit(f',"{_END}"]')).alias("closed"))
    # Parsed once: the next steps use the value more than once, so Catalyst leaves it in a projection of its own.
    once = closed.withColumn("parsed", F.try_parse_json("closed"))
    marked = once.withColumn("texts", F.when(F.col("parsed").isNull(), F.from_json("closed", "array<string>")))
    parsed = marked.select(
        *kept, "broken",
        F.when(F.try_variant_get("parsed", "$[1]", "string") == _END, F.try_variant_get("parsed", "$[0]", "variant")).alias("value"),
        F.when((F.size("texts") == 2) & (F.get("texts", F.lit(1)) == _END), F.get("texts", F.lit(0))).alias("other"))
    shaped = parsed.withColumn("shape", F.coalesce(_kind_of(F.col("value")), F.when(F.col("other").startswith("{"), "OBJECT").when(F.col("other").isNotNull(), "other")))
    fields = F.from_json("other", _FIELDS)
    read = shaped.withColumn("answer", F.when(
        F.col("value").isNull(), F.when(F.col("shape") == "OBJECT", _answer(fields["summary"], fields["recommendations"], lambda x, name: x[name]))
    ).when(
        F.col("shape") == _USUAL, F.try_variant_get("value", "$", _ANSWER)
    ).when(F.col("shape").startswith("OBJECT"), _field_by_field(F.col("value"))))
    summary, recommendations = F.col("answer.summary"), F.col("answer.recommendations")
    complete = summary.isNotNull() & recommendations.isNotNull() & F.forall(
        recommendations,
        lambda x: x["restaurant_id"].isNotNull() & x["rank"].isNotNull() & x["explanation"].isNotNull(),
    )
    status = (
        F.when(F.col("broken"), "stop")
        .when(F.col("shape").isNull(), "retry")
        .when(~F.col("shape").startswith("OBJECT"), "stop")
        .when(complete, "ok")
        .otherwise("retry")
    )
    return read.select(*kept, status.alias("status"),
                       summary.alias("summary"), recommendations.alias("recommendations"))


def outcomes(responses: DataFrame, max_retries: int = fixed.MAX_RETRIES) -> DataFrame:
    """Per request that has responses: the first valid attempt before any stop, or null.

    ``attempt, summary, recommendations`` of that attempt, and ``outer_error`` for a failure outside the
    attempts. An answer with no usable id is still an answer.
    """
    # Attempts beyond the limit do not count, but a request that has only those did fail.
    counted = F.col("attempt").between(0, max_retries)
    valid = F.when(counted & (F.col("status") == "ok"), F.col("attempt"))
    per_request = judged(responses).groupBy("request_id").agg(
        F.count_if(F.col("attempt").isNull()).alias("n_outer"),
        F.min(F.when(counted & (F.col("status") == "stop"), F.col("attempt"))).alias("stop"),
        F.min(valid).alias("ok"),
        F.min_by(F.struct("summary", "recommendations"), valid).alias("answer"),
    )
    stands = F.col("ok").isNotNull() & (F.col("stop").isNull() | (F.col("ok") < F.col("stop")))
    return per_request.select(
        "request_id",
        (F.col("n_outer") > 0).alias("outer_error"),
        F.when(stands, F.col("ok")).alias("attempt"),
        F.when(stands, F.col("answer.summary")).alias("summary"),
        F.when(stands, F.col("answer.recommendations")).alias("recommendations"),
    )


def first_valid_attempt(responses: DataFrame, max_retries: int = fixed.MAX_RETRIES) -> DataFrame:
    return outcomes(responses, max_retries).filter(F.col("attempt").isNotNull()).select("request_id", "attempt")
