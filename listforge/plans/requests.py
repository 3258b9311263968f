"""Validation of preference requests."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.messages import preference_summary
from ..functions.numbers import parse_number
from ..functions.text import strip


def from_json(bodies: DataFrame) -> DataFrame:
    """Requests from JSON texts (request_id, body), with ``min_rating_given``: whether the threshold stands there at all.

    Texts must be texts; a threshold may be a number, a text or a truth value. What is no JSON object has no fields.
    """
    value = F.try_parse_json("body")
    field = lambda name: F.try_variant_get("value", f"$.{name}", "variant")
    text = lambda name: F.when(F.schema_of_variant(field(name)) == "STRING", F.try_variant_get("value", f"$.{name}", "string")).alias(name)
    kind = F.schema_of_variant(field("min_rating"))
    threshold = (F.when(kind == "BOOLEAN", F.try_variant_get("value", "$.min_rating", "boolean").cast("int").cast("string"))
                 .when(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"), F.try_variant_get("value", "$.min_rating", "string")))
    return bodies.select("request_id", value.alias("value")).select(
        "request_id", text("location"), text("cuisine"), threshold.alias("min_rating"), text("budget"), field("min_rating").isNotNull().alias("min_rating_given"))


def checked(requests: DataFrame) -> DataFrame:
    """Cleaned fields plus ``errors``, the names of the fields that break a rule.

    An absent threshold means 0.0 and an explicit null is refused, where ``min_rating_given`` tells them apart (see
    :func:`from_json`); without that column every null counts as absent.
    """
    absent = F.col("min_rating").isNull()
    if "min_rating_given" in requests.columns:
        absent = absent & ~F.col("min_rating_given")
    cleaned = requests.select(
        "request_id",
        strip(F.col("location")).alias("location"),
        strip(F.col("cuisine")).alias("cuisine"),
        F.when(absent, F.lit(fixed.DEFAULT_MIN_RATING))
        .otherwise(parse_number(F.col("min_rating").cast("string"))).alias("min_rating"),
        "budget",
    )

    def bad(field, condition):
        return F.when(F.coalesce(condition, F.lit(True)), F.lit(field))

    return cleaned.withColumn("errors", F.array_compact(F.array(
        bad("location", F.col("location") == ""),
        bad("cuisine", F.col("cuisine") == ""),
        bad("min_rating", ~F.col("min_rating").between(fixed.RATING_MIN, fixed.RATING_MAX)),
        bad("budget", ~F.col("budget").isin(fixed.TIERS)),
    )))


def requests_valid(requests: DataFrame) -> DataFrame:
    return checked(requests).filter(F.size("errors") == 0).drop("errors")


def requests_rejected(requests: DataFrame) -> DataFrame:
    """The quarantine: ids with the fields that were refused."""
    return checked(requests).filter(F.size("errors") > 0).select("request_id", "errors")


def requests_summary(valid: DataFrame) -> DataFrame:
    return valid.select("request_id", preference_summary(
        F.col("location"), F.col("cuisine"), F.col("min_rating"), F.col("budget")).alias("summary"))
