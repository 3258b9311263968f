"""Number parsing, tiers and rounding as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .text import SPACE, ascii_digits

_DIGIT_RUN = r"\d+(?:_\d+)*"
_NUMBER = rf"[+-]?(?:{_DIGIT_RUN}(?:\.(?:{_DIGIT_RUN})?)?|\.{_DIGIT_RUN})(?:[eE][+-]?{_DIGIT_RUN})?"


def parse_number(c: Column) -> Column:
    """Text to double, null unless the whole text is a plain finite number.

    The pattern does the check and the extraction in one pass; a bare ``try_cast``
    would also take forms such as ``4.1f`` or ``4d``.
    """
    text = F.regexp_extract(ascii_digits(c), rf"(?U)^{SPACE}*({_NUMBER}){SPACE}*\z", 1)
    return F.replace(text, F.lit("_"), F.lit("")).try_cast("double")


def rating_text(c: Column) -> Column:
    """``4.1/5`` and ``4.1 /5`` to ``4.1``."""
    return F.regexp_replace(c, rf"(?Ud){SPACE}*/{SPACE}*5.*", "")


def cost_text(c: Column) -> Column:
    """Digits and dots only: signs, ranges and currency marks fall away."""
    return F.regexp_replace(c, r"(?U)[^\d.]", "")


def in_rating_range(c: Column) -> Column:
    return F.when(c.between(fixed.RATING_MIN, fixed.RATING_MAX), c)


def clean_rating(c: Column) -> Column:
    return in_rating_range(parse_number(rating_text(c)))


def clean_cost(c: Column) -> Column:
    return parse_number(cost_text(c))


def numeric_cost(c: Column) -> Column:
    """The same for a source column that is numeric already: the sign falls away, NaN and infinity are no cost."""
    value = F.abs(c.cast("double"))
    return F.when(value < float("inf"), value)


def assign_budget(cost: Column) -> Column:
    return (
        F.when(cost.isNull() | F.isnan(cost), None)
        .when(cost < fixed.LOW_BELOW, "low")
        .when(cost <= fixed.MEDIUM_UP_TO, "medium")
        .otherwise("high")
    )


def one_decimal(c: Column) -> Column:
    """Nearest tenth of the exact binary value, ties to the even tenth: 4.25 to 4.2, 4.35 (a little less) to 4.3.

    ``round`` decides on the shortest decimal text instead. The distance from the midpoint, 20 * c - (2 * tenth + 1), is
    exact in two doubles, since the halves of c have room for the factor.
    """
    tenth = F.floor(c * 10)
    carrier = c * 134217729.0  # 2**27 + 1 splits a double into halves of 26 bits
    high = carrier - (carrier - c)
    product = c * 20
    error = (high * 20 - product) + (c - high) * 20
    over = (product - (2 * tenth + 1)) + error
    up = (over > 0) | ((over == 0) & (tenth % 2 != 0))
    return (tenth + F.when(up, 1).otherwise(0)) / F.lit(10.0)


def whole_number(c: Column) -> Column:
    """Fraction cut off, value kept as double."""
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("double")
