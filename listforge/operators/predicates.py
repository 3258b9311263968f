"""The four preference predicates."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import contains_text


def location_matches(query) -> Column:
    """Literal, case-insensitive substring; a missing location never matches."""
    return contains_text(F.col("location"), F.lit(query))


def cuisine_matches(query) -> Column:
    """Any member of the list contains the query."""
    wanted = F.lower(F.lit(query))
    return F.exists("cuisines", lambda c: F.contains(F.lower(c), wanted))


def rating_at_least(threshold) -> Column:
    """Unrated rows never pass, not even a threshold of 0."""
    rating = F.col("rating")
    return rating.isNotNull() & ~F.isnan(rating) & (rating >= F.lit(threshold))


def budget_is(tier) -> Column:
    return F.col("budget").isNotNull() & (F.col("budget") == F.lit(tier))
