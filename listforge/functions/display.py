"""Card labels as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def display_cuisines(cuisines: Column, searched: Column) -> Column:
    """The searched cuisine (first exact hit, any case) moves to the front, then the first three stay."""
    at = F.array_position(F.transform(cuisines, F.lower), F.lower(searched)).cast("int")
    moved = F.concat(
        F.slice(cuisines, at, F.lit(1)),
        F.slice(cuisines, F.lit(1), at - 1),
        F.slice(cuisines, at + 1, F.size(cuisines)),
    )
    return F.slice(F.when(at > 0, moved).otherwise(cuisines), 1, fixed.CARD_CUISINES)


def price_label(cost: Column) -> Column:
    """Whole amounts are shown without a fraction."""
    amount = F.when(cost == F.floor(cost), F.floor(cost).cast("string")).otherwise(cost.cast("string"))
    return F.when(cost.isNotNull(), F.concat(F.lit("₹"), amount, F.lit(" for two"))).otherwise("Price N/A")


def rating_label(rating: Column) -> Column:
    return F.when(rating.isNotNull(), F.format_string("%.1f", rating))
