"""Option lists: the distinct places and cuisines a user can choose from."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import number_rows

PAGE = 1000


def _sorted_values(values: DataFrame) -> DataFrame:
    return number_rows(values.na.drop().distinct(), "value", name="pos").select("pos", "value")


def options_locations(catalog: DataFrame) -> DataFrame:
    """Distinct locations in binary string order, numbered from 1."""
    return _sorted_values(catalog.select(F.col("location").alias("value")))


def options_cuisines(catalog: DataFrame) -> DataFrame:
    """Distinct members of all cuisine lists, the same way."""
    return _sorted_values(catalog.select(F.explode("cuisines").alias("value")))


def options_payload(catalog: DataFrame, page: int = PAGE) -> DataFrame:
    """Both lists as pages of at most ``page`` values: ``kind, page, options``.

    Lists of usual size fill one page each. Pages keep every array small, whatever the number of
    distinct values.
    """
    both = options_locations(catalog).withColumn("kind", F.lit("locations")).unionByName(
        options_cuisines(catalog).withColumn("kind", F.lit("cuisines"))
    )
    return (
        both.withColumn("page", F.floor((F.col("pos") - 1) / page) + 1)
        .groupBy("kind", "page")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("options"))
    )
