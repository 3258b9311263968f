"""Display orders and labels of answered requests."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.display import display_cuisines, price_label, rating_label


def _ordered(answered: DataFrame, key) -> DataFrame:
    """Items sorted inside their row by ``key``; ties keep the rank order they had."""
    keyed = F.array_sort(F.transform("items", lambda x: F.struct(
        key(x).alias("key"), x["rank"].alias("rank"), x["rec_pos"].alias("rec_pos"), x["id"].alias("id"))))
    return answered.withColumn("sorted", keyed).select("request_id", F.posexplode("sorted").alias("at", "item")) \
        .select("request_id", (F.col("at") + 1).alias("pos"), F.col("item.id").alias("id"))


def sort_rank(answered: DataFrame) -> DataFrame:
    """Rank order; its first row is the top pick."""
    return _ordered(answered, lambda x: x["rank"]).withColumn("is_top_pick", F.col("pos") == 1)


def sort_price_asc(answered: DataFrame) -> DataFrame:
    """Missing and zero prices come last."""
    return _ordered(answered, lambda x: F.coalesce(F.nullif(x["cost_for_two"], F.lit(0.0)), F.lit(float("inf"))))


def sort_price_desc(answered: DataFrame) -> DataFrame:
    return _ordered(answered, lambda x: F.negative(F.coalesce(x["cost_for_two"], F.lit(0.0))))


def sort_rating_desc(answered: DataFrame) -> DataFrame:
    return _ordered(answered, lambda x: F.negative(F.coalesce(x["rating"], F.lit(0.0))))


def cards(answered: DataFrame) -> DataFrame:
    """Labels of every item: cuisines with the searched one first, price and rating texts."""
    return answered.select("request_id", "cuisine", F.inline("items")).select(
        "request_id", "id",
        display_cuisines(F.col("cuisines"), F.col("cuisine")).alias("cuisines"),
        price_label(F.col("cost_for_two")).alias("price"),
        rating_label(F.col("rating")).alias("rating"),
    )
