"""Connected components of a link table by alternating stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def _is_stars(state: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, which has none itself."""
    one = state.groupBy("u").agg(F.count(F.lit(1)).alias("_n"))
    if not one.filter("_n > 1").isEmpty():
        return False
    return state.select("v").join(state.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """Smallest key reachable (``root``) for every ``node`` of the links (columns a, b; no nulls).

    Each round hangs every node's larger neighbours on its smallest one, then its smaller
    neighbours; the number of rounds grows with the logarithm of the number of nodes.
    Neighbours are never gathered: the smallest is a partial aggregate and the rest is a
    join that may split a node with very many links. Keys are of any ordered type.
    """
    state = keep(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not _is_stars(state):
        both = state.union(state.select("v", "u"))
        # Kept before the join: a join of two scans splits a node with very many links.
        least = keep(both.groupBy("u").agg(F.min("v").alias("_w")).select(F.col("u").alias("_n"), F.least("u", "_w").alias("_m")), "smallest")
        large = keep(both.filter("v > u").join(least, F.col("u") == F.col("_n")).select(F.col("v").alias("u"), F.col("_m").alias("v")), "large-star")
        least = keep(large.groupBy("u").agg(F.min("v").alias("_m")).withColumnRenamed("u", "_n"), "smallest")
        small = large.join(least, F.col("u") == F.col("_n"))
        state = keep(small.filter("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
                     .union(least.select("_n", "_m")).distinct(), "small-star")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(state.select("v", "v").distinct())
