"""Exact substring join of two dictionaries of distinct texts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def _text_grams(c: Column) -> Column:
    """Every substring of one to three characters."""
    at = lambda i: F.array(*[c.substr(i, F.lit(n)) for n in range(1, GRAM + 1)])
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(c)), at)))


def _query_grams(c: Column) -> Column:
    """The three-character substrings, or the whole query if it is no longer than that."""
    n = F.length(c)
    grams = F.transform(F.sequence(F.lit(1), n - GRAM + 1), lambda i: c.substr(i, F.lit(GRAM)))
    return F.when(n <= GRAM, F.array(c)).otherwise(F.array_distinct(grams))


def substring_pairs(queries: DataFrame, texts: DataFrame) -> DataFrame:
    """All pairs with ``query`` inside ``text``; inputs are one-column tables of distinct values.

    A text holding the query holds each of its grams. So every query looks up just its
    rarest gram in the gram index of the texts and the candidates are then checked with
    ``contains``: an equi join, no pairing of everything with everything.
    """
    index = texts.filter(F.col("text") != "").select("text", F.explode(_text_grams(F.col("text"))).alias("gram"))
    frequency = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n_texts"))
    probes = (
        queries.filter(F.col("query") != "")
        .select("query", F.explode(_query_grams(F.col("query"))).alias("gram"))
        .join(frequency, "gram")
        .groupBy("query")
        .agg(F.min(F.struct("n_texts", "gram")).alias("rarest"))
        .select("query", F.col("rarest.gram").alias("gram"))
    )
    return probes.join(index, "gram").filter(F.contains("text", "query")).select("query", "text")
