"""Filter funnels: how many listings survive each predicate, and which one left none."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.numbering import keyed_totals
from ..operators.predicates import budget_is, cuisine_matches, location_matches, rating_at_least
from ..operators.spread import spread_join
from ..operators.substring import substring_pairs
from ..sources.shared import keep
from .shortlist import wishes

COUNTS = ["n_all", "n_location", "n_cuisine", "n_rating", "n_budget"]


def _empty_stage() -> Column:
    stage = F.lit(None).cast("string")
    for name in reversed(COUNTS[1:]):
        stage = F.when(F.col(name) == 0, name.removeprefix("n_")).otherwise(stage)
    return stage.alias("empty_stage")


def filter_funnel(catalog: DataFrame, location: str, cuisine: str,
                  min_rating: float = fixed.DEFAULT_MIN_RATING, budget: str = "medium") -> DataFrame:
    """One row of counts from one pass."""
    steps = [location_matches(location), cuisine_matches(cuisine), rating_at_least(min_rating), budget_is(budget)]
    passed, counts = F.lit(True), [F.count(F.lit(1)).alias("n_all")]
    for name, step in zip(COUNTS[1:], steps):
        passed = passed & step
        counts.append(F.count_if(passed).alias(name))
    return catalog.agg(*counts).select(*COUNTS, _empty_stage())


def filter_funnel_batch(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """The funnel of every valid request.

    The catalog is reduced once to a histogram over (location, cuisine set, rating, tier), so a
    listing counts once however many of its cuisines match. Sets are matched through their
    members; thresholds are answered by running counts in rating order, which a sweep over ranges of
    (place, dish, rating) adds up, so a pair that holds half of all counts is spread over many tasks.
    """
    asked = wishes(requests)
    histogram = keep(
        catalog.groupBy(
            F.lower("location").alias("at"),
            F.array_sort(F.array_distinct(F.transform("cuisines", F.lower))).alias("menu"),
            F.when(~F.isnan("rating"), F.col("rating")).alias("rating"),
            "budget",
        ).agg(F.count(F.lit(1)).alias("n")),
        "histogram",
    )
    n_all = histogram.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()

    places = substring_pairs(
        asked.select(F.col("place").alias("query")).distinct(),
        histogram.select(F.col("at").alias("text")).na.drop().distinct(),
    ).withColumnsRenamed({"query": "place", "text": "at"})
    menus = histogram.select("menu").distinct().select("menu", F.explode("menu").alias("text"))
    dishes = substring_pairs(
        asked.select(F.col("dish").alias("query")).distinct(), menus.select("text").distinct()
    ).join(menus, "text").select(F.col("query").alias("dish"), "menu").distinct()

    per_place = (
        histogram.groupBy("at").agg(F.sum("n").alias("n")).join(places, "at")
        .groupBy("place").agg(F.sum("n").alias("n_location"))
    )
    by_dish = histogram.join(dishes, "menu").groupBy("at", "dish", "rating", "budget").agg(F.sum("n").alias("n"))
    by_wish = (
        asked.select("place", "dish").distinct().join(places, "place").join(by_dish, ["at", "dish"])
        .groupBy("place", "dish", "rating", "budget").agg(F.sum("n").alias("n"))
    )
    keys = ["place", "dish", "min_rating", "budget"]
    by_wish = keep(by_wish, "by-wish")
    per_pair = by_wish.groupBy("place", "dish").agg(F.sum("n").alias("n_cuisine"))
    counted = by_wish.select("place", "dish", F.col("rating").alias("mark"), F.lit(0).alias("kind"), "budget", "n")
    wanted = asked.select(*keys).distinct().select(
        "place", "dish", F.col("min_rating").alias("mark"), F.lit(1).alias("kind"), "budget", F.lit(0).cast("bigint").alias("n"))
    # Thresholds are merged into the sorted ratings: from the best down, unrated last, counts before thresholds at equal
    # marks. The running totals at a threshold are its answer.
    tiers = {t: F.when(F.col("budget") == t, F.col("n")).otherwise(F.lit(0)).alias(f"n_{t}") for t in fixed.TIERS}
    marks = counted.unionByName(wanted).select("*", *tiers.values())
    swept = keyed_totals(marks, ["place", "dish"], [F.desc("mark"), "kind"], {"n_rating": "n", **{f"upto_{t}": f"n_{t}" for t in tiers}})
    n_budget = F.coalesce(*[F.when(F.col("budget") == t, F.col(f"upto_{t}")) for t in tiers])
    per_wish = swept.filter(F.col("kind") == 1).select(
        "place", "dish", F.col("mark").alias("min_rating"), "budget", "n_rating", n_budget.alias("n_budget"),
    ).join(per_pair, ["place", "dish"], "left").join(per_place, "place", "left")
    answered = spread_join(asked, per_wish, keys, "request_id").withColumn("n_all", n_all)
    counts = answered.select("request_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])
    return counts.select("request_id", *COUNTS, _empty_stage())
