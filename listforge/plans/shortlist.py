"""Shortlists: the best matching listings for one request or for a whole request table.

The batch plan never pairs requests with listings. It rests on three facts:

* A shortlist is ordered by rating, so a rating threshold keeps a prefix of the
  list without threshold. Thresholds are applied last, on lists of at most 40 rows.
* Only the 40 best rows of a cell (location, cuisine, tier) can enter any shortlist. One
  pass over the catalog with a map-side cut leaves just those.
* Substring conditions concern the distinct texts only. They are looked up in a sorted table of the suffixes of
  all places and dishes, kept beside the cells; cells then join on equality.
"""

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators.predicates import budget_is, cuisine_matches, location_matches, rating_at_least
from ..operators.spread import spread_join
from ..operators.suffixes import SuffixTable, bounds_of, suffix_rows, suffix_table, texts_holding
from ..operators.topk import best_per_hot_key, best_per_key, contending
from ..sources.catalog import catalog_path, read_catalog
from ..sources.schema import CATALOG_COLUMNS
from ..sources.shared import exists, keep

WISH = ["place", "dish", "budget"]
CELL = ["at", "offers", "budget"]
# Column metadata that says how many listings a kept table of cells or lists holds per key.
_SIZE = "shortlist_size"
# Kept lists that are sent to every task, at most; a list of forty listings takes some ten kilobytes.
SMALL_LISTS = 1_000
LISTING_FIELDS = [c for c in CATALOG_COLUMNS if c not in ("id", "rating", "budget")]


def shortlist_one(catalog: DataFrame, location: str, cuisine: str,
                  min_rating: float = fixed.DEFAULT_MIN_RATING, budget: str = "medium",
                  k: int = fixed.SHORTLIST_SIZE) -> DataFrame:
    """One scan: tier and rating reach Parquet, the best ``k`` rows come from a distributed top-k.

    ``pos`` counts from 1; the numbering window sees the ``k`` rows only. No match gives no rows and the
    same schema.
    """
    best = [F.col("rating").desc(), F.col("id")]
    matching = catalog.filter(
        budget_is(budget) & rating_at_least(min_rating) & location_matches(location) & cuisine_matches(cuisine)
    )
    return matching.orderBy(*best).limit(k).select(F.row_number().over(Window.orderBy(*best)).alias("pos"), *CATALOG_COLUMNS)


def shortlist_published(spark: SparkSession, path: str, location: str, cuisine: str, **rest) -> DataFrame:
    """:func:`shortlist_one` over a published catalog; files that cannot hold the two texts are not opened."""
    return shortlist_one(read_catalog(spark, path, location=location, cuisine=cuisine), location, cuisine, **rest)


def best_cells(catalog: DataFrame, k: int = fixed.SHORTLIST_SIZE) -> DataFrame:
    """The ``k`` best listings of every (location, cuisine, tier), texts in lower case.

    Independent of the requests, so it can be built once per catalog and used by every batch. ``cell_pos`` ranks a
    cell's listings. The table remembers ``k`` and answers no request for more.
    """
    best = best_per_hot_key(cell_rows(catalog), CELL, k, "cell_pos")
    return best.withColumn("id", sized(F.col("id"), "id", k))


def cell_rows(catalog: DataFrame) -> DataFrame:
    """Every listing once per cell that it stands in."""
    return catalog.filter(
        F.col("location").isNotNull() & F.col("budget").isNotNull()
        & F.col("rating").isNotNull() & ~F.isnan("rating")
    ).select(
        F.lower("location").alias("at"),
        F.explode(F.array_distinct(F.transform("cuisines", F.lower))).alias("offers"),
        "budget", "rating", "id",
        F.struct(*LISTING_FIELDS).alias("listing"),
    )


def sized(c: Column, name: str, k: int) -> Column:
    return c.alias(name, metadata={_SIZE: k})


@dataclass(frozen=True)
class Cells:
    """The kept reduction of a catalog that batches are answered from: :func:`best_cells`, and the suffixes of their places and dishes."""

    rows: DataFrame
    texts: SuffixTable


def _texts(cells: DataFrame) -> DataFrame:
    return (cells.select(F.lit("place").alias("kind"), F.col("at").alias("text")).distinct()
            .union(cells.select(F.lit("dish").alias("kind"), F.col("offers").alias("text")).distinct()))


def indexed(cells: DataFrame | Cells) -> Cells:
    """Kept cells with their suffix table, which is built here if they come without."""
    return cells if isinstance(cells, Cells) else Cells(cells, suffix_table(_texts(cells)))


def kept_cells(catalog: DataFrame, k: int = fixed.SHORTLIST_SIZE) -> Cells:
    """Cells and suffix table of a catalog, to be built once and used by every batch."""
    return indexed(keep(best_cells(catalog, k), "cells"))


def published_cells(spark: SparkSession, path: str, k: int = fixed.SHORTLIST_SIZE) -> Cells:
    """Cells and suffix table of the newest published version at ``path``, built once per version and stored beside its files.

    The tables are written under a name of their own and then named in a list, so a build that fails is not seen and of two at
    the same time one is used. They go with the version. A foreign table is not written to.
    """
    folder = catalog_path(spark, path)
    if folder == path:
        return kept_cells(read_catalog(spark, path), k)
    listed = f"{folder}/_cells"
    names = spark.read.schema("k int, name string").parquet(listed).filter(F.col("k") >= k).orderBy("k", "name").head(1) if exists(spark, listed) else []
    if names:
        name = names[0]["name"]
    else:
        name = f"_cells-{k}-{uuid.uuid4().hex}"
        best_cells(read_catalog(spark, path), k).write.parquet(f"{folder}/{name}/rows")
        suffix_rows(_texts(spark.read.parquet(f"{folder}/{name}/rows"))).write.parquet(f"{folder}/{name}/suffixes")
        bounds_of(spark.read.parquet(f"{folder}/{name}/suffixes")).write.parquet(f"{folder}/{name}/bounds")
        spark.range(1).select(F.lit(k).alias("k"), F.lit(name).alias("name")).write.mode("append").parquet(listed)
    rows, suffixes, bounds = (spark.read.parquet(f"{folder}/{name}/{part}") for part in ("rows", "suffixes", "bounds"))
    return Cells(rows, SuffixTable(suffixes, bounds))


def _held(df: DataFrame, column: str, k: int) -> None:
    held = df.schema[column].metadata.get(_SIZE, 0)
    if held < k:
        raise ValueError(f"the kept table holds {held} listings per key, {k} are asked for")


def wishes(requests: DataFrame) -> DataFrame:
    """Requests with the lower-case texts they are matched by."""
    return requests.withColumns({"place": F.lower("location"), "dish": F.lower("cuisine")})


def wish_lists(asked: DataFrame, cells: DataFrame | Cells, k: int = fixed.SHORTLIST_SIZE) -> DataFrame:
    """Per distinct wish (place, dish, budget) its best ``k`` listings as one sorted array, empty without a match.

    ``cells`` should come from :func:`kept_cells` or be a written table, it is read several times. A broad text matches very many places and
    dishes, so lists are first compared by their best row alone: at most ``k`` lists can hold one of the ``k``
    best, and only these are opened. Ranking moves (rating, id) with the keys; the listing is fetched for the
    winners at the end.
    """
    index = indexed(cells)
    cells = index.rows
    _held(cells, "id", k)
    cell = CELL
    asked = keep(asked.select(*WISH).distinct(), "wishes")
    ranks = cells.select(*cell, "rating", "id")
    heads = cells.filter(F.col("cell_pos") == 1).select(*cell, "rating", "id")
    held = texts_holding(asked.select(F.lit("place").alias("kind"), F.col("place").alias("query"))
                         .union(asked.select(F.lit("dish").alias("kind"), F.col("dish").alias("query"))), index.texts)
    dishes = held.filter("kind = 'dish'").select(F.col("query").alias("dish"), F.col("text").alias("offers"))
    places = held.filter("kind = 'place'").select(F.col("query").alias("place"), F.col("text").alias("at"))
    reach = asked.join(places, "place")
    stop = ["at", "dish", "budget"]
    # Only combinations somebody asks for are ranked; join, ranking and the next join share one partitioning.
    offered = contending(heads.join(dishes, "offers").join(reach.select(*stop).distinct(), stop, "left_semi"), stop, k)
    by_dish = best_per_key(ranks.join(offered.select(*cell, "dish"), cell), stop, k, "stop_pos")
    stops = contending(by_dish.filter(F.col("stop_pos") == 1).select(*stop, "rating", "id").join(reach, stop), WISH, k)
    best = best_per_key(by_dish.drop("stop_pos").join(stops.select(*stop, "place"), stop), WISH, k)
    # One cell of the winner is enough to find its listing.
    won = best.select(*WISH, "pos", "rating", "id", F.col("at").alias("_at"), F.col("offers").alias("_offers"))
    source = cells.select(F.col("at").alias("_at"), F.col("offers").alias("_offers"), F.col("budget").alias("_budget"), F.col("id").alias("_id"), "listing")
    full = won.join(source, (won["_at"] == source["_at"]) & (won["_offers"] == source["_offers"]) & (won["budget"] == source["_budget"]) & (won["id"] == source["_id"]))
    entry = F.struct(
        "pos", "id", F.col("listing.name").alias("name"), F.col("listing.location").alias("location"),
        F.col("listing.cuisines").alias("cuisines"), "rating",
        F.col("listing.cost_for_two").alias("cost_for_two"), "budget",
    )
    lists = full.groupBy(*WISH).agg(F.array_sort(F.collect_list(entry)).alias("listings"))
    every = asked.join(lists, WISH, "left")
    return every.withColumn("listings", sized(F.coalesce("listings", F.array()), "listings", k))


def few_lists(lists: DataFrame) -> bool:
    """Whether kept lists are few enough to join them without moving the requests."""
    return lists.count() <= SMALL_LISTS


def with_shortlist(requests: DataFrame, cells: DataFrame | Cells | None, k: int = fixed.SHORTLIST_SIZE,
                   extra: DataFrame | None = None, lists: DataFrame | None = None, dealt: bool = True) -> DataFrame:
    """Valid requests plus ``shortlist``: an array of at most ``k`` listings, empty without a match.

    ``extra`` holds further columns by ``request_id``; they join the narrow rows first. ``lists`` takes
    :func:`wish_lists` of these requests where they are kept for several uses; lists of other
    requests or of fewer listings are refused, and few of them are joined without a shuffle of the listings; ``cells`` are not used then. Without ``dealt``
    few lists leave the requests in their partitions.
    """
    asked = wishes(requests)
    # Only kept lists are counted, others would be built twice.
    small = lists is not None and few_lists(lists)
    # Where nothing else deals them out, few files of requests would be few tasks for rows a hundred times as wide.
    rows = asked.join(extra, "request_id", "left") if extra is not None else asked.repartition("request_id") if small and dealt else asked
    lists = wish_lists(asked, cells, k) if lists is None else lists
    _held(lists, "listings", k)
    joined = spread_join(rows, lists, WISH, "request_id", counted=asked, small=small)
    known = F.coalesce("listings", F.raise_error(F.lit("the lists were built for other requests")).cast(lists.schema["listings"].dataType))
    within = F.filter(known, lambda x: (x["rating"] >= F.col("min_rating")) & (x["pos"] <= k))
    return joined.withColumn("shortlist", within).drop("listings", "place", "dish")


def shortlist_batch(requests: DataFrame, catalog: DataFrame, cells: DataFrame | Cells | None = None,
                    k: int = fixed.SHORTLIST_SIZE) -> DataFrame:
    """The ranked rows of all requests: ``request_id, pos`` and the catalog columns."""
    cells = kept_cells(catalog, k) if cells is None else cells
    return with_shortlist(requests, cells, k).select("request_id", F.inline("shortlist"))
