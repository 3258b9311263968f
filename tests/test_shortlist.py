import pytest
from pyspark.sql import functions as F

from listforge.plans import shortlist
from listforge.plans.funnel import filter_funnel, filter_funnel_batch
from listforge.plans.shortlist import best_cells, shortlist_batch, shortlist_one, wish_lists, wishes, with_shortlist
from listforge.sources.schema import CATALOG_COLUMNS
from listforge.sources.shared import keep
from tests import samples


@pytest.fixture(scope="module")
def rows():
    return samples.catalog_rows()


@pytest.fixture(scope="module")
def catalog(spark):
    return samples.catalog(spark).repartition(6).cache()


def ids(df):
    return [r.id for r in df.orderBy("pos").collect()]


WISHES = [("btm", "indian", 0.0, "medium"), ("BTM", "North Indian", 3.0, "medium"), ("nagar", "cafe", 3.9, "low"),
          ("0% R", "i", 0.0, "high"), ("a_b", "an", 2.0, "medium"), ("b%m", "indian", 0.0, "medium")]


@pytest.mark.parametrize("wish", WISHES)
def test_one(catalog, rows, wish):
    got = shortlist_one(catalog, *wish)
    assert ids(got) == samples.brute_shortlist(rows, *wish)
    assert got.columns == ["pos", *CATALOG_COLUMNS]


def test_one_is_sorted_capped_and_filtered(catalog):
    found = shortlist_one(catalog, "btm", "indian", 3.0, "medium").orderBy("pos").collect()
    assert 0 < len(found) <= 40
    assert [r.pos for r in found] == list(range(1, len(found) + 1))
    ratings = [r.rating for r in found]
    assert ratings == sorted(ratings, reverse=True) and min(ratings) >= 3.0
    assert {r.budget for r in found} == {"medium"}
    assert all("indian" in "|".join(r.cuisines).lower() for r in found)


@pytest.mark.parametrize("wish", [("InvalidCityXYZ", "Chinese", 3.0, "medium"), ("Btm", "Ethiopian or Rare", 4.9, "low")])
def test_no_match_keeps_the_schema(catalog, wish):
    got = shortlist_one(catalog, *wish)
    assert got.collect() == [] and got.drop("pos").schema.fieldNames() == catalog.schema.fieldNames()
    assert [f.dataType for f in got.drop("pos").schema] == [f.dataType for f in catalog.schema]


def test_higher_threshold_never_adds(catalog):
    low = ids(shortlist_one(catalog, "indiranagar", "chinese", 3.0, "medium"))
    high = ids(shortlist_one(catalog, "indiranagar", "chinese", 4.5, "medium"))
    assert set(high) <= set(low) and high == low[:len(high)]


def test_batch_equals_brute_force(spark, catalog, rows):
    asked = samples.request_rows()
    got = {}
    for r in shortlist_batch(samples.requests(spark), catalog).orderBy("request_id", "pos").collect():
        got.setdefault(r.request_id, []).append((r.pos, r.id))
    want = {}
    for request_id, *wish in asked:
        found = samples.brute_shortlist(rows, *wish)
        if found:
            want[request_id] = list(enumerate(found, 1))
    assert got == want


def test_batch_carries_whole_listings(spark, catalog):
    got = shortlist_batch(samples.requests(spark), catalog).drop("request_id", "pos").distinct()
    assert got.select(*CATALOG_COLUMNS).exceptAll(catalog.join(got.select("id"), "id", "left_semi").select(*CATALOG_COLUMNS)).count() == 0


def broad_requests():
    """One- and two-character texts, which nearly every place and dish holds."""
    texts = ["a", "n", "ar", "i", "an"]
    return [(i, place, dish, 0.0, tier) for i, (place, dish, tier) in enumerate(
        (p, d, t) for p in texts for d in texts for t in ("low", "medium"))]


@pytest.mark.parametrize("k", [3, 40, 60])
def test_broad_wishes(spark, catalog, rows, k):
    asked = spark.createDataFrame(broad_requests(), samples.REQUEST_SCHEMA)
    got = {}
    for r in shortlist_batch(asked, catalog, k=k).orderBy("request_id", "pos").collect():
        got.setdefault(r.request_id, []).append(r.id)
    want = {i: samples.brute_shortlist(rows, *wish, k) for i, *wish in broad_requests()}
    assert got == {i: ids for i, ids in want.items() if ids}


def test_kept_cells_and_lists_know_their_size(spark, catalog):
    asked = samples.requests(spark)
    cells = keep(best_cells(catalog, 5))
    with pytest.raises(ValueError, match="5 listings per key, 40"):
        shortlist_batch(asked, catalog, cells)
    assert shortlist_batch(asked, catalog, cells, k=5).count() > 0
    lists = keep(wish_lists(wishes(asked), cells, 5))
    with pytest.raises(ValueError, match="5 listings per key, 6"):
        with_shortlist(asked, cells, 6, lists=lists)
    assert with_shortlist(asked, cells, 5, lists=lists).count() == asked.count()
    other = spark.createDataFrame([(1, "btm", "a dish that nobody named", 0.0, "low")], samples.REQUEST_SCHEMA)
    with pytest.raises(Exception, match="other requests"):
        with_shortlist(other, cells, 5, lists=lists).collect()


def brute_funnel(rows, location, cuisine, min_rating, budget):
    a = [r for r in rows if samples.matches(r, location, cuisine)[0]]
    b = [r for r in a if samples.matches(r, location, cuisine)[1]]
    c = [r for r in b if r[4] is not None and r[4] >= min_rating]
    d = [r for r in c if r[6] == budget]
    stage = next((n for n, s in zip(["location", "cuisine", "rating", "budget"], [a, b, c, d]) if not s), None)
    return (len(rows), len(a), len(b), len(c), len(d), stage)


@pytest.mark.parametrize("wish", WISHES)
def test_funnel(catalog, rows, wish):
    assert tuple(filter_funnel(catalog, *wish).first()) == brute_funnel(rows, *wish)


def test_funnel_batch(spark, catalog, rows):
    got = {r[0]: tuple(r)[1:] for r in filter_funnel_batch(samples.requests(spark), catalog).collect()}
    assert got == {i: brute_funnel(rows, *wish) for i, *wish in samples.request_rows()}


def test_nan_rating_counts_as_missing(spark):
    df = spark.createDataFrame(
        [(1, "A", "Btm", ["Cafe"], float("nan"), 700.0, "medium"), (2, "B", "Btm", ["Cafe"], 1.0, 700.0, "medium")],
        "id bigint, name string, location string, cuisines array<string>, rating double, cost_for_two double, budget string")
    assert ids(shortlist_one(df, "btm", "cafe", 0.0, "medium")) == [2]
    asked = spark.createDataFrame([(1, "btm", "cafe", 0.0, "medium")], samples.REQUEST_SCHEMA)
    assert [r.id for r in shortlist_batch(asked, df).collect()] == [2]
    assert tuple(filter_funnel_batch(asked, df).first())[1:] == (2, 2, 2, 1, 1, None)
    assert tuple(filter_funnel(df, "btm", "cafe", 0.0, "medium").first()) == (2, 2, 2, 1, 1, None)


def test_shortlists_of_the_checks_are_not_written(spark):
    from checks.tables import Tables

    t = Tables(spark, "unused")
    t.requests = spark.createDataFrame([(1, "btm", "cafe", 0.0, "low")] * 2, "request_id long, location string, cuisine string, min_rating double, budget string")
    t.lists = spark.createDataFrame([("btm", "cafe", "low", [(1, 4.5), (2, 3.0)])], "place string, dish string, budget string, listings array<struct<pos int, rating double>>") \
        .withColumn("listings", shortlist.sized(F.col("listings"), "listings", 40))
    t.cells = None
    # Joined by each use from the requests and one row per wish.
    assert not t.shortlisted.inputFiles()
    assert [(r.request_id, len(r.shortlist)) for r in t.shortlisted.collect()] == [(1, 2)] * 2
